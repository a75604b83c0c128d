"""Training-data operators: ten corpus-scale jobs, independent of the rest of the package."""
