"""auditgrove: audit AI-tool manifests, client configurations and text corpora with Spark."""
