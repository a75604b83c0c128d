"""Stored baselines: every change is a new version, published in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditgrove.operators.drift import baseline_upsert

FIELDS = "dedup_key string, fingerprint string"


class VersionTaken(RuntimeError):
    """Another writer has published the version first."""


class BaselineStore:
    """A folder of baselines (D5): ``data-*`` folders, and in ``versions`` a file per version that names its folder.

    The file of version n is created only if there is none, after the data are written whole. So readers see one version or the next and
    nothing between, a writer that dies earlier leaves the last version as it is, and of two writers that start from the same version one gets
    ``VersionTaken`` (on file systems whose exclusive creation is atomic, as HDFS). Folders that no version names are litter; ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        self.fs = self.at("versions").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions that have a file, the latest first."""
        if not self.fs.exists(self.at("versions")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at("versions"))]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def folder(self, version: int) -> str | None:
        """The folder that a version names; None of a file without its closing line feed, which is still being written, or never was."""
        stream = self.fs.open(self.at(f"versions/{version:020d}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text.strip() if text.endswith("\n") else None

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        return next((n for n in self.numbers() if self.folder(n)), 0)

    def read(self, version: int | None = None) -> DataFrame:
        """The baseline of a version, the latest if none is given; no rows before the first."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], FIELDS)
        return self.spark.read.schema(FIELDS).parquet(f"{self.path}/{self.folder(version)}")

    def publish(self, baseline: DataFrame, after: int) -> int:
        """Write the baseline as the version that follows ``after``."""
        number, folder = after + 1, f"data-{after + 1}-{uuid.uuid4().hex[:12]}"
        if self.version() >= number:
            raise VersionTaken(f"version {number} of {self.path} is published")
        baseline.select("dedup_key", "fingerprint").write.parquet(f"{self.path}/{folder}")
        entry = self.at(f"versions/{number:020d}")
        try:
            stream = self.fs.create(entry, False)
        except Exception as e:  # noqa: BLE001  the gateway wraps the Java exception
            if "Exists" in str(e):
                self.fs.delete(self.at(folder), True)
                raise VersionTaken(f"version {number} of {self.path} is published") from None
            raise
        stream.writeBytes(folder + "\n")
        stream.close()
        return number

    def upsert(self, configs: DataFrame, attempts: int = 5) -> int:
        """Add unseen keys and leave known ones as they are; begins anew when another writer was first."""
        for _ in range(attempts):
            before = self.version()
            try:
                return self.publish(baseline_upsert(configs, self.read(before)), before)
            except VersionTaken:
                continue
        raise VersionTaken(f"{attempts} attempts to write {self.path} came second")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last versions, folders of writers that never published, and unfinished version files, which keep their number taken.
        Only while no writer is at work."""
        numbers = self.numbers()
        published = [n for n in numbers if self.folder(n)]
        for n in set(numbers) - set(published[:keep]):
            self.fs.delete(self.at(f"versions/{n:020d}"), False)
        named = {self.folder(n) for n in published[:keep]}
        for s in self.fs.listStatus(self.at("")):
            if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named:
                self.fs.delete(s.getPath(), True)
