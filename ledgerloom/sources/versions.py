"""Tables that are published all at once: staged files and a manifest for each version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables under one folder, in versions. A version is a small manifest that lists the folders of each table's files.

    Files are staged under new names first and the manifest is created last, under its number, which only one writer can
    do: a run that dies half-way leaves the version before, and of two writers one is refused. Readers see whole versions.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        if not self._fs.exists(self._path("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "marks": {}}
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version; nothing where that has none."""
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            return None
        rows = self.spark.read.schema(entry["schema"]).option("basePath", f"{self.base}/data/{name}").parquet(*entry["folders"])
        return rows.select(*entry["columns"])

    def publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, marks: dict | None = None, after: int | None = None, by: dict[str, str] | None = None) -> int:
        """Publishes the next version: tables of ``replace`` anew, those of ``append`` with more rows, all others as they
        are. ``marks`` are remembered with it. ``after``: the version that this one is based on, the latest by default;
        where another has been published since, this one is refused. ``by``: tables whose files lie in folders by a column."""
        before = self.manifest(after)
        tables = dict(before["tables"])
        for more, frames in ((False, replace or {}), (True, append or {})):
            for name, frame in frames.items():
                folder = f"{self.base}/data/{name}/stage={uuid.uuid4().hex}"
                writer = frame.write
                if by and name in by:
                    writer = writer.partitionBy(by[name])
                writer.parquet(folder)
                old = tables.get(name, {"folders": []})["folders"] if more else []
                tables[name] = {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields), "columns": frame.columns, "folders": [*old, folder]}
        version = before["version"] + 1
        body = json.dumps({"version": version, "tables": tables, "marks": {**before["marks"], **(marks or {})}})
        target, staged = self._path(f"manifests/{version:012d}.json"), self._path(f"staged/{uuid.uuid4().hex}.json")
        out = self._fs.create(staged, False)
        out.write(body.encode())
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            raise RuntimeError(f"version {version} has been published by another writer")
        return version
