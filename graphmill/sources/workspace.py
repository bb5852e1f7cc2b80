"""Graphs at rest: named workspaces of Parquet tables with versions, and JSON dumps."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = {"none": "none", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4", "zstd": "zstd"}


class Workspaces:
    """Folders ``root/name/vN`` and a pointer file that names the valid version.

    A save writes a whole new version and moves the pointer last, so a reader
    never sees half of it, and a failed save changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _name(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError(f"not a workspace name: {name!r}")
        return f"{self.root}/{name}"

    def _pointer(self, name: str) -> dict | None:
        p, fs = self._fs(f"{self._name(name)}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, name: str, to: dict) -> None:
        p, fs = self._fs(f"{self._name(name)}/CURRENT")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(to).encode()))
        finally:
            out.close()

    def names(self) -> list[str]:
        p, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def save(self, name: str, tables: dict[str, DataFrame], codec: str = "zstd") -> int:
        """Write all tables as the next version; returns its number."""
        now = self._pointer(name)
        version = (now["version"] if now else 0) + 1
        for t, df in tables.items():
            df.write.mode("overwrite").option("compression", CODECS[codec]).parquet(f"{self._name(name)}/v{version}/{t}")
        self._point(name, {"version": version, "tables": sorted(tables), "history": [*(now["history"] if now else []), version]})
        return version

    def load(self, name: str, version: int | None = None) -> dict[str, DataFrame]:
        now = self._pointer(name)
        if now is None:
            raise FileNotFoundError(f"no workspace {name!r}")
        v = version or now["version"]
        return {t: self.spark.read.parquet(f"{self._name(name)}/v{v}/{t}") for t in now["tables"]}

    def rollback(self, name: str) -> int:
        """Make the version before the valid one valid again."""
        now = self._pointer(name)
        if now is None or len(now["history"]) < 2:
            raise ValueError("there is no earlier version")
        history = now["history"][:-1]
        self._point(name, now | {"version": history[-1], "history": history})
        return history[-1]

    def delete(self, name: str) -> None:
        p, fs = self._fs(self._name(name))
        fs.delete(p, True)


def save_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in its own folder below ``path``."""
    for t, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{t}")


def load_json(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {t: spark.read.schema(s).json(f"{path}/{t}") for t, s in schemas.items()}


class VectorTable:
    """A stored table of vectors: add, replace, remove, exact search."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select("id", "vector")

    def add(self, rows: DataFrame) -> "VectorTable":
        """New ids are added, known ones replaced."""
        fresh = rows.select("id", "vector").dropDuplicates(["id"])
        return VectorTable(self.df.join(fresh.select("id"), "id", "left_anti").unionByName(fresh))

    def remove(self, ids: DataFrame) -> "VectorTable":
        return VectorTable(self.df.join(ids.select("id"), "id", "left_anti"))

    def search(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        from graphmill.operators.search import knn

        return knn(self.df, queries, k, "id", "vector", metric)

    def count(self) -> int:
        return self.df.agg(F.count(F.lit(1))).first()[0]
