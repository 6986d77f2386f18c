"""A store of cells that grows by loads of several batches, each load all or nothing.

Batches are staged below the store, each complete or not there. A load takes effect by its manifest, a small file that names the
folders of all batches that count; it is written last, under a number that no other writer can take. Readers follow the newest manifest and never see staged
batches. Loads and batches have names, so a load that failed is repeated under its name: batches that were staged whole are kept, and a load that had taken effect
is not done again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


class _Files:
    """The few file operations that the store needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.read_all = jvm.org.apache.commons.io.IOUtils.toString

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.read_all(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new whole file under the name; fails if there is one."""
        part = f"{name}.part"
        stream = self.fs.create(self.at(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self.fs.rename(self.at(part), self.at(name)):
            raise RuntimeError(f"{name} was written by another load; repeat this one")


def _safe(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith((".", "_")):
        raise ValueError(f"not a name for a load or a batch: {name!r}")
    return name


def _newest(files: _Files) -> tuple[int, dict]:
    numbers = [int(m[1]) for n in files.names("manifests") if (m := re.fullmatch(r"(\d+)\.json", n))]
    return (max(numbers), json.loads(files.read(f"manifests/{max(numbers)}.json"))) if numbers else (0, {"loads": [], "batches": []})


def append(spark: SparkSession, path: str, load: str, batches: Mapping[str, DataFrame] | Iterable[tuple[str, DataFrame]], replace: bool = False) -> bool:
    """Add named batches to the store at path as one load; with replace they take the place of all that is there. False if the load had been done before.

    A batch may be given lazily, as pairs of an iterator; one that a failed attempt staged whole is not written again.
    """
    files = _Files(spark, path)
    number, manifest = _newest(files)
    if _safe(load) in manifest["loads"]:
        return False
    staged = []
    for name, batch in batches.items() if isinstance(batches, Mapping) else batches:
        folder = f"batches/{load}/{_safe(name)}"
        if folder in staged:
            raise ValueError(f"two batches of one name: {name}")
        if not files.exists(f"{folder}/_SUCCESS"):
            batch.write.mode("overwrite").partitionBy("sample_id").parquet(f"{files.root}/{folder}")
            if not files.exists(f"{folder}/_SUCCESS"):
                files.create(f"{folder}/_SUCCESS", "")
        staged.append(folder)
    kept = [] if replace else manifest["batches"]
    loads = [*([] if replace else manifest["loads"]), load]
    files.create(f"manifests/{number + 1}.json", json.dumps({"loads": loads, "batches": [*kept, *staged]}))
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches that count, columns by name; a store without a load is an error."""
    files = _Files(spark, path)
    _, manifest = _newest(files)
    if not manifest["batches"]:
        raise ValueError(f"no load in {path}")
    parts = [spark.read.option("basePath", f"{files.root}/{b}").parquet(f"{files.root}/{b}") for b in manifest["batches"] if any(n.startswith("sample_id=") for n in files.names(b))]
    out = parts[0] if parts else spark.read.parquet(f"{files.root}/{manifest['batches'][0]}")
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def swept(spark: SparkSession, path: str) -> int:
    """Delete staged batches and replaced ones that no manifest's newest version names, when no load is under way; the number of folders deleted."""
    files = _Files(spark, path)
    _, manifest = _newest(files)
    gone = [f"batches/{load}/{b}" for load in files.names("batches") for b in files.names(f"batches/{load}") if f"batches/{load}/{b}" not in manifest["batches"]]
    for folder in gone:
        files.fs.delete(files.at(folder), True)
    return len(gone)
