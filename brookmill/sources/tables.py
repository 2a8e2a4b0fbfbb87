"""Tables that a stream changes epoch by epoch, writing only what an epoch touches.

``path/data/write=N`` holds what epoch N wrote, below it a folder for each value of the partition
column; ``path/manifest/N.json`` says in which folders each value's rows are after epoch N.  The
manifest is put in place by a rename, so an epoch is there whole or not at all.  An epoch that
runs again starts from the manifest before it and gives the same table.  Old manifests go,
and folders that none of the kept ones names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: Spark's folder name for rows whose partition value is null.
NULL_VALUE = "__HIVE_DEFAULT_PARTITION__"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Folder:
    """The few file operations that a table needs, on whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.system = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it is missing."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(name)))

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self.at(name))

    def make(self, name: str = "") -> None:
        self.system.mkdirs(self.at(name))

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.system.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.path}/{old} can't be renamed to {new}")

    def bytes(self, name: str) -> int:
        return self.system.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a small file that is there whole or not at all."""
        stream = self.system.create(self.at(f"{name}.new"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self.delete(name)
        self.rename(f"{name}.new", name)


class EpochTable:
    """A table of ``schema``, partitioned by the column ``by`` or by none.

    ``keep`` manifests stay: two are enough for an epoch that runs again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str | None = "date", keep: int = 2):
        self.spark, self.schema, self.by, self.keep = spark, schema, by, keep
        self.files = Folder(spark, path)
        self.data = f"{self.files.path}/data"

    # --- what is there --------------------------------------------------------------------

    @property
    def epochs(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json"))

    @property
    def last(self) -> int:
        """The epoch written last; -1 before the first."""
        return max(self.epochs, default=-1)

    def _before(self, epoch: int) -> int:
        return max((e for e in self.epochs if e < epoch), default=-1)

    def _manifest(self, epoch: int) -> dict[str, list[str]]:
        """Folders by partition; empty before the first epoch."""
        known = max((e for e in self.epochs if e <= epoch), default=-1)
        return json.loads(self.files.read(f"manifest/{known}.json")) if known >= 0 else {}

    def read(self, epoch: int | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """The table after ``epoch`` (the last by default), or its partitions ``only``, named as by ``touched``."""
        manifest = self._manifest(self.last if epoch is None else epoch)
        names = manifest if only is None else [n for n in only if n in manifest]
        folders = [f"{self.data}/{folder}" for n in names for folder in manifest[n]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        columns = [c.split()[0] for c in self.schema.split(", ")]
        return self.spark.read.schema(f"{self.schema}, write string").option("basePath", self.data).parquet(*folders).select(*columns)

    def touched(self, rows: DataFrame) -> list[str]:
        """The partitions that rows lie in: as many as the batch has dates."""
        if self.by is None:
            return [""]
        return [f"{self.by}={NULL_VALUE if r[0] is None else r[0]}" for r in rows.select(self.by).distinct().collect()]

    def bytes_written(self, epoch: int) -> int:
        return self.files.bytes(f"data/write={epoch}")

    # --- changes --------------------------------------------------------------------------

    def merge(self, updates: DataFrame, epoch: int, how: Merge) -> list[str]:
        """Rewrites the partitions that ``updates`` touch as ``how(their rows, updates)``; returns their names."""
        names, before = self.touched(updates), self._before(epoch)
        manifest = self._manifest(before)
        if names:
            self._write(how(self.read(before, names), updates), f"write={epoch}")
            manifest = {n: f for n, f in manifest.items() if n not in names} | self._written(f"write={epoch}")
        self._commit(epoch, manifest)
        return names

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Adds rows; nothing that is there is written again."""
        self._write(rows, f"write={epoch}")
        manifest = self._manifest(self._before(epoch))
        for name, folders in self._written(f"write={epoch}").items():
            manifest[name] = manifest.get(name, []) + folders
        self._commit(epoch, manifest)

    def compact(self, most: int = 1) -> int:
        """Writes partitions that lie in more than ``most`` folders anew, as one; returns how many they were."""
        epoch = self.last
        manifest = self._manifest(epoch)
        names = [n for n, folders in manifest.items() if len(folders) > most]
        if names:
            self._write(self.read(epoch, names), f"write={epoch}c")
            self._commit(epoch, {n: f for n, f in manifest.items() if n not in names} | self._written(f"write={epoch}c"))
        return len(names)

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Files of a good size: small partitions of the result are joined, large ones cut."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows = rows.select(*columns)
        writer = (rows.hint("rebalance", self.by) if self.by else rows.hint("rebalance")).write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.data}/{folder}")

    def _written(self, folder: str) -> dict[str, list[str]]:
        if self.by is None:
            return {"": [folder]}
        return {n: [f"{folder}/{n}"] for n in self.files.names(f"data/{folder}") if n.startswith(f"{self.by}=")}

    def _commit(self, epoch: int, manifest: dict[str, list[str]]) -> None:
        self.files.put(f"manifest/{epoch}.json", json.dumps(manifest))
        for old in self.epochs[: -self.keep]:
            self.files.delete(f"manifest/{old}.json")
        named = {folder for e in self.epochs for folders in self._manifest(e).values() for folder in folders}
        writes = {folder.split("/")[0] for folder in named}
        for write in self.files.names("data"):
            if write not in writes:
                self.files.delete(f"data/{write}")
            elif self.by:
                for name in self.files.names(f"data/{write}"):
                    if "=" in name and f"{write}/{name}" not in named:
                        self.files.delete(f"data/{write}/{name}")
