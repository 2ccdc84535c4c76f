"""Tables whose folders are replaced one by one: a small manifest says which folders count.

Data lies below ``path/data`` in Hive folders of the table's keys, each holding one folder for each
write (``v=<name>``).  A manifest, one JSON file for each version of the table, lists the folders that
belong to it, how many rows each holds and the last batch that each writer has put in.  A write adds
folders that no manifest names yet and then publishes the next manifest by one rename, so readers see
all of it or nothing, a failed write leaves nothing that counts, and a batch that comes again is
skipped.  Folders that a write doesn't touch are neither read nor moved.

Two writers at a time: the second to publish finds its version taken and raises.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = tuple[str | None, ...]
VERSION_COL = "v"
#: Spark's folder name for a NULL key.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Manifests that stay for readers of older versions.
KEPT_VERSIONS = 10


@dataclass
class Manifest:
    """A version of the table: for each key its folders and their rows; the last batch of each writer."""

    version: int = 0
    folders: dict[Key, dict[str, int]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        rows = [[list(k), names] for k, names in sorted(self.folders.items(), key=repr)]
        return json.dumps({"version": self.version, "batches": self.batches, "folders": rows})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["version"], {tuple(k): names for k, names in d["folders"]}, d["batches"])


class SnapshotTable:
    """A table below ``path`` with the given schema, in folders by ``keys`` (string or date columns)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ files

    def _jpath(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _manifests(self) -> list[str]:
        folder = self._jpath(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def _folder(self, key: Key, name: str) -> str:
        escape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        parts = [f"{k}={NULL_FOLDER if x is None or x == '' else escape(x)}" for k, x in zip(self.keys, key)]
        return "/".join([self.path, "data", *parts, f"{VERSION_COL}={name}"])

    # ------------------------------------------------------------ versions

    def manifest(self) -> Manifest:
        """The newest version; an empty one before the first write."""
        names = self._manifests()
        if not names:
            return Manifest()
        stream = self._fs.open(self._jpath(f"{self.path}/manifests/{names[-1]}"))
        try:
            return Manifest.from_json(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> None:
        final = self._jpath(f"{self.path}/manifests/{manifest.version:012d}.json")
        draft = self._jpath(f"{self.path}/manifests/.{manifest.version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {manifest.version} of {self.path} was published by another writer; write again")

    def read(self, manifest: Manifest | None = None, where: Callable[[Key], bool] = lambda key: True) -> DataFrame:
        """The rows of a version, the newest unless given, of the keys that ``where`` wants."""
        manifest = manifest or self.manifest()
        paths = [self._folder(k, name) for k, names in manifest.folders.items() if where(k) for name in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        read = T.StructType([*self.schema.fields, T.StructField(VERSION_COL, T.StringType())])
        rows = self.spark.read.schema(read).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*self.schema.names)

    def drop(self, keys: Iterable[Key], base: Manifest | None = None) -> Manifest:
        """Publish the next version without some keys; no data is read or written."""
        base = base or self.manifest()
        gone = set(keys)
        made = Manifest(base.version + 1, {k: n for k, n in base.folders.items() if k not in gone}, base.batches)
        self._publish(made)
        return made

    def write(self, rows: DataFrame, *, base: Manifest | None = None, replace: bool = False, drop: Iterable[Key] = (),
              keys: Iterable[Key] | None = None, writer: str | None = None, batch: int | None = None) -> Manifest:
        """Publish the next version: ``base`` (the newest unless given) with ``rows`` added, and with
        ``replace`` in place of all that their keys held; keys in ``drop`` go first.  ``batch``
        becomes the writer's last.  ``keys``, if the caller knows them, are those that ``rows`` have;
        else folders are listed.  Rows should come with a key's rows in few tasks.

        The driver gets one number for each key that ``rows`` touch.
        """
        base = base or self.manifest()
        name = f"{base.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        data = f"{self.path}/data"
        rows.select(*self.schema.names).withColumn(VERSION_COL, F.lit(name)).write.mode("append").partitionBy(*self.keys, VERSION_COL).parquet(data)
        new: dict[Key, int] = {}
        touched = self._written(name) if keys is None else [self._folder(k, name) for k in keys]
        if touched:
            read = self.spark.read.schema(self.schema).option("basePath", data).parquet(*touched)
            new = {_key(r, self.keys): r["n"] for r in read.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).collect()}
        dropped = set(drop)
        folders = {k: dict(names) for k, names in base.folders.items() if k not in dropped}
        for key, n in new.items():
            folders[key] = ({} if replace else folders.get(key, {})) | {name: n}
        batches = base.batches | ({writer: batch} if writer is not None and batch is not None else {})
        made = Manifest(base.version + 1, folders, batches)
        self._publish(made)
        return made

    def _written(self, name: str) -> list[str]:
        """The folders of one write, by a listing of names (a key's values are as Spark has written them)."""
        found = self._fs.globStatus(self._jpath("/".join([self.path, "data", *["*"] * len(self.keys), f"{VERSION_COL}={name}"])))
        return [s.getPath().toString() for s in found or []]

    def has(self, writer: str | None, batch: int | None, manifest: Manifest | None = None) -> bool:
        """Whether a writer's batch, or a later one, is in the table."""
        if writer is None or batch is None:
            return False
        return (manifest or self.manifest()).batches.get(writer, -1) >= batch

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest ``keep`` and the folders that none of those names; no
        writer may be at work.  Returns how many folders went."""
        names = self._manifests()
        for old in names[: max(0, len(names) - keep)]:
            self._fs.delete(self._jpath(f"{self.path}/manifests/{old}"), False)
        live = set()
        for kept in names[max(0, len(names) - keep) :]:
            stream = self._fs.open(self._jpath(f"{self.path}/manifests/{kept}"))
            try:
                m = Manifest.from_json(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            live |= {self._jpath(self._folder(k, n)).toUri().getPath() for k, ns in m.folders.items() for n in ns}
        gone = 0
        for status in self._fs.globStatus(self._jpath("/".join([self.path, "data", *["*"] * len(self.keys), f"{VERSION_COL}=*"]))) or []:
            if status.getPath().toUri().getPath() not in live:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone


def _key(row: Row, keys: Sequence[str]) -> Key:
    return tuple(None if row[k] is None else str(row[k]) for k in keys)
