"""Tables and folders that outlive a session: a store keyed by content, and folders published whole.

Both write beside their place and rename, so that a reader sees all or nothing;
paths are any that Spark reads and writes.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of what stored tables hold; another version misses.
LAYOUT = 1
RECORD, MANIFEST = "record.json", "manifest.json"
#: What errors say where a file is missing or damaged.
BROKEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FileNotFound", "Checksum error", "not a Parquet file", "CANNOT_READ")


def digest(record: dict) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()


class Files:
    """The file system of a path, as Spark's Hadoop configuration knows it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._jvm = spark, spark.sparkContext._jvm
        self._fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, path: str):  # noqa: ANN201
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self.path(path))] if self.exists(path) else []

    def rename(self, old: str, new: str) -> bool:
        """Whether ``old`` is now ``new``; never into a folder that is there."""
        if self.exists(new):
            return False
        self._fs.mkdirs(self.path(posixpath.dirname(new)))
        return self._fs.rename(self.path(old), self.path(new))

    def remove(self, path: str) -> None:
        self._fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]


def listing(spark: SparkSession, paths: list[str]) -> dict:
    """What tells one state of files from another without reading them: their number, size, age and names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    key = F.xxhash64("path", "length", F.col("modificationTime").cast("string")).cast("decimal(38,0)")
    n, length, sums = files.agg(F.count("*"), F.sum("length"), F.sum(key).cast("string")).first()
    return {"files": n, "bytes": length, "sum": sums}


@dataclass(frozen=True)
class Store:
    """Tables by kind and by a record of all that they depend on: sources and settings."""

    spark: SparkSession
    root: str

    def place(self, kind: str, record: dict) -> str:
        return f"{self.root}/{kind}/{digest({'layout': LAYOUT, 'record': record})}"

    def get(self, kind: str, record: dict) -> DataFrame | None:
        """The table that was stored for this record; an entry that is no longer whole is removed and counts as none."""
        place, files = self.place(kind, record), Files(self.spark, self.root)
        if not files.exists(place):
            return None
        try:
            fine = json.loads(files.read(f"{place}/{RECORD}")) == json.loads(json.dumps(record, default=str)) and files.exists(f"{place}/table/_SUCCESS")
            found = self.spark.read.parquet(f"{place}/table") if fine else None
        except json.JSONDecodeError:
            found = None
        except Exception as e:  # noqa: BLE001  faults of the files mean that the entry is broken; others go on
            if not any(x in str(e) for x in BROKEN):
                raise
            found = None
        if found is None:
            files.remove(place)
        return found

    def put(self, kind: str, record: dict, df: DataFrame) -> DataFrame:
        """Store a table; where another writer was faster its table stands."""
        place, files = self.place(kind, record), Files(self.spark, self.root)
        staged = f"{self.root}/.staging/{uuid.uuid4().hex}"
        df.write.parquet(f"{staged}/table")
        files.write(f"{staged}/{RECORD}", json.dumps(record, sort_keys=True, default=str))
        if not files.rename(staged, place):
            files.remove(staged)
        return self.spark.read.parquet(f"{place}/table")

    def get_or_compute(self, kind: str, record: dict, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(kind, record)
        return found if found is not None else self.put(kind, record, make())


# ---- folders published whole


def _contents(spark: SparkSession, folder: str) -> dict[str, list]:
    """Relative path: length and sha256 of each file below a folder, computed where the files are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("sha"))
    inside = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder.rstrip("/")) + "/"
    found = {r["path"].partition(inside)[2]: [r["length"], r["sha"]] for r in rows.toLocalIterator()}  # a row a file
    return {k: v for k, v in found.items() if not k.endswith(MANIFEST)}


def publish(spark: SparkSession, path: str, write: Callable[[str], None], record: dict) -> None:
    """Fill a folder by ``write`` beside ``path``, list its contents, and put it in the place of what was there.

    A failure before the last rename leaves the old folder, or brings it back.
    """
    path, files, mark = path.rstrip("/"), Files(spark, path), uuid.uuid4().hex
    staged, backup = f"{path}.staging-{mark}", f"{path}.backup-{mark}"
    try:
        write(staged)
        files.write(f"{staged}/{RECORD}", json.dumps(record, sort_keys=True, default=str))
        files.write(f"{staged}/{MANIFEST}", json.dumps(_contents(spark, staged), sort_keys=True))
        moved = files.exists(path)
        if moved and not files.rename(path, backup):
            raise OSError(f"{path} can't be moved aside")
        if not files.rename(staged, path):
            if moved:
                files.rename(backup, path)
            raise OSError(f"{path} can't be published")
        if moved:
            files.remove(backup)
    finally:
        files.remove(staged)


def opened(spark: SparkSession, path: str, verify: bool = True) -> dict:
    """The record of a published folder whose files are as listed; a folder lost between two renames is brought back first."""
    path, files = path.rstrip("/"), Files(spark, path)
    if not files.exists(path):
        parent, name = posixpath.split(path)
        left = [x for x in files.names(parent) if x.startswith(f"{name}.backup-")]
        if len(left) != 1 or not files.rename(f"{parent}/{left[0]}", path):
            raise FileNotFoundError(f"{path} isn't published")
    if verify:
        listed, found = json.loads(files.read(f"{path}/{MANIFEST}")), _contents(spark, path)
        if wrong := sorted(k for k in listed.keys() | found.keys() if listed.get(k) != found.get(k)):
            raise ValueError(f"{path} isn't as it was published: {wrong[:5]}")
    return json.loads(files.read(f"{path}/{RECORD}"))
