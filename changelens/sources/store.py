"""Written tables: scratch in the shared folder, caches named by what they were made from, and an append-only log.

All three write beside their place first and move there with one rename, so that a killed writer leaves nothing that a
reader would take for a table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Folder:
    """What is asked of a file system, through the session's own configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, jvm = spark, path.rstrip("/"), spark._jvm
        self._of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._of(name))) if self.has(name) else []

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._of(name), True)

    def move(self, name: str, to: str) -> bool:
        """Renames; false if there is something at the new name already."""
        self._fs.mkdirs(self._of(to).getParent())
        return not self.has(to) and bool(self._fs.rename(self._of(name), self._of(to)))

    def put(self, name: str, text: str) -> None:
        out = self._fs.create(self._of(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------- caches by content
def listed(spark: SparkSession, path: str, times: bool = True) -> str:
    """A hash of the names, sizes and times of all files below a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    what = [F.col("path") if times else F.element_at(F.split("path", "/"), -1), "length", *(["modificationTime"] if times else [])]
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64(*what).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def key_of(*parts: str) -> str:
    """The key of something made from these parts: 16 hex digits; parts can't run into one another."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


class Cache:
    """Tables below ``root``, each named by its kind and the key of what it was made from.

    A table is built once and read from then on; one with a file that is missing or of another size, or without its
    note, is built again; an empty one is returned but not kept.  Of two that build the same, the first to finish stays.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.built: list[str] = []  #: what this object had to build

    def _whole(self, name: str) -> dict | None:
        if not self.folder.has(f"{name}/note.json"):
            return None
        try:
            note = json.loads(self.folder.get(f"{name}/note.json"))
            same = note["files"] == listed(self.spark, f"{self.folder.path}/{name}/data", times=False)
        except (ValueError, KeyError, Py4JError, PySparkException):  # a note that can't be read, or no data beside it
            return None
        return note if same else None

    def table(self, kind: str, sources: dict[str, str], build: Callable[[], DataFrame], version: str = "1", refresh: bool = False, **settings) -> DataFrame:
        """The table ``kind`` made from ``sources`` (name: path) under a version of its maker and settings."""
        parts = [f"{n}={p}={listed(self.spark, p)}" for n, p in sorted(sources.items())]
        name = f"{kind}-{key_of(kind, version, json.dumps(settings, sort_keys=True, default=str), *parts)}"
        note = None if refresh else self._whole(name)
        if note is None:
            self.built.append(name)
            made = build()
            work = f".{name}-{uuid.uuid4().hex}"
            made.write.parquet(f"{self.folder.path}/{work}/data")
            rows = self.spark.read.schema(made.schema).parquet(f"{self.folder.path}/{work}/data").count()
            if not rows:
                self.folder.remove(work)
                return self.spark.createDataFrame([], made.schema)
            note = {"rows": rows, "schema": made.schema.json(), "files": listed(self.spark, f"{self.folder.path}/{work}/data", times=False)}
            self.folder.put(f"{work}/note.json", json.dumps(note))
            if self.folder.has(name) and (refresh or self._whole(name) is None):
                self.folder.remove(name)
            if not self.folder.move(work, name):
                self.folder.remove(work)
        return self.spark.read.schema(StructType.fromJson(json.loads(note["schema"]))).parquet(f"{self.folder.path}/{name}/data")


# ---------------------------------------------------------------------- an append-only log
class Refused(ValueError):
    """A write that would change what a log holds."""


class Log:
    """A table that only grows, in numbered commits.

    A commit's rows are written to a folder of their own; a note with their number, an order-free hash of their content,
    their schema and the hash of the note before then takes the next number by one rename.  Readers look at notes alone,
    so rows of a writer that died are never seen, and of two that commit at once the later takes the number after.
    ``key``: columns that name a row; a commit with a key that the log has, or has twice itself, is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ()):
        self.spark, self.folder, self.key = spark, Folder(spark, path), key

    def _notes(self) -> list[str]:
        return [n for n in self.folder.names("notes") if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return int(self._notes()[-1][:-5]) if self._notes() else 0

    def note(self, number: int) -> dict:
        return json.loads(self.folder.get(f"notes/{number:012d}.json"))

    @staticmethod
    def _content(df: DataFrame) -> tuple[int, str]:
        n, h = df.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))).first()
        return n, str(h or 0)

    def append(self, rows: DataFrame, tries: int = 20) -> int:
        """Commits the rows; the commit's number.  Nothing is seen of them until then."""
        mine = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{mine}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.folder.path}/{mine}")
        n, content = self._content(own)
        checked = 0
        for _ in range(tries):
            last = self.version()
            if last and self.note(last)["schema"] != rows.schema.json():
                raise Refused("the schema differs from the log's")
            if self.key:
                twice = checked == 0 and not own.groupBy(*self.key).count().where("count > 1").isEmpty()
                if twice or (last > checked and not own.join(self.read(last, after=checked).select(*self.key), list(self.key), "left_semi").isEmpty()):
                    self.folder.remove(mine)
                    raise Refused("a row with this key is in the log already")
                checked = last
            before = hashlib.sha256(self.folder.get(f"notes/{last:012d}.json").encode()).hexdigest() if last else ""
            note = json.dumps({"rows": n, "content": content, "schema": rows.schema.json(), "folder": mine, "before": before})
            work = f"notes/.{uuid.uuid4().hex}"
            self.folder.put(work, note)
            if self.folder.move(work, f"notes/{last + 1:012d}.json"):
                return last + 1
            self.folder.remove(work)
        raise RuntimeError("others kept committing")

    def read(self, version: int | None = None, after: int = 0) -> DataFrame:
        """The rows of commits up to a version (the last one, if none is given) and after another."""
        top = self.version() if version is None else version
        if not top:
            raise ValueError("nothing has been committed")
        notes = [self.note(k) for k in range(after + 1, top + 1)]
        schema = StructType.fromJson(json.loads(self.note(top)["schema"]))
        if not notes:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{n['folder']}" for n in notes])

    def verify(self) -> list[tuple[int, str]]:
        """What is wrong with each commit that isn't as it was written: ``broken chain``, ``missing`` or ``changed``."""
        out, before = [], ""
        for k in range(1, self.version() + 1):
            note = self.note(k)
            if note["before"] != before:
                out.append((k, "broken chain"))
            before = hashlib.sha256(self.folder.get(f"notes/{k:012d}.json").encode()).hexdigest()
            if not self.folder.has(note["folder"]):
                out.append((k, "missing"))
            elif self._content(self.read(k, after=k - 1)) != (note["rows"], note["content"]):
                out.append((k, "changed"))
        return out

    def leftovers(self) -> list[str]:
        """Folders of writers that died before their commit, or haven't come to it yet."""
        known = {self.note(k)["folder"] for k in range(1, self.version() + 1)}
        return [f"rows/{n}" for n in self.folder.names("rows") if f"rows/{n}" not in known]


# ---------------------------------------------------------------------- numbers without one task a group
def numbered(df: DataFrame, groups: list[str], order: list[str], to: str = "n", parts: int | None = None) -> DataFrame:
    """Adds each row's number from 1 within its group, in order; ties by a hash of the row.

    Rows are range-sorted over groups and order together, so a group that holds most rows lies in many ranges; a row's
    number is its place in its range plus what earlier ranges hold of the group.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc_nulls_first() for c in (*groups, *order)], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).asc()]
    ranged = scratch(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "ranged")
    sizes = ranged.groupBy(*groups, "part_").agg(F.count("*").alias("size_"), F.min("at_").alias("first_"))
    w = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"{c}_g" for c in groups}
    before = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(w), F.lit(0))).withColumnsRenamed(names | {"part_": "part_g"})
    met = ranged["part_"] == before["part_g"]
    for c in groups:
        met = met & ranged[c].eqNullSafe(before[names[c]])
    return ranged.join(before, met).select(*df.columns, (F.col("at_") - F.col("first_") + F.col("before_") + 1).alias(to))
