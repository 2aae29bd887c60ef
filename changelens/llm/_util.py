"""Shared plumbing of the training-data operators: shared folder, cut lineage, safe columns."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts can be very long, so batches are kept short.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or setCheckpointDir names it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of ids and hashes in one written file, about.
FILE_ROWS = 50_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    ``rows``: how many narrow rows it has at most, if known.  They then come in files, and tasks, of
    FILE_ROWS at least, so that a small table is not strewn over as many files as shuffles have partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, min(partitions(spark), -(-rows // FILE_ROWS))))
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that no later step reads."""
    path = getattr(df, "_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, the text (null: empty) and the named columns, so that no extra column can clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in more],
    )


def MARK(docs: DataFrame):
    """A hash of a row's whole text (null: empty), which with its id tells it apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, mark)`` isn't in ``gone``; of each in ``again`` one row.

    Both are written tables of distinct rows; ids may be null.  Of rows that agree in id and text the first by
    their JSON form stays.  Columns keep names, order and types.
    """
    i, m = unused(docs, "row_id"), unused(docs, "row_mark")
    own = docs.withColumns({i: docs["doc_id"].cast("long"), m: MARK(docs)})

    def meets(other: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        x, y = unused(docs, "other_id"), unused(docs, "other_mark")
        o = other.select(F.col("doc_id").alias(x), F.col("mark").alias(y)).hint("shuffle_hash")
        return rows.join(o, F.col(i).eqNullSafe(F.col(x)) & (F.col(m) == F.col(y)), how)

    kept = meets(gone, "left_anti", own)
    if again.isEmpty():
        return kept.drop(i, m)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    r = unused(docs, "row")
    one = meets(again, "left_semi", kept).groupBy(i, m).agg(F.min_by(row, F.to_json(row)).alias(r)).select(f"{r}.*")
    return meets(again, "left_anti", kept).drop(i, m).unionByName(one)


def released(run):
    """``run`` over Arrow batches, after which its worker gives freed memory back: workers stay alive
    between stages, and what one stage needed at its peak would else be held through the next."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return inner
