"""What the corpus operators share: the shared folder, written tables, and cutting Arrow batches into even slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's ``spark.checkpoint.dir``.

    A temporary folder stands in for it only where the setting is absent and all executors
    are threads of this process; elsewhere that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="duskwatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `written` wrote, once nothing will read it again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about `size` bytes, with the row at which each run begins.  Only one run at a time becomes Python objects."""
    col = batch.column(text)
    lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    begin = 0
    while begin < len(lens):
        held = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, held + size, side="right")))
        yield begin, col.slice(begin, stop - begin).to_pylist()
        begin = stop


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def place(id_col: Column, text_col: str) -> Column:
    """Where a row stands among all: by id, null ids last, then by the hash of its text.  Rows that are equal in both stand in the same place."""
    return F.struct(id_col.isNull().alias("none"), F.coalesce(id_col.cast("long"), F.lit(0)).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"))


def arrow_uri(uri: str) -> str:
    """An address as Hadoop writes it, as Arrow reads it."""
    scheme, colon, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return "s3:" + rest
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return "file:///" + rest.lstrip("/") if scheme == "file" else uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address in the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def training_texts(rows: DataFrame, picked: DataFrame, max_bytes: int) -> pa.Table:
    """Of `rows` (id, t, ...) those of the ids in `picked` (id, k, ...), in order of k: of each id the text with the lowest hash, and no more of them than `max_bytes` of text.

    Texts of one id meet by partial aggregates, so an id that many rows share costs one text a task."""
    names = [c for c in {*rows.columns, *picked.columns} if c not in ("id", "k")]
    one = rows.join(F.broadcast(picked), "id").groupBy("k", "id").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64(*names), F.octet_length("t"))).alias("r")).select("k", "id", "r.*")
    upto = F.sum(F.octet_length("t")).over(Window.orderBy("k", "id"))  # of the picked ids only
    return one.withColumn("__upto__", upto).where(F.col("__upto__") <= max_bytes).drop("__upto__").orderBy("k", "id").toArrow()
