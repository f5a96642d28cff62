"""What several operators share: working folders, blocks of Arrow batches, text clean-up."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their Python finds it by PYTHONPATH or the working folder."""
    root, application = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if application in _shipped or str(root) in [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]]:
        return
    _shipped.add(application)
    base = f"{tempfile.mkdtemp(prefix='graphsieve-')}/graphsieve"
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, root.joinpath("graphsieve").name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it (local or remote path)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = context._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphsieve-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its contents go when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns, null text as empty: further columns, whatever their names, go no further."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *(docs[c] for c in more))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids go with fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 8 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total + sizes[end] <= most):
                total += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
