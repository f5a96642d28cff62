"""A registry of tools whose results are kept by what they were made from, with a log of every call.

A result's key is a hash of the tool's name and version, its sorted parameters and the fingerprint of its input files (paths, lengths,
times of change). A call with a known key reads the stored table, in this session or a later one; a file that has changed or come in makes
another key. Results are Parquet tables, and calls and input files are rows of two more; the listing of files and
their fingerprint are Spark jobs, so neither the number of files nor that of calls is bounded by the driver.

A result counts as stored once its table is complete (its ``_SUCCESS`` file is there); what a lost or failed call has left is overwritten.
Two calls that make the same key at the same time store equal tables, and the later one stays.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "key string, tool string, params string, status string, hit boolean, n_rows long, n_columns int, n_files long, error string, seconds double, at timestamp"


@dataclass(frozen=True)
class Tool:
    name: str
    work: Callable[..., DataFrame]
    reads: Callable[..., list[str]] | None  # paths that the parameters name, where they are known before the work is done
    category: str
    description: str
    version: str
    cacheable: bool


@dataclass(frozen=True)
class Result:
    frame: DataFrame | None
    key: str
    hit: bool
    error: str = ""


class ResultStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.known = spark, folder.rstrip("/"), {}

    # --- tools
    def register(self, name: str, work: Callable[..., DataFrame], reads: Callable[..., list[str]] | None = None, category: str = "", description: str = "", version: str = "1", cacheable: bool = True) -> None:
        """``work`` takes keyword parameters and returns a DataFrame. Without ``reads`` the input files are those that its plan reads."""
        self.known[name] = Tool(name, work, reads, category, description, version, cacheable)

    def tools(self, category: str | None = None) -> list[dict]:
        chosen = [t for t in self.known.values() if category in (None, t.category)]
        return [{"name": t.name, "category": t.category, "description": t.description} for t in sorted(chosen, key=lambda t: (t.category, t.name))]

    # --- keys
    def files(self, paths: list[str]) -> DataFrame:
        """path, length, modificationTime of all files below the paths; their contents are not read."""
        if not paths:
            return self.spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")

    def fingerprint(self, files: DataFrame) -> tuple[str, int]:
        """A hash of a set of files, whatever their order, and their number."""
        one = lambda *tag: F.xxhash64("path", "length", "modificationTime", *map(F.lit, tag))
        x, y, n = files.agg(F.coalesce(F.bit_xor(one()), F.lit(0)), F.coalesce(F.sum(one("sum").cast("decimal(38,0)")), F.lit(0)), F.count("*")).first()
        return f"{x}:{y}:{n}", n

    def key(self, tool: Tool, params: dict, fingerprint: str) -> str:
        return hashlib.sha256(json.dumps([tool.name, tool.version, plain(params), fingerprint], sort_keys=True).encode()).hexdigest()

    def path(self, key: str) -> str:
        return f"{self.folder}/results/{key}"

    def stored(self, key: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    # --- calls
    def execute(self, name: str, **params) -> Result:
        """A tool's result, stored or read; failures are results too, and are logged."""
        tool = self.known.get(name)
        if tool is None:
            return Result(None, "", False, f"unknown tool {name!r}; known: {', '.join(sorted(self.known))}")
        began, key, hit, n_files, error, frame = time.time(), "", False, 0, "", None
        try:
            made = None if tool.reads else tool.work(**params)
            files = self.files(tool.reads(**params) if tool.reads else made.inputFiles())
            fingerprint, n_files = self.fingerprint(files)
            key = self.key(tool, params, fingerprint if tool.cacheable else f"{fingerprint}:{time.time_ns()}")
            hit = self.stored(key)
            if not hit:
                made = tool.work(**params) if made is None else made
                files.withColumn("key", F.lit(key)).write.mode("append").parquet(f"{self.folder}/files")
                made.write.mode("overwrite").parquet(self.path(key))
            frame = self.spark.read.parquet(self.path(key))
        except Exception as failure:  # a tool's failure is a result
            error = f"{type(failure).__name__}: {failure}"[:2000]
        n_rows = frame.count() if frame is not None else None  # from the footers of the stored files
        row = (key, name, json.dumps(plain(params), sort_keys=True), "failed" if error else "done", hit, n_rows, len(frame.columns) if frame is not None else None, n_files, error or None, time.time() - began)
        schema = CALLS.removesuffix(", at timestamp")
        self.spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/calls")
        return Result(frame, key, hit, error)

    def log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def calls(self) -> DataFrame:
        """A row for each call of a known tool."""
        return self.log("calls", CALLS)

    def sources(self) -> DataFrame:
        """key and the input files of each result; a result that was made again has them again."""
        return self.log("files", "path string, length long, modificationTime timestamp, key string").distinct()

    def provenance(self) -> DataFrame:
        """A row for each result: what made it from what, how often it was made and read."""
        made = self.calls().where("status = 'done'").groupBy("key", "tool", "params").agg(F.max("n_rows").alias("n_rows"), F.count_if(~F.col("hit")).alias("made"), F.count_if("hit").alias("read"))
        inputs = self.sources().groupBy("key").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
        return made.join(inputs, "key", "left")

    def clear(self, tool: str | None = None) -> int:
        """Removes stored results (of one tool), and says how many; the log of calls stays."""
        chosen = self.calls().where((F.lit(tool).isNull()) | (F.col("tool") == tool)).select("key").distinct()
        removed = 0
        for row in chosen.toLocalIterator():
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(row["key"]))
            removed += bool(row["key"]) and where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return removed


def plain(value):
    """Parameters as JSON has them: tables by their plan's columns and files, functions by name."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=str)
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, DataFrame):
        return {"plan": value.semanticHash()}
    if callable(value):
        return f"<callable {getattr(value, '__qualname__', type(value).__name__)}>"
    return repr(value)
