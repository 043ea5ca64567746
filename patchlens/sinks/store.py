"""Reports of many patches in few files, read back one by one, and appends that may be repeated.

A store is written as a run: Parquet files dealt by ranges of patch_id and sorted, with a Bloom filter of ids and small row groups,
beside an index of the ids each file begins and ends with. A report is found by the index, which names its file, and by the file's
own statistics, so nothing else is read. A run is written to a folder of its own and takes its place by one rename: a job that dies
half-way leaves the run before it to readers. Runs that readers no longer need are removed by prune().

append_once() adds rows under the name of their batch, by a rename too: a batch that is repeated, after a failure or by a stream that
starts again from its checkpoint, is there once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions.render import markdown_of
from patchlens.sinks.reports import bodies

#: Bytes of a row group: about what one look-up reads.
GROUP_BYTES = 4 << 20


def _hadoop(spark: SparkSession, path: str):
    """The path as Hadoop's, and its file system: the one that Spark writes to."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _renamed(spark: SparkSession, staging: str, final: str) -> bool:
    """Put a written folder in its place; False, and the folder is removed, if something is there already."""
    source, fs = _hadoop(spark, staging)
    target, _ = _hadoop(spark, final)
    # a rename into a folder that exists would move it below that one
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, True)
    return False


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    place, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith(prefix)) if fs.exists(place) else []


def write_store(rows: DataFrame, path: str, files: int | None = None) -> str:
    """rows(patch_id, format, body) as a run under path; returns its name. files: how many, by default as many as a shuffle has parts."""
    spark = rows.sparkSession
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    keyed = rows.select(F.col("patch_id").cast("string").alias("patch_id"), "format", "body")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by id and format, so that one id with many reports is dealt out too
    dealt = keyed.repartitionByRange(parts, "patch_id", "format").sortWithinPartitions("patch_id", "format")
    options = {"parquet.bloom.filter.enabled#patch_id": "true", "parquet.block.size": str(GROUP_BYTES)}
    dealt.write.options(**options).parquet(f"{staging}/data")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    written = spark.read.schema(keyed.schema).parquet(f"{staging}/data").select(name, F.col("patch_id"))
    index = written.groupBy("file").agg(F.min("patch_id").alias("low"), F.max("patch_id").alias("high"), F.count_if(F.col("patch_id").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))
    index.coalesce(1).write.parquet(f"{staging}/index")
    number = max([int(x.removeprefix("run-")) for x in runs(spark, path)], default=0) + 1
    if not _renamed(spark, staging, f"{path}/run-{number:08d}"):
        raise RuntimeError(f"{path}: another job wrote a run at the same time, or the folder can't be renamed")
    return f"run-{number:08d}"


def write_report_store(packets: DataFrame, path: str, formats: tuple[str, ...] = ("html", "md", "json", "text"), lang: str = "en", files: int | None = None) -> str:
    """Every packet in each format as a store; the packets are worked out once."""
    columns = bodies(packets, lang)
    if unknown := set(formats) - set(columns):
        raise ValueError(f"no such format: {', '.join(sorted(unknown))}")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), columns[f].alias("body")) for f in formats])).alias("r")
    return write_store(packets.select("patch_id", each).select("patch_id", "r.*"), path, files)


def runs(spark: SparkSession, path: str) -> list[str]:
    return _names(spark, path, "run-")


def read_store(spark: SparkSession, path: str, patch_id: str | None = None) -> DataFrame:
    """The reports of the last run; with patch_id those of one patch, from the files whose ranges hold it."""
    last = runs(spark, path)
    if not last:
        raise FileNotFoundError(f"{path} has no run")
    base = f"{path}/{last[-1]}"
    kind = "patch_id string, format string, body string"
    if patch_id is None:
        return spark.read.schema(kind).parquet(f"{base}/data")
    found = spark.read.parquet(f"{base}/index").where((F.col("low") <= patch_id) & (F.col("high") >= patch_id)).select("file").collect()  # a file, or the few that one id fills
    if not found:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{base}/data/{r.file}" for r in found]).where(F.col("patch_id") == patch_id)


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all runs but the last `keep`, and what jobs left that died."""
    for name in [*runs(spark, path)[: -keep or None], *_names(spark, path, "_staging-")]:
        place, fs = _hadoop(spark, f"{path}/{name}")
        fs.delete(place, True)


def append_once(rows: DataFrame, path: str, batch: str) -> bool:
    """Text rows(value) to path/batch=..., unless that batch is there; whether they were added."""
    spark = rows.sparkSession
    if _names(spark, path, f"batch={batch}"):
        return False
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    rows.write.text(staging)
    return _renamed(spark, staging, f"{path}/batch={batch}")


def summaries_to(path: str, lang: str = "en") -> Callable[[DataFrame, int], None]:
    """A sink for review_stream(): each packet's summary in Markdown, once, however often a batch is tried."""

    def sink(frame: DataFrame, n: int) -> None:
        append_once(frame.select(markdown_of(lang=lang, summary=True).alias("value")), path, f"{n:010d}")

    return sink
