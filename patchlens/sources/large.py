"""Patch files of any size, read in splits.

read_patches() makes a row of a file; here Spark's text source splits at file headers, so a record is one file of a patch, a
large patch is read by many tasks, and none holds it. Where a record stands in its patch is known from two passes over the
splits: the first counts the files of each split, the second numbers on from the sum of those before. The counts are one row
for each split; up to `BROADCAST_SPLITS` of them are broadcast, beyond that they are joined by a shuffle.

As read_patches(), but for: a byte order mark at the start of a file is passed over; a last line that is a header without
anything after it is no file; `id` and `part` come from the hashes of the records and not from that of the whole.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADERS = {"git": "diff --git ", "cc": "diff --cc "}
BROADCAST_SPLITS = 500_000


def read_sections(spark: SparkSession, path: str, mark: str = "git") -> DataFrame:
    """Files under path -> rows as split_files() has them before they are cut into sections: patch_id, part, id, n_files, file_no, chunk.

    mark: the kind of header that records are split at, "git", or "cc" for the diffs of merges. Headers of the other kind are
    found within records, so either mark gives the same rows.
    """
    header = HEADERS[mark]
    read = spark.read.option("lineSep", f"\n{header}").text(path)
    raw = read.select(F.col("_metadata.file_path").alias("patch_id"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("value"))
    inner = r"\n(?=diff --(?:git|cc) )"
    counted = raw.select("patch_id", "_split", "_at", F.size(F.split("value", inner, -1)).alias("_n"), F.pmod(F.xxhash64("value"), F.lit(1 << 31)).alias("_hash"), F.col("value").rlike(r"\Adiff --(?:git|cc) ").alias("_headed"))
    splits = counted.groupBy("patch_id", "_split").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_n").alias("_n"), F.sum("_hash").alias("_hash"), F.min_by("_headed", "_at").alias("_headed"),
        F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("_at", (F.col("_n") - 1).alias("more"))))).alias("_more"),
    )
    # a file that doesn't begin with a header has a preamble in its first record, which is no file
    splits = splits.withColumn("_lead", ((F.col("_split") == 0) & ~F.col("_headed")).cast("int")).withColumn("_files", F.col("_n") - F.col("_lead"))
    whole = Window.partitionBy("patch_id")
    before = whole.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "patch_id", "_split", "_first", "_more", "_lead", F.coalesce(F.sum("_files").over(before), F.lit(0)).alias("_before"), F.when(F.col("_split") == F.max("_split").over(whole), F.col("_last")).alias("_last"),
        F.sum("_files").over(whole).cast("int").alias("n_files"), F.lower(F.lpad(F.hex(F.pmod(F.sum("_hash").over(whole), F.lit(1 << 32))), 8, "0")).alias("id"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    small = splits.count() <= BROADCAST_SPLITS
    rows = raw.join(F.broadcast(splits) if small else splits, ["patch_id", "_split"])

    # the first record of a file still has its header, if it begins with one
    first = (F.col("_split") == 0) & (F.col("_at") == F.col("_first"))
    text = F.when(F.col("_at") == F.col("_last"), F.col("value")).otherwise(F.regexp_replace("value", r"\r\z", ""))
    text = F.replace(F.when(first, F.concat(F.lit("\n"), text)).otherwise(F.concat(F.lit(f"\n{header}"), text)), F.lit("\r\n"), F.lit("\n"))
    text = F.when((F.col("_at") == F.col("_last")) & text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    more = F.aggregate(F.filter("_more", lambda m: m["_at"] < F.col("_at")), F.lit(0).cast("bigint"), lambda a, m: a + m["more"])
    number = F.when(first, 0).otherwise(F.col("_before") + F.col("_at") - F.col("_first") + more - F.col("_lead"))
    rows = rows.select("patch_id", F.xxhash64("patch_id").alias("part"), "id", "n_files", number.alias("_number"), first.alias("_whole"), F.posexplode(F.split(text, inner, -1)).alias("_k", "chunk"))
    # before the first header stands an empty chunk, in a file's first record its preamble
    return rows.where("_k > 0 or _whole").select("patch_id", "part", "id", "n_files", (F.col("_number") + F.col("_k")).cast("int").alias("file_no"), "chunk")


def write_joined(patches: DataFrame, path: str, by: str) -> None:
    """patches(patch_id, text, by) -> a file for each value of `by`, in path/by=.../: its patches one after the other, in the order of their ids."""
    rows = patches.select(by, "patch_id", F.regexp_replace("text", r"\n\z", "").alias("value")).repartition(by).sortWithinPartitions(by, "patch_id")
    rows.select(by, "value").write.partitionBy(by).text(path)
