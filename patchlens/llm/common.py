"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one for a session in one process.

    On a cluster an unset folder is an error, as executors don't see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths given out since the innermost settled() of this thread or task began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(*tables: DataFrame) -> None:
    """Delete the files behind kept tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """keep(make()), without the tables that make() left in the shared folder on its way. Tables of other threads are not touched."""
    made: list[str] = []
    outer = _MADE.set(made)
    try:
        out = keep(make(), label)
    finally:
        _MADE.reset(outer)
    for path in made[:-1]:
        delete(out.sparkSession, path)
    above = _MADE.get()
    if above is not None:
        above.append(made[-1])
    return out


def with_columns_of(docs: DataFrame, *more: Column) -> DataFrame:
    """documents with every column it should have; a missing one is null. more: further columns, of docs as it is given."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], *more)


def unit_draw(*parts: Column) -> Column:
    """A uniform draw in (0, 1] from the xxhash64 of parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 1) / float(2**53)


def md5_draw(parts: Column) -> Column:
    """A uniform draw in (0, 1] from the MD5 of a string, 48 bits of it, which every engine can repeat."""
    return (F.conv(F.substring(F.md5(parts), 1, 12), 16, 10).cast("double") + 1) / float(16**12)


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, counted: DataFrame | None = None, buckets: int = 256, dealt: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without a gap.

    A key's rows are dealt into `buckets` parts by a hash of `order`, numbered part by part, and each part starts where
    the parts before it end; no task sees a whole key. `counted` may be a narrower frame of the same rows (it needs keys
    and order), so that counting reads less. Rows equal in `order` are numbered in any order among themselves. `dealt`, an
    integer column of `order`, takes the place of the hash.
    """
    bucket = F.pmod(F.xxhash64(F.lit("gapless"), *order) if dealt is None else dealt, F.lit(buckets)).cast("int")
    counts = (df if counted is None else counted).select(*keys, bucket.alias("_bucket")).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = df.withColumn("_bucket", bucket).withColumn("_at", F.row_number().over(inside) - 1)
    same = [numbered[k].eqNullSafe(starts[k]) for k in [*keys, "_bucket"]]
    return numbered.join(starts, same, "left").select(*[numbered[c] for c in df.columns], (starts["_start"] + numbered["_at"]).cast("long").alias(name))


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, parts: int = 200) -> DataFrame:
    """left with the columns of right, which has one row for each key; null where right has none.

    counts(key, n) tells how many rows of left each key has. Keys with 1 in `parts` of all rows or more are at most `parts`
    keys, so their rows of right are broadcast; rows of left with such a key, or a null one, are dealt by a hash of the
    whole row, and only the others are shuffled by key.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot_keys = counts.where(F.col(key).isNotNull() & (F.col("n") * parts >= total)).select(key)
    values = [c for c in right.columns if c != key]
    hot = right.join(F.broadcast(hot_keys), key, "left_semi").select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = right.select(F.col(key).alias("_rest_key"), *[F.col(c).alias(f"_rest_{c}") for c in values])
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    apart = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    kind = left.schema[key].dataType
    spread = (F.hash if isinstance(kind, T.IntegerType) else F.xxhash64)(*left.columns).cast(kind)
    dealt = dealt.withColumn("_apart", apart).withColumn("_at", F.when(apart, spread).otherwise(F.col(key)))
    both = dealt.join(rest, (F.col("_at") == F.col("_rest_key")) & ~F.col("_apart"), "left")
    return both.select(*left.columns, *[F.when(F.col("_apart"), F.col(f"_hot_{c}")).otherwise(F.col(f"_rest_{c}")).alias(c) for c in values])


def min_labels(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: edges(a, b) of longs -> (id, label), label the smallest id reachable.

    Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to the
    smallest node it knows. Minima are pre-aggregated before the shuffle and joins on a hub are split by skew handling, so
    a hub needs no single task. Ids without an edge are absent.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = keep(small, "edges")
        drop_kept(now)
        now = after
        # a forest of stars: no node is both a leaf and a centre, and no leaf has two centres
        sums = now.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if sums[0] == sums[1] and now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(centres)

