"""MinHash near-duplicate removal with bottom-k sketches from one hash function.

A document's set holds the hashes of its word shingles; its sketch is the k least of them. Equal sets are one class, by
a digest of the set, so copies never form pairs. Inverted lists of retained values find classes that overlap: of each
sketch, values are listed rarest first, and as two sets with the wanted similarity share at least `shared_at_least` of
their values (exactly so where the sketches are whole sets; else but for a chance of about 1 in 10^5 at the very
threshold, and far less above it), all but so many, and one more, are enough; so a passage that many documents share
lists only those documents that consist mostly of it. The overlap within the
sketch of the union estimates the similarity and drops pairs that are clearly below; the full sets confirm the rest.

Links are wanted for their components, so no list is expanded into all its pairs:
1. each class is compared with the one leader of its lists that it shares most lists with;
2. lists whose members lie in one component by then are done; in the others, pairs from different components are compared:
   directly in lists up to `hot` members, and in longer ones in square blocks of bounded size, inside a task, which
   returns no more links than it has members.

Texts reach tasks sorted by leader, one at a time, and a leader with many members is dealt out by a salt.

Of each component one row is kept: that with the smallest (doc_id, text_hash), null ids last, and one of those equal in both.

Defined cases: a document without words has an empty set, linked with nothing, and is kept; a null doc_id takes part, and a
component of such rows alone has a null id; rows with one doc_id are worked on their own texts; equal texts are one class (classes
are told apart by 63 bits of a digest: two of n would be mixed up with a chance of n^2 / 2^64); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import DOCUMENT_COLUMNS, drop_kept, join_hot, keep, min_labels, table, with_columns_of

SKETCH, LEAST, HOT = 32, 14, 48
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the runs of n_words words; of all words, where there are fewer."""
    words = text.encode("utf-8", "replace").lower().split() if text else ()
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n_words, len(words))
    runs = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        runs = (runs ^ one[k : len(words) - n + 1 + k]) * _M
        runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    return np.unique((runs >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_hash, chars, n_shingles, cls (null for an empty set), sketch."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cls, parts = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), n_words)
                sizes.append(len(found))
                cls.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest()) >> 1 if len(found) else None)
                parts.append(found[:SKETCH].copy())
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), batch.column("chars"), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "text_hash", "chars", "n_shingles", "cls", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.length("text").alias("chars"), "text")
    return rows.mapInArrow(build, "doc_id long, text_hash long, chars int, n_shingles long, cls long, sketch array<long>")


def shared_at_least(n: F.Column) -> F.Column:
    """How many values the sketch of a set of n shares with that of any set linked with it.

    A linked set has 4/5 of n in common. The union has at most 5/4 n values; the sketch of the union is drawn from them
    without replacement, at least 4/5 of them shared: its mean less 4.75 deviations, LEAST where n is large.
    """
    n = n.cast("long")
    union = n * 1.25
    deviation = F.sqrt(0.16 * SKETCH * F.greatest(F.lit(0.0), union - SKETCH) / union)
    return F.least(F.ceil(n * 4 / 5), F.floor(0.8 * SKETCH - 4.75 * deviation)).cast("int")


def _close(n: str, m: str) -> F.Column:
    """Sizes that allow a similarity of 0.8."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * 80


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) whose overlap within the sketch of their union is not clearly too small."""
    one, two = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("_a")), classes.select(F.col("cls").alias("b"), F.col("sketch").alias("_b"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("_a", "_b")))
    return both.where(shared * SKETCH >= F.size(union) * LEAST).select("a", "b")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < 80 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """pairs(a, b) whose full sets have 100 * intersection >= 80 * union. texts(cls, text)."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sized = join_hot(pairs, counts.select("a", F.ceil(F.col("n") / 200).alias("_parts")), "a", counts)
    dealt = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("salt"))
    members = dealt.join(texts, dealt["b"] == texts["cls"]).select("a", "salt", F.lit(1).alias("role"), "b", "text")
    leaders = dealt.select("a", "salt").distinct().join(texts, F.col("a") == F.col("cls")).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader = np.zeros(0, np.int64)
        for part in parts:
            out = []
            for a, role, b, text in part.itertuples(index=False, name=None):
                found = shingles(text, n_words)
                if role == 0:
                    leader = found
                elif _linked(leader, found):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.select("a", "role", "b", "text").mapInPandas(compare, "a long, b long")


def block_links(sets: list[np.ndarray], groups: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different groups that join them into components: at most one less than there are sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = np.zeros((n, n), np.float32)
    heavy = np.flatnonzero(counts > 48)
    for part in np.array_split(heavy, max(1, -(-len(heavy) // 2048))):
        column = np.full(len(values), -1)
        column[part] = np.arange(len(part))
        at = column[inverse]
        has = np.zeros((n, len(part)), np.float32)
        has[rows[at >= 0], at[at >= 0]] = 1
        shared += has @ has.T
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(counts)
    for k in np.flatnonzero((counts > 1) & (counts <= 48)):
        who = rows[order[ends[k] - counts[k] : ends[k]]]
        shared[np.ix_(who, who)] += 1
    link = 100 * shared >= 80 * (sizes[:, None] + sizes[None, :] - shared)
    link &= groups[:, None] != groups[None, :]
    label, out = {g: g for g in groups.tolist()}, []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(link[i, i + 1 :]) + i + 1:
            p, q = root(int(groups[i])), root(int(groups[j]))
            if p != q:
                label[p] = q
                out.append((i, int(j)))
    return out


def _in_blocks(lists: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """Links across components within long lists(v, cls, comp, chars), found in square blocks of bounded rows and characters.

    Lists without the column chars, the length of a text, are bounded by rows alone.
    """
    chars = F.sum("chars") if "chars" in lists.columns else F.lit(0)
    size = lists.groupBy("v").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"))
    blocks = size.select("v", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("_blocks"))
    rows = join_hot(lists.select("v", "cls", "comp").join(texts, "cls"), blocks, "v", size).withColumn("_own", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("v", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), "cls", "comp", "text")
    rows = rows.repartition("v", "i", "j")  # a list's blocks go to different tasks

    def links(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        if part["comp"].nunique() > 1:
            found = block_links([shingles(t, n_words) for t in part["text"]], part["comp"].to_numpy())
        ids = part["cls"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return rows.groupBy("v", "i", "j").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_shingles, component_id: the smallest doc_id reachable by links, kept."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(sketches(docs, n_words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "row"))
    classes = keep(rows.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash", "chars")).alias("sample"), F.min("doc_id").alias("least"), first.alias("first"), F.count(F.lit(1)).alias("copies")), "classes")

    values = classes.select("cls", F.explode("sketch").alias("v"))
    hot = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > HOT)
    hot_of = values.join(hot, "v").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("hot"))
    common = F.coalesce(F.col("hot.v"), F.array().cast("array<long>"))
    kept = F.size("sketch")
    ordered = F.concat(F.array_except("sketch", common), common)
    prefix = F.slice(ordered, F.lit(1), kept - shared_at_least(F.col("n")) + 1)
    listed = keep(classes.join(hot_of, "cls", "left").select("cls", "n", F.col("sample.chars").alias("chars"), F.explode(prefix).alias("v")), "lists")
    shared = listed.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("n", "cls")).alias("leader")).where("members > 1")
    lists = keep(listed.join(shared, "v").select("v", "cls", "n", "chars", "members", F.col("leader.cls").alias("leader"), F.col("leader.n").alias("leader_n")), "lists")

    drop_kept(listed)
    stars = lists.where((F.col("cls") != F.col("leader")) & _close("n", "leader_n")).groupBy("cls", "leader").agg(F.count(F.lit(1)).alias("k"))
    stars = stars.groupBy("cls").agg(F.max(F.struct("k", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("cls").alias("b"))
    stars = keep(_likely(stars, classes), "stars")
    wanted = lists.select("cls").distinct().join(classes.select("cls", "sample"), "cls").select("cls", F.col("sample.doc_id").alias("_id"), F.col("sample.text_hash").alias("text_hash"))
    hashed = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    texts = keep(hashed.join(wanted, hashed["doc_id"].eqNullSafe(wanted["_id"]) & (hashed["text_hash"] == wanted["text_hash"])).select("cls", "text").dropDuplicates(["cls"]), "texts")
    links = keep(confirmed(stars, texts, n_words), "links")
    drop_kept(stars)

    known = min_labels(spark, links)
    open_lists = lists.join(known.select(F.col("id").alias("cls"), "label"), "cls", "left").select("v", "cls", "n", "chars", "members", F.coalesce("label", "cls").alias("comp"))
    mixed = open_lists.groupBy("v").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("v")
    open_lists = keep(open_lists.join(mixed, "v"), "lists")
    drop_kept(lists, known)
    short = open_lists.where(F.col("members") <= HOT)
    other = short.select("v", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("comp").alias("q"))
    pairs = short.withColumnRenamed("cls", "a").join(other, "v").where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("q")) & _close("n", "m")).select("a", "b").distinct()
    pairs = keep(_likely(pairs, classes), "pairs")
    more = confirmed(pairs, texts, n_words).unionByName(_in_blocks(open_lists.where(F.col("members") > HOT).select("v", "cls", "comp", "chars"), texts, n_words))
    first_links, links = links, keep(links.unionByName(more), "links")
    drop_kept(pairs, open_lists, texts, first_links)

    labels = min_labels(spark, links).select(F.col("id").alias("cls"), "label")
    by_class = keep(classes.join(labels, "cls", "left").select("cls", "least", "first", F.coalesce("label", "cls").alias("comp")), "components")
    drop_kept(links, labels)
    by_comp = by_class.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("first")["row"].alias("kept_row"), F.count(F.lit(1)).alias("n"))
    of_class = join_hot(by_class.select("cls", "comp"), by_comp.select("comp", "component_id", "kept_row"), "comp", by_comp)
    found = join_hot(rows.drop("sketch", "chars"), of_class.select("cls", "component_id", "kept_row"), "cls", classes.select("cls", F.col("copies").alias("n")))
    alone = F.col("cls").isNull()
    return found.select(
        "doc_id", "text_hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False))).alias("kept"),
    )


def op5_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), n_words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """documents with one row of each group of near-duplicates, the one with the smallest doc_id, null ids last."""
    docs = with_columns_of(docs)
    found = near_duplicates(docs).where("kept").select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = hashed.join(found.withColumnRenamed("doc_id", "_id"), hashed["doc_id"].eqNullSafe(F.col("_id")) & (hashed["_hash"] == F.col("text_hash")))
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*DOCUMENT_COLUMNS)
