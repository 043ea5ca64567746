"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors with equal labels are compared by cosine. Equal vectors are one class first, with a count. Each class is coded once:
a unit vector x as s * q, q of int8, with |x - s * q| = e. Codes, scales and errors go through the shuffle, an eighth of the
vectors in double precision. The classes of a label are dealt into tiles by hash; a task gets the codes of two tiles. The true
cosine of x and y differs from s_x s_y (q_x . q_y) by at most e_x + e_y + e_x e_y, so a pair is linked for sure, not linked for
sure, or open. Only for open pairs the original vectors of their two ends are fetched, and the pair is computed again in double
precision. Nothing is lost and nothing below the threshold is linked.

A task returns, for each of its vectors, the number of vectors linked, one that its links join it to, and whether it has an
open pair: never more rows than it has vectors, however many pairs there are. The work is quadratic in a label's distinct
vectors, as comparing all rows of a label is; tiles keep memory fixed and spread a large label over all tasks.

Defined cases: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, has no
link; vectors of different length are not compared; repeated rows are linked like other equal vectors; a null vec_id takes
part and is no one's smallest id unless alone; an empty table gives an empty result; other columns are ignored. Classes are
told apart by a 64-bit hash of label and vector: two of n would be mixed up with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import drop_kept, join_hot, keep, min_labels, table

TILE = 2048
#: Integer products are summed in single precision, which is exact up to 2^24: for so many dimensions at a time.
EXACT_DIMS = 2**24 // 127**2


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the exact length of what coding loses, rounded up."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows."""
    out = np.zeros((len(a), len(b)), np.float64 if a.shape[1] > EXACT_DIMS else np.float32)
    for k in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].T.astype(np.float32)
    return out


def bounds(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the pairs that are linked for sure, and of those that may be. left, right: codes, scales, errors."""
    about = products(left[0], right[0]) * left[1][:, None] * right[1][None, :]
    error = left[2][:, None] + right[2][None, :] + left[2][:, None] * right[2][None, :] + 1e-6
    sure = about - error >= threshold
    return sure, (about + error >= threshold) & ~sure


def exact(found: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs found whose cosine in double precision reaches the threshold."""
    found = found.copy()
    norms = [np.sqrt((x**2).sum(axis=1)) for x in (a, b)]
    i, j = np.nonzero(found)
    for part in np.array_split(np.arange(len(i)), max(1, -(-len(i) // 65536))):
        p, q = i[part], j[part]
        found[p, q] = (a[p] * b[q]).sum(axis=1) / (norms[0][p] * norms[1][q]) >= threshold
    return found


def joined(link: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix, the smallest node that it reaches."""
    label = np.arange(len(link))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _encoded(classes: DataFrame) -> DataFrame:
    """cls, label, dims, copies, scale, loss and codes of each class."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            n = batch.num_rows
            scale, loss, codes = np.zeros(n), np.zeros(n), np.empty(n, object)
            values, ends = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                vectors = values[(ends[at] - d)[:, None] + np.arange(d)]
                q, scale[at], loss[at] = coded(vectors / np.sqrt((vectors**2).sum(axis=1))[:, None])
                codes[at] = [x.tobytes() for x in q]
            columns = [batch[c] for c in ("cls", "label", "dims", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scale), pa.array(loss), pa.array(codes, pa.binary())], names=["cls", "label", "dims", "copies", "scale", "loss", "codes"])

    kind = f"cls long, label {classes.schema['label'].dataType.simpleString()}, dims int, copies long, scale double, loss double, codes binary"
    return classes.select("cls", "label", "dims", "copies", "vector").mapInArrow(encode, kind)


def _answer(cls: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, copies: np.ndarray, link: np.ndarray, may: np.ndarray) -> pa.Table:
    """cls, n, other, open of each vector with a link or an open pair. a, b: the rows of the tiles."""
    if same:
        for x in (link, may):
            np.fill_diagonal(x, False)
        link, may = link | link.T, may | may.T
        n, some, square = link @ copies[a], may.any(axis=1), link
    else:
        n, some = np.concatenate([link @ copies[b], copies[a] @ link]), np.concatenate([may.any(axis=1), may.any(axis=0)])
        square = np.zeros((len(a) + len(b),) * 2, bool)
        square[: len(a), len(a) :], square[len(a) :, : len(a)] = link, link.T
        a = np.concatenate([a, b])
    tied = np.flatnonzero(n > 0)
    other = np.arange(len(a))
    other[tied] = tied[joined(square[np.ix_(tied, tied)])]
    told = np.flatnonzero((n > 0) | some)
    return pa.table({"cls": pa.array(cls[a[told]], pa.int64()), "n": pa.array(n[told], pa.int64()), "other": pa.array(cls[a[other[told]]], pa.int64()), "open": pa.array(some[told], pa.bool_())})


def links(rows: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """rows(vec_id, embedding, label) -> vec_id, n_links, component_id."""
    spark = rows.sparkSession
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    rows = rows.withColumn("cls", F.when(usable(F.col("vector")) & F.col("label").isNotNull(), F.xxhash64("label", "vector")))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = keep(classes.withColumn("dims", F.size("vector")), "classes")
    coded_classes = keep(_encoded(classes).withColumn("g", F.xxhash64("label", "dims")), "codes")
    sizes = coded_classes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    tiled = join_hot(coded_classes, sizes.select("g", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "g", sizes)
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("label", "dims", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "cls", "copies", "scale", "loss", "codes")
    place = ["label", "dims", "i", "j"]

    def sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        own, i, j = part["own"].to_numpy(), part["i"][0].as_py(), part["j"][0].as_py()
        return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j

    def compare(part: pa.Table) -> pa.Table:
        a, b, same = sides(part)
        copies, cls, scale, loss = (part[c].to_numpy() for c in ("copies", "cls", "scale", "loss"))
        codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.int8).reshape(part.num_rows, -1)
        sure, may = bounds((codes[a], scale[a], loss[a]), (codes[b], scale[b], loss[b]), threshold)
        told = _answer(cls, a, b, same, copies, sure, may)
        n = told.num_rows
        where = {cls[x]: part["own"][int(x)].as_py() for x in np.concatenate([a, b])}
        constant = [pa.chunked_array([pa.repeat(part[c][0], n)]) for c in place]
        return pa.table([*constant, pa.array([where[c] for c in told["cls"].to_numpy()], pa.int32()), *told.columns], names=[*place, "own", *told.column_names])

    kind = f"label {classes.schema['label'].dataType.simpleString()}, dims int, i int, j int, own int, cls long, n long, other long, open boolean"
    found = keep(tiled.groupBy(*place).applyInArrow(compare, kind), "links")
    drop_kept(coded_classes)

    def compare_again(part: pa.Table) -> pa.Table:
        a, b, same = sides(part)
        copies, cls = part["copies"].to_numpy(), part["cls"].to_numpy()
        vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float)
        codes = coded(vectors / np.sqrt((vectors**2).sum(axis=1))[:, None])
        _, may = bounds(*[tuple(x[side] for x in codes) for side in (a, b)], threshold)
        link = exact(may, vectors[a], vectors[b], threshold)
        return _answer(cls, a, b, same, copies, link, np.zeros_like(link)).drop_columns(["open"])

    ends = found.where("open").select(*place, "own", "cls").join(classes.select("cls", "copies", "vector"), "cls")
    again = keep(ends.groupBy(*place).applyInArrow(compare_again, "cls long, n long, other long"), "links")
    both = found.select("cls", "n", "other").unionByName(again)
    counts = both.groupBy("cls").agg(F.sum("n").alias("others"))
    labels = min_labels(spark, both.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    known = classes.select("cls", "copies", "least").join(counts, "cls", "left").join(labels.select(F.col("id").alias("cls"), "label"), "cls", "left")
    known = keep(known.select("cls", "copies", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "cls").alias("comp")), "known")
    drop_kept(classes, found, again, labels)
    by_comp = known.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = join_hot(known.select("cls", "n_links", "comp"), by_comp.select("comp", "component_id"), "comp", by_comp).select("cls", "n_links", "component_id")
    out = join_hot(rows.select("vec_id", "cls"), of_class, "cls", known.select("cls", F.col("copies").alias("n")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
