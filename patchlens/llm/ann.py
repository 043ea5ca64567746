"""Approximate nearest neighbours by collision counting.

Each of `PROJECTIONS` random lines has one sorted array of the vectors' projections. A query's window on a line is centred on its
own projection; a vector collides with the query on the lines whose windows hold it. A window for a radius reaches REACH radii to
both sides, so a vector at that distance collides on a line with probability 0.68, and one at the usual distance of two vectors
less often, by how much depends on the radius alone. A vector that collides on SHARE of the lines is verified by its cosine.

The search has two passes over the index, which is cut into blocks. In the first, each block widens its windows (virtual
rehashing: a wider window stands for a coarser hash, without another index) until a PROBE-th of its vectors, and k at least, reach
the threshold, and verifies these; as the number of vectors that reach it only grows with the width, the width is found by
halving. The k-th best over all blocks is the query's bound. In the second pass every block opens its windows for just that bound
and verifies what reaches the threshold: a block without near vectors verifies little, however little it found before. Every true
neighbour lies within the bound, so each is missed only by chance, in about one case of eight at the bound itself and in fewer
within it. `n_verified` tells how many vectors of a query were compared.

The ends of a window are found by binary search in the line's sorted array, and a vector is inside if its rank on that line is; so
a block keeps ranks beside the sorted projections, and counts collisions by comparing ranks.

Distance is taken between unit vectors, where the nearest has the largest cosine. The index is a table in the shared folder: a
block of bounded bytes is one row with its ids, vectors and sorted arrays. A task searches one block for a set of queries. Sets of
queries are as large as blocks, so a vector moves once for every QUERIES queries and a query once for every block in each pass;
nothing is broadcast. Every row is indexed.

Defined cases: vectors that are null, empty, zero or have null or non-finite components, and rows without vec_id, take no
part; vectors of another length are no candidates; a row with the query's own vec_id is none either; of queries with one vec_id
the one with the smallest vector is asked; equal scores go by the smaller vec_id; with fewer than k candidates all are returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlens.llm.common import join_hot, keep, table
from patchlens.llm.embedding_dedup import usable

PROJECTIONS, SHARE, START, GROWTH, REACH, PROBE = 192, 0.645, 0.1, 1.1, 1.0, 100
BLOCK_BYTES, QUERIES, AT_ONCE = 2_000_000, 8192, 256
INDEX_KIND = "dims int, j int, sets int, ids binary, vectors binary, ranks binary, values binary"
FOUND_KIND = "query_id long, j int, place int, vec_id long, score double, n_verified long"


def lines(dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, PROJECTIONS))


class Block:
    """Vectors with, for every line, the sorted projections and each vector's rank among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, ranks: np.ndarray | None = None, values: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors.astype(float)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        if ranks is None or values is None:
            at = ((self.vectors / self.norms[:, None]) @ lines(vectors.shape[1])).astype(np.float32).T
            places = np.argsort(at, axis=1, kind="stable")
            values = np.take_along_axis(at, places, axis=1)
            ranks = np.empty(at.shape, self.kind)
            np.put_along_axis(ranks, places, np.arange(len(ids), dtype=self.kind)[None, :], axis=1)
        self.ranks, self.values, self.need = ranks, values, int(np.ceil(SHARE * PROJECTIONS))

    def _ends(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's windows begin on each line, and how many vectors they hold."""
        reach = (REACH * radii + 1e-6).astype(np.float32)  # and what single precision may be off
        low = np.array([np.searchsorted(v, c - reach, "left") for v, c in zip(self.values, centres.T, strict=True)])
        high = np.array([np.searchsorted(v, c + reach, "right") for v, c in zip(self.values, centres.T, strict=True)])
        return low.T.astype(self.kind), (high - low).T.astype(self.kind)

    def reached(self, low: np.ndarray, width: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each vector collides on enough lines. A rank below a window wraps round to a large number."""
        inside = (self.ranks - low[:, None]) < width[:, None]
        return (inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= self.need) & ~own

    def probed(self, centres: np.ndarray, owns: list[np.ndarray], k: int) -> list[np.ndarray]:
        """For each query the vectors that reach the threshold at the least width at which enough do; all, if none is wide enough."""
        rounds = START * GROWTH ** np.arange(int(np.log(2 / START) / np.log(GROWTH)) + 2)
        wanted = [min(max(k, len(self.ids) // PROBE), len(self.ids) - int(own.sum())) for own in owns]
        found, below, above = [~own for own in owns], np.full(len(owns), -1), np.full(len(owns), len(rounds))
        while (live := np.flatnonzero(above - below > 1)).size:  # all queries halve their widths together
            middle = (below[live] + above[live]) // 2
            lows, widths = self._ends(centres[live], rounds[middle])
            for q, r, low, width in zip(live.tolist(), middle.tolist(), lows, widths, strict=True):
                now = self.reached(low, width, owns[q])
                if np.count_nonzero(now) >= wanted[q]:
                    found[q], above[q] = now, r
                else:
                    below[q] = r
        return found

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple]:
        """(query id, place, vector id, cosine, null) of the k nearest verified for each query, and (query id, null, null, null, vectors verified).

        Without bounds this is the first pass; bounds: the radius for each query.
        """
        norms = np.sqrt((queries**2).sum(axis=1))
        centres = ((queries / norms[:, None]) @ lines(queries.shape[1])).astype(np.float32)
        out: list[tuple] = []
        for start in range(0, len(queries), AT_ONCE):
            some = slice(start, start + AT_ONCE)
            owns = [self.ids == asked for asked in query_ids[some]]
            if bounds is None:
                found = self.probed(centres[some], owns, k)
            else:
                found = [self.reached(*x) for x in zip(*self._ends(centres[some], bounds[some]), owns, strict=True)]
            for q, (asked, hit) in enumerate(zip(query_ids[some], found, strict=True)):
                known = np.flatnonzero(hit)
                scores = (self.vectors[known] * queries[start + q]).sum(axis=1) / (self.norms[known] * norms[start + q])
                best = np.lexsort((self.ids[known], -scores))[:k]
                out += [(int(asked), int(known[x]), int(self.ids[known[x]]), float(scores[x]), None) for x in best]
                out.append((int(asked), None, None, None, len(known)))
        return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """rows, queries (vec_id, embedding) -> query_id, rank, vec_id, score, n_verified."""
    single = {x.schema["embedding"].dataType.simpleString() for x in (rows, queries)} == {"array<float>"}
    kind, width = (np.float32, 4) if single else (np.float64, 8)

    def ready(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<float>" if single else "array<double>")
        return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(usable(F.col("vector"))).withColumn("dims", F.size("vector"))

    rows, queries = ready(rows), ready(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    counts, asked = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")), queries.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select("dims", F.ceil(F.col("n") * F.col("dims") * width / BLOCK_BYTES).cast("int").alias("blocks"))
    shape = keep(blocks.join(asked.select("dims", F.ceil(F.col("n") / QUERIES).cast("int").alias("sets")), "dims"), "shape")
    own = lambda column, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(column)).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    def build(part: pa.Table) -> pa.Table:
        vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        made = Block(part["vec_id"].to_numpy(), vectors)
        packed = [made.ids.tobytes(), vectors.tobytes(), made.ranks.tobytes(), made.values.tobytes()]
        return pa.table([*[pa.array([part[c][0].as_py()], pa.int32()) for c in ("dims", "j", "sets")], *[pa.array([x], pa.binary()) for x in packed]], names=[x.split()[0] for x in INDEX_KIND.split(", ")])

    dealt = join_hot(rows, shape, "dims", counts).where("blocks is not null").withColumn("j", own("blocks", 1))
    index = keep(dealt.groupBy("dims", "j").applyInArrow(build, INDEX_KIND), "index")

    def find(part: pa.Table) -> pa.Table:
        block, asks = part.filter(pc.is_valid(part["ids"])), part.filter(pc.is_null(part["ids"]))
        found: list[tuple] = []
        if block.num_rows and asks.num_rows:
            dims = part["dims"][0].as_py()
            ids, vectors, values = (np.frombuffer(block[c][0].as_py(), x) for c, x in (("ids", np.int64), ("vectors", kind), ("values", np.float32)))
            ranks = np.frombuffer(block["ranks"][0].as_py(), np.uint16 if len(ids) < 1 << 16 else np.uint32)
            held = Block(ids, vectors.reshape(-1, dims), ranks.reshape(PROJECTIONS, -1), values.reshape(PROJECTIONS, -1))
            wanted = asks["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asks.num_rows, -1).astype(float)
            radii = asks["radius"].to_numpy(zero_copy_only=False)
            found = held.search(wanted, asks["vec_id"].to_numpy(), k, None if np.isnan(radii).all() else radii)
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
        out = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        out.insert(1, pa.array([part["j"][0].as_py() if part.num_rows else 0] * len(found), pa.int32()))
        return pa.table(out, names=[x.split()[0] for x in FOUND_KIND.split(", ")])

    searched = index.withColumn("i", every("sets")).drop("sets")
    asking = join_hot(queries, shape, "dims", asked).where("blocks is not null").withColumn("i", own("sets", 2)).select("dims", every("blocks").alias("j"), "i", "vec_id", "vector")

    def passed(asking: DataFrame) -> DataFrame:
        return searched.unionByName(asking, allowMissingColumns=True).groupBy("dims", "i", "j").applyInArrow(find, FOUND_KIND)

    probed = keep(passed(asking.withColumn("radius", F.lit(None).cast("double"))), "probed")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "j", "place")
    kth = probed.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # unit vectors of cosine c are sqrt(2 - 2c) apart
    bounds = kth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("c")).select("query_id", F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("c")))).otherwise(2.0).alias("radius"))
    bounded = asking.join(bounds, asking["vec_id"] == bounds["query_id"]).select(*asking.columns, "radius")
    found = probed.unionByName(passed(bounded)).withColumn("n_verified", F.sum("n_verified").over(Window.partitionBy("query_id")))
    found = found.where("score is not null").dropDuplicates(["query_id", "j", "place"])
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")


def op8_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
