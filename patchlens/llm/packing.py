"""Variable-capacity best-fit packing.

Sequences of several permitted lengths are filled with whole documents; one longer than the largest length is cut into
pieces of that length and a rest. Pieces are taken by decreasing length. Each goes to the open bin whose room it fills
best, the one opened first where several leave as much room; where none has room, a bin of the permitted size with the least
cost for each token placed is opened, counting the pieces of this length that it would hold, the larger size where two cost the
same. The choice is made anew for every bin, so the last of a length is sized by what is left of it. Finally each bin shrinks to
the smallest permitted size that holds its contents.

Lengths are whole numbers up to the largest size, so best fit needs only how many pieces have each length, not which: the
histogram has at most `max(sizes)` rows however many documents there are. Bins with equal room are kept as ranges of bin
numbers, so the plan, too, is bounded by lengths and rooms, not by documents: a list of (length, first rank, pieces in a
bin, first bin, offset). It is the packing that one machine would find for all documents, and each task only looks up
where its pieces go: a piece's rank among those of its length (numbered without a hot partition) gives its bin.

Defined cases: null text and text without a word have no tokens and no place: they are in no bin; equal lengths are
ordered by doc_id and piece; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import gapless, keep, table
from patchlens.llm.mixing import n_tokens

SIZES = (512, 1024, 2048, 4096)
#: The plan is broadcast up to so many runs (64 bytes each), else joined by length.
BROADCAST_RUNS = 500_000


def bin_cost(size: int) -> float:
    """What a sequence costs: its tokens, attention growing with the square, and a fixed part."""
    return size * (1 + size / 65536) + 16


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = bin_cost) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing on a histogram of lengths.

    Returns runs (length, first_rank, n_pieces, in_bin, first_bin, offset, contents, size): pieces first_rank.. of this
    length go in_bin to a bin, from first_bin on, the first of a bin at token `offset`, and the bins end with `contents`
    tokens at `size`; and the bins (first_bin, n_bins, contents, opened_size, size).
    """
    placements: list[tuple] = []
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, size opened with)
    order: list[int] = []  # rooms in use, ascending
    bins = 0

    def put(room: int, first: int, count: int, size: int) -> None:
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        bisect.insort(rooms[room], (first, count, size))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, count: int, room: int, size: int, length: int = length) -> int:
            """Place pieces into `count` bins with this room, as many as fit; returns how many bins were used."""
            nonlocal left, rank
            each = room // length
            whole = min(count, left // each)
            for n, per in ((whole, each), (1, left - whole * each)) if whole < count and left > whole * each else ((whole, each),):
                if n:
                    placements.append((length, rank, n * per, per, first, size - room))
                    put(room - per * length, first, n, size)
                    first, rank, left = first + n, rank + n * per, left - n * per
            return first

        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order.pop(at)
                ranges = rooms.pop(room)
                for k, (first, count, size) in enumerate(ranges):
                    if not left:
                        for x in ranges[k:]:
                            put(room, *x)
                        break
                    after = fill(first, count, room, size)
                    if after < first + count:
                        put(room, after, first + count - after, size)
            else:
                fits = [s for s in sizes if s >= length]
                size = min(fits, key=lambda s: (cost(s) / (min(left, s // length) * length), -s))
                # the choice stays while what is left would fill any size
                count = max(1, (left - fits[-1] // length) // (size // length) + 1)
                fill(bins, count, size, size)
                bins += count
    shrunk = sorted((first, count, size - room, size, min(s for s in sizes if s >= size - room)) for room, ranges in rooms.items() for first, count, size in ranges)
    starts = [b[0] for b in shrunk]
    runs = []
    for length, rank, n, per, first, offset in placements:
        while n:  # a run ends where the bins' final contents change
            last = shrunk[bisect.bisect_right(starts, first) - 1]
            part = min(n, (last[0] + last[1] - first) * per)
            runs.append((length, rank, part, per, first, offset, last[2], last[4]))
            rank, n, first = rank + part, n - part, last[0] + last[1]
    return runs, shrunk


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, tokens: str | None = None) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, bin_id, bin_offset, bin_tokens, bin_size.

    `tokens` names a column with a document's number of tokens; by default words are counted.
    """
    spark = docs.sparkSession
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    counted = docs.select("doc_id", (F.col(tokens).cast("long") if tokens else n_tokens(F.col("text"))).alias("_all")).where("_all > 0")
    pieces = counted.select("doc_id", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / most))).alias("piece"))
    pieces = keep(pieces.select("doc_id", "piece", (F.col("piece") * most).alias("token_start"), F.least(F.lit(most).cast("long"), F.col("_all") - F.col("piece") * most).alias("n_tokens")), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    by_length: dict[int, list[tuple]] = {}
    for run in plan(histogram, sizes)[0]:
        by_length.setdefault(run[0], []).append(run[1:])
    kind = "n_tokens long, starts array<long>, runs array<struct<first_rank:long,n:long,per:long,first_bin:long,offset:long,used:long,size:long>>"
    lengths = spark.createDataFrame([(n, [x[0] for x in v], v) for n, v in by_length.items()], kind)
    ranked = gapless(pieces, ["n_tokens"], ["doc_id", "piece"], "_rank")
    # the last run that starts at or before the rank, by halving
    longest = max(map(len, by_length.values()), default=1)
    steps = F.array(*[F.lit(1 << k) for k in range(longest.bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("starts", low + step) <= F.col("_rank"), low + step).otherwise(low))
    few = sum(map(len, by_length.values())) <= BROADCAST_RUNS
    placed = ranked.join(F.broadcast(lengths) if few else lengths, "n_tokens").withColumn("_run", F.get("runs", at))
    nth = F.col("_rank") - F.col("_run.first_rank")
    return placed.select(
        "doc_id", "piece", "token_start", "n_tokens",
        (F.col("_run.first_bin") + F.floor(nth / F.col("_run.per"))).alias("bin_id"),
        (F.col("_run.offset") + (nth % F.col("_run.per")) * F.col("n_tokens")).alias("bin_offset"),
        F.col("_run.used").alias("bin_tokens"), F.col("_run.size").alias("bin_size"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
