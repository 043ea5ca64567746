"""Removal of repeated passages with compressed FM-indexes.

A window is a run of `window` words of one document. It goes where the same words stand earlier too: in a document with a smaller
doc_id, or further to the front of the same one. All windows are covered, at traffic that grows with the text:

1. Each window has an anchor, the least of the hashes of its runs of `GRAM` words; equal windows have equal anchors. Consecutive
   windows with one anchor are a piece. Runs that very many documents have, as a sample shows, come last in the order, so that
   a widespread passage is the anchor of its own inner windows alone.
2. Pieces are counted by anchor, by hashes alone. A piece whose anchor has no other piece holds no repeated window. Equal pieces
   are one entry: those that are not its first occurrence go whole, as each of their windows stands in the first one.
3. Where an anchor has several distinct pieces, the first occurrence of each is text of an FM-index; anchors are dealt into shards.
   A shard's index is the Burrows-Wheeler transform of its words in a wavelet tree of packed bits with running counts, and every
   eighth place of the suffix array. The shard's pieces are streamed against it, a batch at a time: from the last word of each
   window backward search narrows the rows of the index, and the words read while two or more rows are left are its matching
   statistic. Windows that reach the threshold are reported; the least place in their rows tells whether one stands earlier.
4. Each document is rewritten from the intervals reported for it.

The sample of step 1 decides how work is dealt, never which windows are found. Words are numbered within a shard, so nothing there
rests on hashes; two different pieces would have to agree in two hashes of 64 bits each to be taken for one.

Defined cases: a null text has no words; a document of fewer words than a window keeps all; null doc_ids come last and, like any
rows that share a doc_id, count as one document: of equal windows at one start neither is earlier, so repeated rows of one doc_id
are treated alike; a text of any length is read whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlens.llm.common import drop_kept, keep, table

WINDOW, GRAM, LONGEST, STEP = 20, 6, 32, 8
#: Words of a shard's index; windows in a batch of a search.
SHARD_WORDS, BATCH = 1 << 20, 1 << 17
#: One document in SAMPLE is looked at for widespread runs: those in one of WIDESPREAD of these documents, and in LEAST at least.
SAMPLE, WIDESPREAD, LEAST = 64, 256, 8
_TOP = np.uint64(1 << 63)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
PIECE_KIND = "m long, h long, doc_id long, th long, at int, n int, twice boolean"
DONE_KIND = "doc_id long, n_words long, n_removed long, text string"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[bytes], known: _Hashes) -> np.ndarray:
    if len(known) > 1 << 19:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ (b + _B + (a >> np.uint64(29)))
    x *= _C
    return x ^ (x >> np.uint64(31))


def runs(one: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all runs of each size, put together from those of powers of two."""
    powers, out = {1: one}, []
    while max(powers) * 2 <= max(sizes):
        p = max(powers)
        powers[2 * p] = _mixed(powers[p][:-p], powers[p][p:])
    for size in sizes:
        at, found = 0, None
        for p in sorted(powers, reverse=True):
            if size & p:
                part = powers[p][at : at + len(one) - size + 1]
                found, at = part if found is None else _mixed(found, part), at + p
        out.append(found)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    now, size = x, 1
    while size * 2 <= width:
        now, size = np.minimum(now[:-size], now[size:]), size * 2
    rest, n = width - size, len(x) - width + 1
    return np.minimum(now[:n], now[rest : rest + n])


def cut(one: np.ndarray, window: int, late: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of a document: anchor, hash, first window, windows, whether a window stands twice. late: sorted runs that come last."""
    grams, whole = runs(one, GRAM, window)
    grams = grams >> np.uint64(1)
    if len(late):
        grams = np.where(late[np.minimum(np.searchsorted(late, grams), len(late) - 1)] == grams, grams | _TOP, grams)
    anchor = sliding_min(grams, window - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(first, len(anchor)))
    if n.max() > LONGEST:
        first = np.concatenate([np.arange(a, a + k, LONGEST) for a, k in zip(first, n, strict=True)])
        n = np.diff(np.append(first, len(anchor)))
    content = np.add.reduceat(whole * _B, first) ^ (whole[first] * _A) ^ n.astype(np.uint64)
    order = np.argsort(whole, kind="stable")
    same = order[1:][whole[order[1:]] == whole[order[:-1]]]  # windows that stand before in this document
    twice = np.zeros(len(first), bool)
    if len(same):
        piece = np.searchsorted(first, np.arange(len(whole)), "right") - 1
        before = dict(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))
        twice[[piece[x] for x in same.tolist() if piece[x] == piece[before[x]]]] = True
    return anchor[first].view(np.int64), content.view(np.int64), first, n, twice


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def widespread(docs: DataFrame) -> np.ndarray:
    """Runs of GRAM words that many of a sample of documents have: at most WIDESPREAD times the runs of a mean document."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for raw in batch["text"]:
                words = (raw.as_py() or b"").split()
                if len(words) >= GRAM:
                    found.append(np.unique(runs(hashed(words, known), GRAM)[0] >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["g"])

    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0)
    least = max(LEAST, sample.count() // WIDESPREAD)
    rows = sample.select("text").mapInArrow(grams, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.g for r in rows.collect()], np.int64).view(np.uint64))


def pieces(docs: DataFrame, window: int, late: np.ndarray) -> DataFrame:
    """docs -> PIECE_KIND: m the anchor, h the hash of the content, at the first of n windows, twice: whether one stands in it twice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found, ids, hashes = [], batch["doc_id"], batch["th"]
            rows = []
            for k, raw in enumerate(batch["text"]):
                words = (raw.as_py() or b"").split()
                if len(words) >= window:
                    found.append(cut(hashed(words, known), window, late))
                    rows.append(np.full(len(found[-1][0]), k))
            if found:
                m, h, at, n, twice = (np.concatenate(x) for x in zip(*found, strict=True))
                where = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), ids.take(where), hashes.take(where), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(twice)], names=[x.split()[0] for x in PIECE_KIND.split(", ")])

    return _texts(docs).mapInArrow(build, PIECE_KIND)


def repeated(found: DataFrame) -> DataFrame:
    """Pieces whose anchor occurs again, with `later` (an equal piece stands earlier) and `several` (the anchor has other pieces, or a window stands twice)."""
    place = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("at").alias("at"))
    names = ["m", "h", "doc_id", "th", "at", "n"]
    by_anchor, by_piece = Window.partitionBy("m"), Window.partitionBy("m", "h")
    rows = found.where("m >= 0").select(*names, F.count(F.lit(1)).over(by_anchor).alias("_k"), ((F.min("h").over(by_anchor) != F.max("h").over(by_anchor)) | F.max("twice").over(by_anchor)).alias("several"))
    rows = rows.where("_k > 1 or several").select(*names, (~place.eqNullSafe(F.min(place).over(by_piece))).alias("later"), "several")
    # anchors of widespread runs, which have many equal pieces: summed before they are shuffled; Spark splits the join where one is frequent
    wide = found.where("m < 0")
    firsts = wide.groupBy("m", "h").agg(F.min(place).alias("_first"), F.max("twice").alias("_twice"), F.count(F.lit(1)).alias("_n"))
    kinds = firsts.groupBy("m").agg(((F.min("h") != F.max("h")) | F.max("_twice")).alias("several"), F.sum("_n").alias("_k")).where("_k > 1 or several").drop("_k")
    wide = wide.drop("twice").join(firsts.join(kinds, "m").select("m", "h", "_first", "several"), ["m", "h"]).select(*names, (~place.eqNullSafe(F.col("_first"))).alias("later"), "several")
    return rows.unionByName(wide)


class Wavelet:
    """A sequence of numbers below 2 ** levels as a wavelet tree without pointers: a row of packed bits for each level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.rows = []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(raw)] = raw
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.rows.append((words, ones, len(values) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(words[word] & below)

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first `at` numbers end among those equal to each symbol; less the same for 0 it counts them."""
        for k, (words, ones, zeros) in enumerate(self.rows):
            r = self._ones(words, ones, at)
            at = np.where(symbols >> (len(self.rows) - 1 - k) & 1, zeros + r, at - r)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places, and down() of them."""
        symbols = np.zeros(len(at), np.int64)
        for words, ones, zeros in self.rows:
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            r = self._ones(words, ones, at)
            at = np.where(bit, zeros + r, at - r)
            symbols = symbols * 2 + bit
        return symbols, at


class FMIndex:
    """Sequences of positive numbers, each ended by a 0, joined to one text."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # ends are in the order of the text, so no suffix is compared beyond its own
        size = 1
        while True:
            key = rank * (rank.max() + 2)
            key[:-size] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            size *= 2
        last = text[order - 1]
        symbols = int(text.max()) + 1
        self.n, self.bwt = n, Wavelet(last, max(1, int(symbols - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.base = self.first[:-1] - self.bwt.down(np.arange(symbols), np.zeros(symbols, np.int64))
        starts = np.concatenate([[0], ends[:-1] + 1])
        inside = np.arange(n) - np.repeat(starts, ends - starts + 1)
        sampled = inside[order] % STEP == 0  # a sequence's first place always is, so no walk leaves it
        self.marks, self.places = Wavelet(sampled.astype(np.int64), 1), order[sampled].astype(np.int32)

    def matches(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: how many words up to each end, `most` at most, occur twice or more; and the rows [low, high) of those that reach most."""
        length = np.full(len(ends), most)
        live = np.arange(len(ends))
        c = text[ends]
        low, high = self.first[c], self.first[c + 1]
        for t in range(1, most + 1):
            more = high - low >= 2
            length[live[~more]] = t - 1
            live, low, high = live[more], low[more], high[more]
            if t == most or not len(live):
                break
            c = text[ends[live] - t]
            both = self.base[np.tile(c, 2)] + self.bwt.down(np.tile(c, 2), np.concatenate([low, high]))
            low, high = both[: len(c)], both[len(c) :]
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of rows."""
        out, live, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            mark, at = self.marks.read(rows)
            here = mark == 1
            out[live[here]] = self.places[at[here] - self.marks.rows[0][2]] + steps
            live, rows, steps = live[~here], rows[~here], steps + 1
            c, at = self.bwt.read(rows)
            rows = self.base[c] + at
        return out


def repeats(words: list[list], docs: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece, whether each of its windows stands earlier in another or in this one. docs: numbers in order; at: first window."""
    known: dict[bytes, int] = {}
    text = np.array([x for w in words for x in (*[known.setdefault(y, len(known) + 1) for y in w], 0)], np.int64)
    index = FMIndex(text)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = stops - [len(w) + 1 for w in words]
    counts = stops - starts - window  # of windows
    piece = np.repeat(np.arange(len(words)), stops - starts)
    place = (docs[piece] << 32) + at[piece] + np.arange(len(text)) - starts[piece]  # in the order of documents
    begin = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, counts, strict=True)])
    hit = np.zeros(len(begin), bool)
    for k in range(0, len(begin), BATCH):
        own = begin[k : k + BATCH]
        length, low, high = index.matches(text, own + window - 1, window)
        full = np.flatnonzero(length >= window)
        if len(full):
            groups, which = np.unique(low, return_index=True)
            sizes = high[which] - groups
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.repeat(groups - edges, sizes) + np.arange(sizes.sum())
            least = np.minimum.reduceat(place[index.locate(rows)], edges)
            hit[k + full] = least[np.searchsorted(groups, low)] < place[own[full]]
    return np.split(hit, np.cumsum(counts)[:-1])


def reported(docs: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The windows that stand earlier, of the first occurrences of pieces whose anchors have several: m, h, skip (windows before them), n."""
    firsts = rows.where("several and not later")
    words = firsts.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    wanted = firsts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("m", "h", "at", "n")).alias("list"))
    texts = _texts(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    both = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["_id"]) & (wanted["th"] == texts["_th"])).select("doc_id", "list", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, some, raw in zip(batch["doc_id"], batch["list"], batch["text"], strict=True):
                split = raw.as_py().split()
                out += [(x["m"], x["h"], doc_id.as_py(), x["at"], b" ".join(split[x["at"] : x["at"] + x["n"] + window - 1])) for x in some.as_py()]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["m", "h", "doc_id", "at", "words"])

    def search(part: pa.Table) -> pa.Table:
        seen: dict[tuple, tuple] = {}
        for m, h, doc_id, at, raw in zip(*[part[c].to_pylist() for c in ("m", "h", "doc_id", "at", "words")], strict=True):
            seen[m, h] = (doc_id is None, doc_id, at, m, h, raw)
        held = sorted(seen.values(), key=lambda x: (x[0], x[1] or 0, x[2]))
        ids = [x[:2] for x in held]
        number = {x: k for k, x in enumerate(dict.fromkeys(ids))}
        hits = repeats([x[5].split() for x in held], np.array([number[x] for x in ids]), np.array([x[2] for x in held]), window)
        out = []
        for x, hit in zip(held, hits, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            out += [(x[3], x[4], int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["m", "h", "skip", "n"])

    found = both.mapInArrow(fetch, "m long, h long, doc_id long, at int, words binary").withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    return found.groupBy("shard").applyInArrow(search, "m long, h long, skip int, n int")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> DONE_KIND: the words that no repeated window covers, joined by one space; null for a null text."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    docs = docs.select("doc_id", "text")
    found = keep(pieces(docs, window, widespread(docs)), "found")  # hashes alone; texts are split once for them
    rows = keep(repeated(found), "pieces")
    drop_kept(found)
    inside = keep(reported(docs, rows, window), "intervals").withColumnsRenamed({"m": "_m", "h": "_h", "n": "_n"})
    first = rows.where("several and not later")
    partly = first.join(inside, (first["m"] == inside["_m"]) & (first["h"] == inside["_h"])).select("doc_id", "th", (F.col("at") + F.col("skip")).alias("at"), F.col("_n").alias("n"))
    gone = rows.where("later").select("doc_id", "th", "at", "n").unionByName(partly)
    spans = gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    texts = _texts(docs)
    both = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_id"]) & (texts["th"] == spans["_th"]), "left").select("doc_id", "text", "spans")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for raw, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                raw = raw.as_py()
                split = (raw or b"").split()
                n = len(split)
                if spans:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, [x["at"] for x in spans], 1)
                    np.add.at(depth, [x["at"] + x["n"] + window - 1 for x in spans], -1)
                    split = [split[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                total.append(n)
                removed.append(n - len(split))
                kept.append(None if raw is None else b" ".join(split))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "text"])

    return both.mapInArrow(rewrite, DONE_KIND.replace("text string", "text binary")).withColumn("text", F.col("text").cast("string"))


def op11_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
late AS MATERIALIZED (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS x FROM w),
seen AS (SELECT word.doc_id, word.i, x, max(late.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last FROM word LEFT JOIN late ON late.doc_id = word.doc_id AND late.i = word.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM seen WHERE last IS NULL OR i - last >= 20 GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
