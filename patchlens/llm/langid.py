"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: for a context of up to `order` bytes, the counts of the bytes that
followed it in training. The probability of a byte is read at the longest context that has it. Each shorter step costs the
escape probability of method C (kinds seen / (kinds seen + occurrences)), and bytes that the longer context has seen are
excluded from the counts of the shorter one, as they could not have led to an escape; below order 0 the bytes left are
equally likely. So the bytes' probabilities sum to 1 in every context. Statistics are frozen before scoring: the code length
of a text is exact and does not depend on other texts. The language with the least code length wins.

Training counts come from Spark: n-gram counts of a bounded sample of labelled documents (`sample_docs` of each language,
drawn by hash) are summed in a groupBy. Every language of the labelled rows is kept, with all contexts of its sample: the
sample alone bounds the model, which is broadcast as counts. Scoring runs over whole texts: a longest-suffix automaton over the
contexts turns each byte into one table look-up for the state and one for the costs in a group of languages. The tables are
made from the counts for each batch of rows, for as many languages at once as TABLE_BYTES allows, and go before the next
group's are made: Spark keeps Python workers after their tasks, and what one still holds counts against the executor. Texts
are read from the Arrow batch a slice at a time and cut into pieces only for the sake of vector
operations; a piece begins with the bytes that its context needs, so sums are those of the whole text.

Defined cases: null text, or text without a letter (a character of a Unicode letter category; digits, fractions and Roman
numeral signs are none), is `und` with score 0; with no training data every text is `und`; equal code lengths go to the first
language in alphabetical order; repeated rows give repeated rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import DOCUMENT_COLUMNS, table, unit_draw, with_columns_of

PIECE = 1024
SLICE, SLICE_BYTES = 256, 1_000_000
TABLE_BYTES = 16_000_000
CONTEXTS = 1024


@dataclass
class Tables:
    """The languages first to last - 1: following[state, symbol], the place of the next state's first symbol, and cost[state, symbol, language] in bits."""

    first: int
    last: int
    following: np.ndarray
    cost: np.ndarray

    @property
    def next_state(self) -> np.ndarray:
        return self.following // self.cost.shape[1]


@dataclass
class Model:
    """langs; order; symbol_of[byte]; language k has grams[starts[k] : starts[k + 1]], sorted, seen n times each."""

    langs: list[str]
    order: int
    symbol_of: np.ndarray
    starts: np.ndarray
    grams: np.ndarray
    n: np.ndarray
    held: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def whole(self) -> Tables:
        """The tables of all languages at once, for small models."""
        if "whole" not in self.held:
            self.held["whole"] = tables_of(self, 0, len(self.langs))
        return self.held["whole"]

    @property
    def next_state(self) -> np.ndarray:
        return self.whole().next_state

    @property
    def cost(self) -> np.ndarray:
        return self.whole().cost

    def bounds(self) -> list[int]:
        """Groups of languages begin here; the last number is that of all languages."""
        width = int(self.symbol_of.max()) + 1
        bounds, states = [0], 0
        for k in range(len(self.langs)):
            own = len(np.unique(self.grams[self.starts[k] : self.starts[k + 1]] >> 8))
            if k > bounds[-1] and (states + own) * width * 4 * (k - bounds[-1] + 2) > TABLE_BYTES:
                bounds.append(k)
                states = 0
            states += own
        return [*bounds, len(self.langs)]

    def groups(self) -> Iterator[Tables]:
        """Tables that cover all languages in order. They are kept nowhere: who is done with one lets it go before the next."""
        for a, b in pairwise(self.bounds() if self.langs else []):
            yield tables_of(self, a, b)


def sample_of(labelled: DataFrame, sample_docs: int) -> DataFrame:
    """About `sample_docs` documents of each language (all, where there are fewer), drawn by a hash of doc_id.

    The rates are a row for each language, few enough to broadcast, so no text is shuffled by language.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rates = F.broadcast(counts.select("lang", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")).alias("_rate")))
    return labelled.join(rates, "lang").where(unit_draw(F.lit("langid"), F.col("doc_id")) <= F.col("_rate")).select("lang", "text")


def ngram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): gram packs up to order + 1 bytes behind a leading 1; the last is the byte that followed the rest."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, texts in part.groupby("lang")["text"]:
                grams: list[np.ndarray] = []
                for text in texts:
                    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64)
                    window = np.ones(len(data), np.int64)
                    for k in range(order + 1):
                        # after this step window holds grams of k + 1 bytes, by the place of their last byte
                        window = (data | 256) if k == 0 else ((window[:-1] << 8) | data[k:])
                        if not len(window):
                            break
                        grams.append(window)
                if grams:
                    keys, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    return sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def build(rows: pa.Table, order: int) -> Model:
    """The model from counts. rows: lang, gram, n."""
    names = rows["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.searchsorted(np.array(langs, object), names.dictionary.to_numpy(zero_copy_only=False)) if langs else np.zeros(0, np.int64)
    lang, grams, n = place[names.indices.to_numpy()], rows["gram"].to_numpy(), rows["n"].to_numpy()
    at = np.lexsort((grams, lang))
    used = np.unique(grams & 255)
    symbol_of = np.zeros(256, np.int16)  # symbol 0 stands for all bytes that training never saw
    symbol_of[used] = np.arange(1, len(used) + 1)
    return Model(langs, order, symbol_of, np.searchsorted(lang[at], np.arange(len(langs) + 1)), grams[at], n[at])


def _lengths(contexts: np.ndarray) -> np.ndarray:
    """Bytes of each context; it has a leading 1."""
    return np.searchsorted(np.array([1 << (8 * k) for k in range(8)]), contexts, side="right") - 1


def _shorter(contexts: np.ndarray) -> np.ndarray:
    """Each context without its oldest byte; the empty one stays."""
    lead = np.int64(1) << (8 * np.maximum(_lengths(contexts) - 1, 0))
    return (contexts & (lead - 1)) | lead


def _costs(counts: np.ndarray, length: np.ndarray, shorter: np.ndarray, cost: np.ndarray) -> None:
    """Into cost the bits of each symbol in each context of one language. counts[context, symbol]; shorter contexts come first."""
    ends = np.searchsorted(length, np.arange(int(length.max()) + 2))
    rest = np.empty((ends[-2], counts.shape[1]), counts.dtype)  # bits of a symbol once its context is escaped from

    def bits(n: np.ndarray, onward: np.ndarray) -> np.ndarray:
        """n are the counts not excluded; a symbol without one is escaped to, then coded `onward`."""
        kinds = (n > 0).sum(axis=1)
        whole = np.maximum(n.sum(axis=1) + kinds, 1)
        escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
        return np.where(n > 0, -np.log2(np.maximum(n, 1) / whole[:, None]), escape[:, None] + onward)

    for level, (first, last) in enumerate(pairwise(ends)):
        for start in range(first, last, CONTEXTS):
            here = slice(start, min(start + CONTEXTS, last))
            own, up = counts[here], shorter[here]
            onward = bits(np.where(own > 0, 0, counts[up]), rest[up]) if level else np.log2(np.maximum(256 - (own > 0).sum(axis=1), 1))[:, None]
            onward = onward.astype(counts.dtype)
            if last < len(length):
                rest[here] = onward
            cost[here] = bits(own, onward)


def tables_of(model: Model, first: int, last: int) -> Tables:
    """The automaton and the costs of the languages first to last - 1."""
    own = [slice(model.starts[k], model.starts[k + 1]) for k in range(first, last)]
    states = np.unique(np.concatenate([np.ones(1, np.int64), *[model.grams[part] >> 8 for part in own]]))
    for _ in range(model.order):
        states = np.union1d(states, _shorter(states))  # shorter contexts have smaller numbers
    length, shorter, symbols = _lengths(states), np.searchsorted(states, _shorter(states)), model.symbol_of[states & 255]
    before = np.searchsorted(states, states >> 8)
    reached = (length > 0) & (symbols > 0) & (states[before] == states >> 8)
    width = int(model.symbol_of.max()) + 1
    following = np.zeros((len(states), width), np.int32)
    for level in range(model.order + 1):
        here = np.flatnonzero(length == level)
        if level:
            following[here] = following[shorter[here]]
        to = np.flatnonzero((length == level + 1) & reached)
        following[before[to], symbols[to]] = to
    cost = np.empty((len(states), width, last - first), np.float32)
    for k, part in enumerate(own):
        counts = np.zeros((len(states), width), np.float32)
        counts[np.searchsorted(states, model.grams[part] >> 8), model.symbol_of[model.grams[part] & 255]] = model.n[part]
        _costs(counts, length, shorter, cost[:, :, k])
    return Tables(first, last, following * np.int32(width), cost)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    # not a comprehension: its variable would hold a group's tables while the next are made
    parts = list(map(lambda tables: _lengths_in(model, tables, texts), model.groups()))
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(texts), 0))


def _lengths_in(model: Model, tables: Tables, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language of the tables."""
    n_langs = tables.last - tables.first
    following, cost = tables.following, tables.cost.reshape(-1, n_langs)
    out = np.zeros((len(texts), n_langs))
    lead = model.order
    owners, pieces, skips = [], [], []
    for k, text in enumerate(texts):
        for start in range(0, len(text), PIECE):
            begin = max(0, start - lead)
            owners.append(k)
            pieces.append(text[begin : start + PIECE])
            skips.append(start - begin)
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    for block in np.array_split(order, max(1, len(order) // 1024)) if len(order) else []:
        lengths = np.array([len(pieces[i]) for i in block])
        grid = np.zeros((lengths[0], len(block)), np.uint8)
        for j, i in enumerate(block):
            grid[: lengths[j], j] = np.frombuffer(pieces[i], np.uint8)
        symbols = model.symbol_of[grid]
        skip = np.array([skips[i] for i in block])
        place = np.zeros(len(block), np.int64)  # of the state's first symbol
        sums = np.zeros((len(block), n_langs))
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # pieces longer than t
        for t in range(lengths[0]):
            n = live[t]
            at = place[:n] + symbols[t, :n]
            bits = cost.take(at, axis=0)
            if t < lead:
                bits = bits * (skip[:n] <= t)[:, None]
            sums[:n] += bits
            place[:n] = following.take(at)
        np.add.at(out, [owners[i] for i in block], sums)
    return out


def train(labelled: DataFrame, order: int = 4, sample_docs: int = 150) -> Model:
    """labelled(doc_id, text, lang) -> Model, from at most about `sample_docs` documents of each language."""
    return build(ngram_counts(sample_of(labelled, sample_docs), order).toArrow(), order)


def slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts: SLICE at most, and of more than one no more than SLICE_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (k - start == SLICE or held + size > SLICE_BYTES):
            yield slice(start, k)
            start, held = k, 0
        held += size
    if len(sizes):
        yield slice(start, len(sizes))


def scored(model: Model, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For batches of texts, structs of lang_pred, score and bits_per_byte; one group's tables are held at a time, none between batches."""
    names = np.array([*model.langs, "und"], object)
    for texts in batches:
        texts = texts.cast(pa.large_binary())
        runs = list(slices(texts))
        fine, size = np.zeros(len(texts), bool), np.ones(len(texts))
        best, least, sums = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.zeros(len(texts))
        for part in runs:
            raw = texts[part].to_pylist()
            fine[part] = [bool(model.langs) and has_letter(x and x.decode("utf-8", "replace")) for x in raw]
            size[part] = [max(len(x or b""), 1) for x in raw]
        for tables in model.groups():
            for part in runs:
                bits = _lengths_in(model, tables, [x if ok else b"" for x, ok in zip(texts[part].to_pylist(), fine[part], strict=True)])
                now = np.minimum(least[part], bits.min(axis=1))
                best[part] = np.where(now < least[part], tables.first + bits.argmin(axis=1), best[part])
                # sums holds 2 to the power of (least - bits), summed over the languages so far
                sums[part] = sums[part] * np.exp2(np.maximum(now - least[part], -1000)) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(axis=1)
                least[part] = now
            del tables
        score, rate = 1 / np.maximum(sums, 1), np.where(fine, least, 0.0) / size
        found = {"lang_pred": pa.array(names[np.where(fine, best, -1)], pa.string()), "score": np.where(fine, score, 0.0), "bits_per_byte": rate}
        yield pa.StructArray.from_arrays([pa.array(x) for x in found.values()], list(found))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (posterior of lang_pred under equal priors) and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(shared.value, parts)

    # not deterministic for the optimizer: else a filter on the result would have each text scored twice
    marked = F.arrow_udf(predict, "lang_pred string, score double, bits_per_byte double").asNondeterministic()
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    return docs.select(*columns, marked("text").alias("_p")).select(*columns, "_p.lang_pred", "_p.score", "_p.bits_per_byte")


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_part(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_part(docs))
    rows = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def known_language(docs: DataFrame) -> DataFrame:
    """documents with a language found in their text, lang set to it; those without (`und`) go."""
    docs = with_columns_of(docs)
    rows = identify(docs, train(labelled_part(docs)))
    return rows.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)
