"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of `FRAME_UNITS` units each (a unit: a word with the blanks before it, or the
blanks at the end) with running sums of units, code points and bytes. A cut after so many units is found in the sums; only the
frame that it falls into is decompressed. The output, with its parts in their new order, is written from frames decompressed one
after the other, again as frames, and is read back the same way: its marks are found, and its parts are streamed in the order of
the text. So beside the compressed frames of a row a task holds one frame decompressed. A store may be written as a table and
read for any number of seeds; nothing is shuffled.

Where a text is cut and in which form it goes out follow from a digest of seed and doc_id. A text that holds a mark stays plain,
so the marks of an output are its own.

Defined cases: a null text is empty; a null doc_id is the empty number; an empty text is plain; rows with one doc_id are cut by
the same draws; repeated rows give repeated rows; a text of any length is cut whole, a single unit of any length is one frame;
an empty table gives an empty one; other columns are ignored. Bytes that are no UTF-8 are kept, and counted as code points where
they don't continue one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import table

FRAME_UNITS, OUT_BYTES, LEVEL = 2048, 1 << 16, 3
#: Fixed marks of an output: before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares in hundredths: of the documents that are transformed, and of those that have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
STORE_KIND = "doc_id long, n long, marked boolean, units array<long>, chars array<long>, bytes array<long>, frames array<binary>"
OUT_KIND = "doc_id long, n long, form string, prefix_chars long, middle_chars long, bytes array<long>, frames array<binary>"
DIGEST_KIND = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_ends(raw: bytes) -> np.ndarray:
    """The byte after each unit."""
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    last = ~blank
    last[:-1] &= blank[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(b)) if len(b) and blank[-1] else ends


def n_chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Frames:
    """Independent compressed frames; ends: bytes of text up to the end of each."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends
        self._open = zstandard.ZstdDecompressor()

    def frame(self, j: int) -> bytes:
        return self._open.decompress(self.frames[j])

    def read(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from start to stop, frame by frame; frames outside stay compressed."""
        stop = (self.ends[-1] if self.ends else 0) if stop is None else stop
        j = int(np.searchsorted(self.ends, start, "right"))
        while start < stop:
            low = self.ends[j - 1] if j else 0
            yield self.frame(j)[start - low : stop - low]
            start, j = self.ends[j], j + 1

    def find(self, *marks: bytes) -> list[int]:
        """Where each mark first stands, -1 for one that doesn't; all are of one length."""
        found, at, tail = dict.fromkeys(marks, -1), 0, b""
        for part in self.read():
            part = tail + part
            for m in marks:
                if found[m] < 0 and (k := part.find(m)) >= 0:
                    found[m] = at + k
            tail = part[len(part) - len(marks[0]) + 1 :] if len(part) >= len(marks[0]) else part
            at += len(part) - len(tail)
        return [found[m] for m in marks]


def packed(chunks: Iterable[bytes], least: int = OUT_BYTES) -> Frames:
    """Chunks as frames of `least` bytes or a little more."""
    press, frames, ends, held, size, at = zstandard.ZstdCompressor(level=LEVEL), [], [], [], 0, 0

    def close() -> None:
        nonlocal size, at
        at += size
        frames.append(press.compress(b"".join(held)))
        ends.append(at)
        held.clear()
        size = 0

    for c in chunks:
        held.append(c)
        size += len(c)
        if size >= least:
            close()
    if size:
        close()
    return Frames(frames, ends)


def _rows(batches: Iterator[pa.RecordBatch], work, kind: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """work(row) -> (row, its bytes) for each row, given on in batches of a bounded size."""
    names = [x.split()[0] for x in kind.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, kind.split(", "), strict=True)])
    for batch in batches:
        out, size = [], 0
        for k in range(batch.num_rows):
            row, weight = work(*[c[k].as_py() for c in batch.columns])
            out.append(row)
            size += weight
            if size > most:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def frame_store(docs: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """docs(doc_id, text) -> one row for each, in the columns of STORE_KIND: frames, and how many units, code points and bytes end with each."""

    def build(doc_id: int | None, raw: bytes | None) -> tuple:
        raw = raw or b""
        ends = unit_ends(raw)
        marked = any(m in raw for m in (PREFIX, SUFFIX, MIDDLE))
        last = np.append(np.arange(frame_units, len(ends), frame_units), len(ends)) if len(ends) else np.zeros(0, int)
        stops = ends[last - 1].tolist() if len(ends) else []
        press, parts = zstandard.ZstdCompressor(level=LEVEL), [raw[a:b] for a, b in zip([0, *stops], stops)]
        frames = [press.compress(p) for p in parts]
        return (doc_id, len(ends), marked, last.tolist(), np.cumsum([n_chars(p) for p in parts]).astype(int).tolist(), stops, frames), sum(map(len, frames)) + 100

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(lambda batches: _rows(batches, build, STORE_KIND), STORE_KIND)


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _cut(text: Frames, units: list[int], chars: list[int], at: int) -> tuple[int, int]:
    """Bytes and code points before the end of unit `at`."""
    if at == 0:
        return 0, 0
    j = int(np.searchsorted(units, at))
    if units[j] == at:
        return text.ends[j], chars[j]
    raw = text.frame(j)
    stop = int(unit_ends(raw)[at - (units[j - 1] if j else 0) - 1])
    return (text.ends[j - 1] if j else 0) + stop, (chars[j - 1] if j else 0) + n_chars(raw[:stop])


def fill_in_middle(store: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """A store's rows -> OUT_KIND: the form of each document, the lengths of prefix and middle, and the output as frames."""

    def change(doc_id: int | None, n: int, marked: bool, units: list[int], chars: list[int], ends: list[int], frames: list[bytes]) -> tuple:
        text = Frames(frames, ends)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if n == 0 or marked or h3 % 100 >= rate:
            return (doc_id, n, "plain", None, None, ends, frames), sum(map(len, frames)) + 100
        (a, a_chars), (b, b_chars) = (_cut(text, units, chars, c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < suffix_first else "psm"

        def chunks() -> Iterator[bytes]:
            prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, ends[-1])
            for mark, start, stop in (*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MIDDLE, a, b)):
                yield mark
                yield from text.read(start, stop)

        out = packed(chunks())
        return (doc_id, n, form, a_chars, b_chars - a_chars, out.ends, out.frames), sum(map(len, out.frames)) + 100

    return store.mapInArrow(lambda batches: _rows(batches, change, OUT_KIND), OUT_KIND)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, part by part."""
    if form == "plain":
        yield from output.read()
        return
    marks = [PREFIX, MIDDLE, SUFFIX]  # in the order of the text
    at = output.find(*marks)
    if min(at) < 0:
        raise ValueError(f"an output of form {form} without all its marks")
    for start in at:
        yield from output.read(start + len(PREFIX), min([x for x in at if x > start], default=output.ends[-1]))


def digests(outputs: DataFrame) -> DataFrame:
    """Outputs read back: DIGEST_KIND, the SHA-256 of each output and of the text rebuilt from it."""

    def read(doc_id: int | None, n: int, form: str, prefix: int | None, middle: int | None, ends: list[int], frames: list[bytes]) -> tuple:
        out, one, two = Frames(frames, ends), hashlib.sha256(), hashlib.sha256()
        for part in out.read():
            one.update(part)
        for part in restored(out, form):
            two.update(part)
        return (doc_id, n, form, prefix, middle, one.hexdigest(), two.hexdigest()), 200

    return outputs.mapInArrow(lambda batches: _rows(batches, read, DIGEST_KIND), DIGEST_KIND)


def op13_seekable_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(frame_store(table(spark, sf_dir, "documents"))))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  list_transform(range(0, 4), lambda k: ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), (8 * k + 1)::INT, 8))::UBIGINT) AS h FROM documents),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1))::BIGINT AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
