"""Repair of the structure of conversations by generalised LR parsing over the role grammar.

    C -> (nothing) | H P        H -> (nothing) | s        P -> u a | P u a

s, u and a are the initials of system, user and assistant. A parser reads each conversation's rows in order and keeps all that
may still become a conversation in a graph-structured stack. Before each row it may insert a user or an assistant turn; the row
is kept, given another role, or deleted. Stacks with equal tops over equal stacks are one, and hold the least (cost, audit) of
those that led there; the audit is the string of the edits' initials. Two audits that met at one top and cost the same are never
one the beginning of the other, as rows are read by K, R and D and an insertion costs; so the least beginning is part of the
least whole, and audits can be compared by a rank, renewed row by row, and the insertions since.

A row is blank, or a duplicate (its role and text were seen earlier in its conversation), or truncated (its last character that
is not blank ends no sentence); the first of these holds. Blank and duplicate rows must be deleted, truncated ones cost more if not.

Rows are dealt by conversation and sorted within partitions, and edits leave while rows stream by: all that every stack agrees on
is settled, so a task holds the rows since then. Duplicates are found by a window over equal rows, beforehand.

Defined cases: a null text or role is one blank, also in the key that damage is drawn from, which makes a blank row and a role of
no initial in the grammar; a null conv_id is a conversation of its own; rows of one turn are ordered by role and text, null turns
come first; repeated rows are duplicates; a conversation without rows has the empty repair; texts may have any length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlens.llm.common import table

#: The parser's tables. State 0 is the start; 1 has read C, 2 H, 3 s, 4 H P, 5 H u, 6 H P u, 7 H u a, 8 H P u a.
SHIFT = {(0, "s"): 3, (2, "u"): 5, (4, "u"): 6, (5, "a"): 7, (6, "a"): 8}
REDUCE = {0: [("H", 0)], 3: [("H", 1)], 7: [("P", 2)], 8: [("P", 3)]}
GOTO = {(0, "H"): 2, (2, "P"): 4}
#: Stacks that C may be read off, at the end.
WHOLE = {(0,), (0, 2, 4)}
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"
EDIT_KIND = "conv_id long, edit string, role string, text string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
EDIT_NAMES = [x.split()[0] for x in EDIT_KIND.split(", ")]
DIGEST_KIND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
DIGEST_NAMES = [x.split()[0] for x in DIGEST_KIND.split(", ")]


@functools.cache
def reduced(stack: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """A stack and all that reductions make of it; without those that only a reduction can follow."""
    out, todo = [], [stack]
    while todo:
        now = todo.pop()
        moves = REDUCE.get(now[-1], [])
        if now[-1] == 0 or not moves:
            out.append(now)
        for left, n in moves:
            below = now[: len(now) - n]
            todo.append((*below, GOTO[below[-1], left]))
    return tuple(out)


@functools.cache
def shifted(stack: tuple[int, ...], terminal: str) -> tuple[tuple[int, ...], ...]:
    to = SHIFT.get((stack[-1], terminal))
    return () if to is None else reduced((*stack, to))


class Repair:
    """One conversation: add() its rows in order, then close(). Both yield edits that are settled, as (edit, role, text)."""

    def __init__(self, settle: int = 64):
        # stack -> cost, rank of the audit up to the last row, edits since, history; a history is (history before, edit, number)
        self.tops: dict[tuple, tuple] = {s: (0, 0, "", None) for s in reduced((0,))}
        self.rows: list[tuple[str, str]] = []  # rows whose edits aren't settled
        self.settled = self.n_out = 0  # edits settled; turns that went out
        self.system = False
        self.settle = self.limit = settle
        self._insert()

    @staticmethod
    def _put(tops: dict, stack: tuple, new: tuple) -> bool:
        old = tops.get(stack)
        if old is None or new[:3] < old[:3]:
            tops[stack] = new
            return True
        return False

    @staticmethod
    def _after(history: tuple | None, edit: str) -> tuple:
        return (history, edit, history[2] + 1 if history else 1)

    def _insert(self) -> None:
        todo = list(self.tops)
        while todo:
            stack = todo.pop()
            cost, rank, since, history = self.tops[stack]
            for t in ROLES:
                for to in shifted(stack, t):
                    if self._put(self.tops, to, (cost + INSERT, rank, since + "I", self._after(history, "I"))):
                        todo.append(to)

    def add(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str, str]]:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        tops: dict[tuple, tuple] = {}
        more = TRUNCATED if fault == 3 else 0
        for stack, (cost, rank, since, history) in self.tops.items():
            self._put(tops, stack, (cost + DELETE, rank, since + "D", self._after(history, "D")))
            if fault in (1, 2):
                continue
            for to in shifted(stack, role[:1]):
                self._put(tops, to, (cost + more, rank, since + "K", self._after(history, "K")))
            for t in ROLES:
                for to in shifted(stack, t):
                    self._put(tops, to, (cost + RENAME + more, rank, since + "R", self._after(history, "R")))
        ranks = {x: k for k, x in enumerate(sorted({t[1:3] for t in tops.values()}))}
        self.tops = {s: (t[0], ranks[t[1:3]], "", t[3]) for s, t in tops.items()}
        self._insert()
        self.rows.append((role, text if fault not in (1, 2) else ""))
        if len(self.rows) >= self.limit:
            yield from self._settle([t[3] for t in self.tops.values()])
            self.limit = max(self.settle, 2 * len(self.rows))

    def _settle(self, histories: list) -> Iterator[tuple[str, str, str]]:
        """The edits that all histories begin with."""
        live = {id(h): h for h in histories}
        while len(live) > 1:  # the longest goes one edit back
            last = max(live.values(), key=lambda h: h[2] if h else 0)
            del live[id(last)]
            live[id(last[0])] = last[0]
        at, edits = next(iter(live.values())), []
        while at is not None and at[2] > self.settled:
            edits.append(at[1])
            at = at[0]
        row = 0
        for edit in reversed(edits):
            role, text = ("", "") if edit == "I" else self.rows[row]
            row += edit != "I"
            if edit != "D":
                self.system |= self.n_out == 0 and edit == "K" and role[:1] == "s"
                if edit != "K":
                    role = ROLES["ua"[(self.n_out - self.system) % 2]]
                self.n_out += 1
            yield edit, role, text
        self.settled += len(edits)
        del self.rows[:row]

    def close(self) -> Iterator[tuple[str, str, str]]:
        self.cost, _, _, history = min(t for s, t in self.tops.items() if s in WHOLE)
        yield from self._settle([history])


class _Conversation(Repair):
    """Repair with what is counted beside it."""

    def __init__(self, conv_id: int | None):
        super().__init__()
        self.conv_id, self.n_rows, self.before, self.illegal, self.counts = conv_id, 0, None, 0, [0, 0, 0, 0]
        self.first: int | None = None
        self.last: int | None = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, fault: int) -> Iterator[tuple]:
        self.n_rows += 1
        self.counts[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        for edit in self.add(role, text, fault):
            yield (self.conv_id, *edit, *[None] * 7)

    def end(self) -> Iterator[tuple]:
        for edit in self.close():
            yield (self.conv_id, *edit, *[None] * 7)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        yield (self.conv_id, None, None, None, self.n_rows, gaps, *self.counts[1:], self.illegal, self.cost)


def damaged(turns: DataFrame) -> DataFrame:
    """turns -> conv_id, turn, role, text, gone: rows dropped (gone is set), emptied, without full stops, repeated or of another role, by CRC-32 of conv_id and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), draw.alias("_draw"))
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_draw") == 0).alias("gone"), "_draw")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_draw", "_copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, gone) with `fault`: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    earlier = Window.partitionBy("conv_id", "role", F.sha2("text", 256), "gone").orderBy(F.col("turn").asc_nulls_first())
    return rows.withColumn("_nth", F.row_number().over(earlier)).withColumn(
        "fault", F.when(F.ltrim(bare, F.lit(BLANKS)) == "", 1).when(F.col("_nth") > 1, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    ).drop("_nth")


def repaired(rows: DataFrame) -> DataFrame:
    """Rows with faults -> EDIT_KIND: the edits of each conversation in order, in one partition, then one row without an edit that has its counts and cost.

    role and text are those of the repaired turn, for D of the row deleted (its text only where it might have stayed).
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = None, []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=EDIT_NAMES)
            out.clear()
            return made.astype({"conv_id": "Int64"} | {c: "Int64" for c in EDIT_NAMES[4:]})

        for part in parts:
            for conv, turn, role, text, gone, fault in part.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state.conv_id != conv:
                    if state is not None:
                        out += state.end()
                    state = _Conversation(conv)
                if not gone:
                    out += state.row(None if pd.isna(turn) else int(turn), role, text, int(fault))
                if len(out) > 5000:
                    yield frame()
            if out:
                yield frame()
        if state is not None:
            out += state.end()
            yield frame()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.select("conv_id", "turn", "role", "text", "gone", "fault").repartition("conv_id").sortWithinPartitions(*order)
    as_text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  pandas would read a long with nulls as a double
    return dealt.select(as_text("conv_id"), as_text("turn"), "role", "text", "gone", "fault").mapInPandas(work, EDIT_KIND)


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit, and the digest of its repaired turns. Edits must lie as repaired() leaves them."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, sha, turns = [], hashlib.sha256(), 0
        for part in parts:
            out = []
            for conv, edit, role, text, n_rows, *counts in part.itertuples(index=False, name=None):
                if edit is None:
                    out.append((None if pd.isna(conv) else int(conv), *map(int, counts), "".join(audit), sha.hexdigest()))
                    audit, sha, turns = [], hashlib.sha256(), 0
                    continue
                audit.append(edit)
                if edit != "D":
                    sha.update((("\n" if turns else "") + f"{role}:{text}").encode("utf-8", "replace"))
                    turns += 1
            yield pd.DataFrame(out, columns=DIGEST_NAMES).astype({"conv_id": "Int64"})

    as_text = [F.col("conv_id").cast("string").alias("conv_id")]
    return edits.select(*as_text, *EDIT_NAMES[1:]).mapInPandas(read, DIGEST_KIND)


def op12_lr_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(repaired(faults(damaged(turns))))


def _oracle() -> str:
    """DuckDB SQL for op12: the grammar as an automaton (e nothing read, s system, u user, p pairs), a recursion over rows.

    Each state holds cost, in nine digits, and audit in one string, so the least string is the least (cost, audit).
    """
    states = "esup"
    plus = lambda x, cost, edit: f"printf('%09d', substr({x}, 1, 9)::BIGINT + {cost}) || substr({x}, 10) || '{edit}'"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    # what an insertion before a row makes of each state: never two in a row, as that is no gain
    inserted = {"e": "e", "s": "s", "u": least("u", *[plus(x, 2, "I") for x in "esp"]), "p": least("p", plus("u", 2, "I"))}
    may = "fault NOT IN ('blank', 'duplicate')"
    keep = lambda x, t: f"CASE WHEN {may} AND init = '{t}' THEN {plus(x, 'more', 'K')} END"
    name = lambda x: f"CASE WHEN {may} THEN {plus(x, '2 + more', 'R')} END"
    after = {
        "e": plus("e", 3, "D"), "s": least(plus("s", 3, "D"), keep("e", "s")),
        "u": least(plus("u", 3, "D"), *[keep(x, "u") for x in "esp"], *[name(x) for x in "esp"]),
        "p": least(plus("p", 3, "D"), keep("u", "a"), name("u")),
    }
    return f"""
WITH RECURSIVE crc_steps AS (SELECT i, i::BIGINT AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_steps WHERE n < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS entry FROM crc_steps WHERE n = 8),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, crc),
rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again FROM drawn WHERE k <> 0),
placed AS MATERIALIZED (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows),
judged AS MATERIALIZED (SELECT *, role[1:1] AS init, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
steps AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS p FROM counted
  UNION ALL SELECT conv_id, i, {", ".join(after[x] for x in states)} FROM (SELECT t.conv_id, j.i, j.init, j.fault, CASE WHEN j.fault = 'truncated' THEN 1 ELSE 0 END AS more,
    {", ".join(f"t.{x} AS {x}" for x in states)} FROM (SELECT conv_id, i, e, s, {inserted["u"]} AS u, {inserted["p"]} AS p FROM steps) t
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.i = t.i + 1)),
ended AS (SELECT c.*, least(e, coalesce({inserted["p"]}, e)) AS best FROM counted c JOIN steps t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.i = c.n),
edits AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, unnest(range(1, length(best) - 8)) AS pos FROM ended),
numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM edits WHERE edit <> ''),
named AS (SELECT m.*, j.role, CASE WHEN edit = 'I' THEN '' ELSE j.text END AS said, max(CASE WHEN o = 1 AND edit = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS sys
  FROM numbered m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.i = m.i),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || said, chr(10) ORDER BY pos) AS whole FROM named WHERE edit <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL = _oracle()
