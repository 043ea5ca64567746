"""Chat formatting in budgeted windows.

A conversation's turns are laid out in a template that marks each turn; control strings inside texts are escaped so that
they can be read back. Where a conversation exceeds the token budget it is cut between turns into windows: running sums of
turn tokens choose the longest span that fits, every window begins with the system turn, then repeats a few turns of
history within a limit of their own, then holds new turns. Loss spans cover the assistant texts that are new in a window;
repeated ones are masked, so each assistant text is a target exactly once.

Turns are dealt by conversation and sorted within partitions, and windows are emitted while rows stream by: a task holds
one window, never a whole conversation.

Defined cases: a null text is empty, a null role is the empty role, a null conversation id is a conversation of its own;
turns with one number are ordered by role and text; repeated rows are repeated turns; a turn that exceeds the budget by
itself has a window of its own, whole; an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import table

#: Fixed strings of the template. Inside texts each gets the escape character after its first character.
BEGIN, TEXT, END = "<s>[INST:", "]\n", "[/INST]</s>\n"
CONTROL = ["<s>", "</s>", "[INST", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, sorted([*CONTROL, ESCAPE], key=len, reverse=True))))
WINDOW_KIND = "conv_id long, window int, first_turn int, n_turns int, n_repeated int, over_budget boolean, text string, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def n_tokens(text: str) -> int:
    """An estimate: a token for every four bytes, and three for the turn's marks."""
    return len(text.encode("utf-8", "replace")) // 4 + 4


def render(role: str, text: str) -> str:
    return BEGIN + escape(role).replace("]", ESCAPE + "]") + TEXT + escape(text) + END


def parse(text: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, where the escaped text starts) of each turn of a window."""
    at = 0
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        mid = re.compile(r"(?<!\\)(?:\\\\)*\]\n").search(text, at + len(BEGIN))
        stop = text.index(END, mid.end())
        yield unescape(text[at + len(BEGIN) : mid.end() - len(TEXT)]), unescape(text[mid.end() : stop]), mid.end()
        at = stop + len(END)


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str] | None = None
        self.turns: list[tuple[str, str, int]] = []  # of the window: repeated ones, then new ones
        self.repeated, self.seen, self.number, self.used = 0, 0, 0, 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = n_tokens(text)
        if self.turns[self.repeated :] and self.used + size > self.budget:
            yield self.close()
            lead = [(*self.system, n_tokens(self.system[1]))] if self.system else []
            tail, room = [], self.history
            for turn in reversed(self.turns[self.repeated :]):
                if turn[2] > room or turn[0] == "system":
                    break
                room -= turn[2]
                tail.append(turn)
            keep = lead + tail[::-1]
            while len(keep) > len(lead) and sum(t[2] for t in keep) + size > self.budget:  # a long new turn takes the history's room
                keep.pop(len(lead))
            self.turns, self.repeated, self.used = keep, len(keep), sum(t[2] for t in keep)
        if role == "system" and self.seen == 0:
            self.system = (role, text)
        self.turns.append((role, text, size))
        self.used += size
        self.seen += 1

    def close(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(self.turns):
            part = render(role, text)
            if role == "assistant" and k >= self.repeated and text:
                starts.append(at + part.index(TEXT) + len(TEXT))
                ends.append(at + len(part) - len(END))
            parts.append(part)
            at += len(part)
        new = len(self.turns) - self.repeated
        self.number += 1
        return (self.conv_id, self.number - 1, self.seen - new, len(self.turns), self.repeated, self.used > self.budget, "".join(parts), starts, ends)


def windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row for each window, those of a conversation in order and in one partition."""

    def layout(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = None, []
        names = [x.split()[0] for x in WINDOW_KIND.split(", ")]
        for part in parts:
            for conv, role, text in part.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state.conv_id != conv:
                    if state is not None:
                        out.append(state.close())
                    state = _Windows(conv, budget, history)
                out += state.add(role or "", text or "")
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        if state is not None:
            yield pd.DataFrame([state.close()], columns=names).astype({"conv_id": "Int64"})

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text").mapInPandas(layout, WINDOW_KIND)


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: a row for each conversation. Windows of one must lie together and in order, as `windows` leaves them."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []

        def done() -> tuple:
            conv, n, turns, chars, loss, size, count = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        for part in parts:
            for conv, repeated, text, starts, ends in part.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for k, (role, said, _) in enumerate(parse(text)):
                    if k >= repeated:
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "replace"))
                now[5] += len(text)
                now[6] += 1
            yield pd.DataFrame(out, columns=DIGEST_NAMES).astype({"conv_id": "Int64"})
            out = []
        if now is not None:
            yield pd.DataFrame([done()], columns=DIGEST_NAMES).astype({"conv_id": "Int64"})

    return formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "n_repeated", "text", "loss_start", "loss_end").mapInPandas(read, DIGEST_KIND)


DIGEST_KIND = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
DIGEST_NAMES = [x.split()[0] for x in DIGEST_KIND.split(", ")]


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    return digests(windows(turns.unionByName(extra)))


def _oracle(budget: int = 512, history: int = 128) -> str:
    """DuckDB SQL for op6: turns in order, then a recursion over a conversation's turns that closes windows by prefix sums.

    c has a row for each conversation, with lists that start with a 0: toks[k + 1] and chars[k + 1] are the sums of its first k turns.
    A window's history is the longest run of turns before the next one that the limits allow, so it begins at one turn, t.
    """
    control = "|".join(map(re.escape, sorted([*CONTROL, ESCAPE], key=len, reverse=True)))
    escapes = lambda x: f"len(regexp_extract_all({x}, '{control}'))"
    return f"""
WITH RECURSIVE turns AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) e(k, role))),
sized AS (SELECT *, strlen(text) // 4 + 4 AS tok, {len(BEGIN + TEXT + END)} + length(role) + {escapes("role")} + len(regexp_extract_all(role, '\\]')) + length(text) + {escapes("text")} AS width FROM turns),
summed AS (SELECT *, sum(tok) OVER w AS toks, sum(width) OVER w AS chars FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n, list(role ORDER BY i) AS roles, [0] || list(toks::BIGINT ORDER BY i) AS toks, [0] || list(chars::BIGINT ORDER BY i) AS chars,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM summed GROUP BY conv_id),
steps AS (SELECT conv_id, 0::BIGINT AS i, 1::BIGINT AS s, 0::BIGINT AS used, 0::BIGINT AS extra, 0::BIGINT AS closed FROM c
  UNION ALL SELECT conv_id, i + 1, CASE WHEN over THEN i + 1 ELSE s END, CASE WHEN over THEN lead_toks + toks[i + 1] - toks[t] ELSE used END + z,
    extra + CASE WHEN over THEN lead_chars + chars[i + 1] - chars[t] ELSE 0 END, closed + CASE WHEN over THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(list_min(list_filter(range(s, i + 1), lambda x: NOT list_contains(roles[x:i], 'system') AND toks[i + 1] - toks[x] <= least({history}, {budget} - lead_toks - z))), i + 1) AS t
    FROM (SELECT steps.*, roles, toks, chars, toks[i + 2] - toks[i + 1] AS z, s <= i AND used + toks[i + 2] - toks[i + 1] > {budget} AS over,
        CASE WHEN roles[1] = 'system' THEN toks[2] ELSE 0 END AS lead_toks, CASE WHEN roles[1] = 'system' THEN chars[2] ELSE 0 END AS lead_chars
      FROM steps JOIN c ON c.conv_id IS NOT DISTINCT FROM steps.conv_id WHERE i < n)))
SELECT c.conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (chars[n + 1] + extra)::BIGINT AS formatted_chars, (closed + 1)::BIGINT AS n_windows
FROM c JOIN steps ON c.conv_id IS NOT DISTINCT FROM steps.conv_id AND i = n"""


ORACLE_SQL = _oracle()
