"""Substring removal, role repair and fill-in-the-middle against brute force, on small tables with every defined case."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.llm import fim, roles, substrings

DOCS = "doc_id long, text string, m long, spans int, shard int"


def _covered(rows, window=20):
    """doc_id and text of rows -> the words left of each, by comparing all windows."""
    first = {}
    words = [(i, (t or "").split()) for i, t in rows]
    far = lambda i: (i is None, i or 0)
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (far(i), k)), (far(i), k))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (far(i), k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.fixture(scope="module")
def passages(spark):
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(r.choices(words, k=n))
    common, passage, tiny = say(60), say(35), say(20)
    rows = [(0, None), (1, ""), (2, "one two"), (3, tiny), (4, tiny), (5, f"{tiny} x"), (6, say(6000)), (7, "a b " * 60), (8, "a " * 90), (9, "b a " * 30), (10, " \t\n" + say(25) + "\x0b")]
    rows += [(100 + k, f"{say(r.randrange(40))} {common} {say(r.randrange(40))}") for k in range(700)]
    rows += [(20 + k, f"{say(k)} {passage if k % 2 else passage[5:]} {say(9)} {passage}") for k in range(30)]
    edited = say(120).split()
    for k in range(25):
        edited[r.randrange(120)] = f"edit{k}"
        rows.append((60 + k, " ".join(edited)))
    rows += [(None, common), (None, common), (-5, passage), (6, say(40)), (4, tiny), (200, rows[20][1].replace(" ", "\n"))]
    r.shuffle(rows)
    return rows


def test_repeated_passages(spark, passages):
    df = spark.createDataFrame([(*x, 1, 1, 1) for x in passages], DOCS).repartition(5)
    key = lambda x: (str(x[0]), *x[1:])
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.text or "") for x in substrings.without_repeats(df).collect()), key=key)
    assert got == sorted(_covered(passages), key=key)
    assert [x.text for x in substrings.without_repeats(df.where("doc_id = 0")).collect()] == [None]
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_widespread_runs_change_nothing_but_the_dealing(spark, passages):
    df = spark.createDataFrame([(*x, 1, 1, 1) for x in passages], DOCS).repartition(5)
    late = substrings.widespread(df.withColumn("doc_id", F.col("doc_id")))
    every = np.sort(substrings.runs(substrings.hashed(" ".join(t for _, t in passages if t).encode().split(), substrings._Hashes()), substrings.GRAM)[0] >> np.uint64(1))[::3]
    marks = lambda x: {(r.doc_id, r.th, r.at + k) for r in substrings.repeated(substrings.pieces(df, 20, x)).where("later").collect() for k in range(r.n)}
    assert len(late) < len(every)
    assert substrings.repeated(substrings.pieces(df, 20, every)).where("m < 0").count() > 0
    plain, dealt = marks(np.zeros(0, np.uint64)), marks(every)
    assert plain & dealt  # later pieces differ by the cut, their windows are all repeated ones
    starts = {(i, k) for i, t in passages for k in range(len((t or "").split()))}
    assert {(i, k) for i, _, k in plain | dealt} <= starts


def test_fm_index_against_search():
    r = np.random.default_rng(5)
    for symbols in (1, 2, 5, 300):
        parts = [r.integers(1, symbols + 1, n) for n in r.integers(1, 60, 40)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = substrings.FMIndex(text)
        values, at = index.bwt.read(np.arange(len(text)))
        assert np.array_equal(index.locate(np.arange(len(text)))[index.first[1] :] >= 0, np.ones(len(text) - index.first[1], bool))
        ends = np.flatnonzero(text)
        ends = ends[[k for k, e in enumerate(ends) if e >= 4 and 0 not in text[e - 4 : e + 1]]]
        length, low, high = index.matches(text, ends, 5)
        where = {}
        for n in range(1, 6):
            for k in range(len(text) - n + 1):
                if 0 not in text[k : k + n]:
                    where.setdefault(tuple(text[k : k + n].tolist()), []).append(k)
        want = [next((n for n in range(5, 0, -1) if len(where[tuple(text[e - n + 1 : e + 1].tolist())]) > 1), 0) for e in ends]
        assert length.tolist() == want
        full = np.flatnonzero(length == 5)
        for k, a, b in zip(full, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == where[tuple(text[ends[k] - 4 : ends[k] + 1].tolist())]


def _best(rows):
    """rows of (initial, fault) -> (cost, audit) by trying all edits."""
    found = []

    def go(k, said, cost, audit):
        if found and cost > min(found)[0]:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", said):
                found.append((cost, audit))
        else:
            initial, fault = rows[k]
            more = fault == 3
            go(k + 1, said, cost + 3, audit + "D")
            if fault not in (1, 2):
                go(k + 1, said + initial, cost + more, audit + "K")
                for t in "ua":
                    go(k + 1, said + t, cost + 2 + more, audit + "R")
        if audit[-2:] != "II" and re.fullmatch("s?(ua)*u?", said):
            for t in "ua":
                go(k, said + t, cost + 2, audit + "I")

    go(0, "", 0, "")
    return min(found)


def test_repair_is_the_cheapest():
    r = random.Random(2)
    cases = [list(x) for n in range(4) for x in itertools.product("sua", repeat=n)]
    cases = [[(c, r.choice((0, 0, 3, 1, 2))) for c in x] for x in cases] + [[(r.choice("suauat "), r.choice((0, 0, 0, 3, 1, 2))) for _ in range(r.randrange(4, 7))] for _ in range(120)]
    for rows in cases:
        state, edits = roles.Repair(settle=2), []
        for c, fault in rows:
            edits += state.add({"s": "system", "u": "user", "a": "assistant", "t": "tool"}.get(c, c), "x", fault)
        edits += state.close()
        assert (state.cost, "".join(e[0] for e in edits)) == _best(rows), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(e[1][0] for e in edits if e[0] != "D"))


def test_repaired_conversations(spark):
    r = random.Random(4)
    texts = ["Yes.", "No", " ", "", None, "Why?", "long " * 3000 + ".", "a. b! c", "same."]
    rows = [(k // 9 if k % 50 else None, r.choice((None, *range(8))), r.choice(("user", "assistant", "system", "tool", None, "")), r.choice(texts), 1) for k in range(500)]
    rows += [(900, k, ("user", "assistant")[k % 2], f"turn {k}.", 1) for k in range(3000)] + rows[:20] + [(901, 1 << 40, "user", "x.", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault int").repartition(4)
    got = {x.conv_id: x for x in roles.digests(roles.repaired(roles.faults(roles.damaged(df)))).collect()}
    blank = lambda x: " " if x is None else x
    talks = {}
    for conv, turn, role, text, _ in rows:
        k = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", blank(text)) if k == 2 else blank(text)
        talks.setdefault(conv, []).extend([(turn, "user" if k == 4 else blank(role), text)] * {0: 0, 3: 2}.get(k, 1))
    assert got.keys() == talks.keys()
    for conv, talk in talks.items():
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, kinds = set(), []
        for _, role, text in talk:
            bare = text.strip(" \t\n\x0b\f\r")
            kinds.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, _, _ in talk if t is not None]
        state, edits = roles.Repair(settle=10**9), []
        for (_, role, text), kind in zip(talk, kinds, strict=True):
            edits += state.add(role, text, kind)
        edits += state.close()
        said = "\n".join(f"{role}:{text}" for e, role, text in edits if e != "D")
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(talk)]
        want = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs),
            state.cost, "".join(e[0] for e in edits), hashlib.sha256(said.encode()).hexdigest(),
        )
        assert tuple(got[conv])[1:] == want, conv
    assert roles.digests(roles.repaired(roles.faults(roles.damaged(df.limit(0))))).count() == 0


def test_fill_in_middle(spark, tmp_path):
    r = random.Random(8)
    odd = ["é", "日本", "<P", "S>", "<", "a", " ", "\t", "\n\n", " ", " "]
    rows = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "x <M> y"), (None, "b c d"), (5, "z" * 300000), (6, "w " * 40000), (2, " ")]
    rows += [(k, "".join(r.choices(odd, k=r.randrange(1, 60)))) for k in range(10, 200)]
    df = spark.createDataFrame([(*x, 1, None, 1) for x in rows], "doc_id long, text string, n int, frames string, form int").repartition(3)
    path = str(tmp_path / "store")
    fim.frame_store(df, frame_units=7).write.parquet(path)
    store = spark.read.parquet(path)
    out = fim.fill_in_middle(store)
    texts = {(x.doc_id, hashlib.sha256(b"".join(fim.Frames(x.frames, x.bytes).read())).hexdigest()) for x in out.collect()}
    got = sorted((tuple(x) for x in fim.digests(out).collect()), key=str)
    want = []
    for i, text in rows:
        raw = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", raw)
        n, digest = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not raw or any(m in raw for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
        form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
        made = {"plain": raw, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (made, raw)]
        want.append((i, n, form, *((None, None) if plain else (len(pre), len(mid))), *sha))
        assert (i, sha[0]) in texts
    assert got == sorted(want, key=str)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    assert fim.digests(fim.fill_in_middle(fim.frame_store(df.limit(0)))).count() == 0
    other = fim.fill_in_middle(store, seed=7, rate=100)
    assert {x[6] for x in fim.digests(other).collect()} == {x[6] for x in want}
