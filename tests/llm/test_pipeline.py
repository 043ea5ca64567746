"""The pipeline's stages, one by one, against brute force on a small table."""

import hashlib
import random

import pytest

import corpus_pipeline
from patchlens.llm import langid, mixing, packing, pii
from patchlens.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_operators import _feistel, brute_language, piece_by_piece

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = {"en": [f"the{k}" for k in range(100)], "fr": [f"été{k}" for k in range(100)]}
    rows = []
    for k in range(60):
        lang = ("en", "fr")[k % 3 == 0]
        rows.append([k, " ".join(r.choices(words[lang], k=r.choice([8, 60, 200]))), lang, f"s{k % 4 == 0}", 1])
    for k in range(20):
        text = rows[k][1].split()
        text[r.randrange(len(text))] = "edit"
        rows.append([100 + k, " ".join(text), None, "s", 1])
    rows += [[200, rows[5][1], "en", "s", 1], [201, None, "en", "s", 1], [202, "", None, None, 0], [203, "123 ½", "en", "s", 1], [204, "ask abcdef@mail.example the1 the2", "en", "s", 1]]
    rows += [[None, rows[6][1], "en", "s", 1], [205, "the1 " * 9000, "en", "big", 1], [206, "the7 the9", None, "s", 1], [206, "the7 the9", None, "s", 1]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(x) for x in rows], KIND).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_against_brute_force(spark, folder):
    key = "secret of the test"
    spark.conf.set("patchlens.pii.key", key)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, frame):
        rows = [tuple(x) for x in stages[name](spark, frame, folder).select(*DOCUMENT_COLUMNS).collect()]
        return rows, spark.createDataFrame(rows, KIND)

    before = [tuple(x) for x in docs.collect()]
    model = langid.train(langid.labelled_part(docs))
    rows, docs = after("language ID", docs)
    want = []
    for x in before:
        if x[1] and any(c.isalpha() for c in x[1]):
            bits = brute_language(model, x[1].encode()[:3000]) if len(x[1]) > 3000 else brute_language(model, x[1].encode())
            want.append((x[0], x[1], model.langs[bits.index(min(bits))], *x[3:]))
    assert sorted(map(str, rows)) == sorted(map(str, want))

    before = rows
    rows, docs = after("MinHash near-dedup", docs)
    sets = []
    for x in before:
        w = x[1].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})
    label = list(range(len(before)))
    for _ in before:
        for a in range(len(before)):
            for b in range(len(before)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for x, g in zip(before, label, strict=True):
        groups.setdefault(g, []).append(x)
    assert len(rows) == len(groups) and len(groups) < len(before)
    for group in groups.values():
        inside = [x for x in rows if x in group]
        assert len(inside) == 1 and str(inside[0][0]) == str(min((x[0] for x in group if x[0] is not None), default=None))

    before = rows
    rows, docs = after("PII", docs)
    name = _feistel("abcdef", key, "email")
    assert sorted(map(str, rows)) == sorted(str((x[0], x[1].replace("abcdef@", f"{name}@"), *x[2:4], len(x[1]))) for x in before)

    before = rows
    rows, docs = after("mixing", docs)
    cells, cell_of = {}, {}
    for x in before:
        topic = "record" if "@" in x[1] or any(w[:3].isdigit() for w in x[1].split()) else "prose"
        cell_of[x] = (x[3] or "unknown", x[2], topic)
        cells[cell_of[x]] = cells.get(cell_of[x], 0) + len(x[1].split())
    weight, total = dict(cells), sum(cells.values())
    for _ in range(mixing.MOST_ROUNDS):
        for m in range(3):
            had, got = {}, {}
            for c, n in cells.items():
                had[c[m]], got[c[m]] = had.get(c[m], 0) + n, got.get(c[m], 0) + weight[c]
            whole = sum(n**0.7 for n in had.values())
            weight = {c: w * had[c[m]] ** 0.7 / whole * total / got[c[m]] for c, w in weight.items()}
    want = []
    for x in before:
        wanted = weight[cell_of[x]] / cells[cell_of[x]]
        draw = int(hashlib.md5(f"mix:{'null' if x[0] is None else x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 16**12
        want += [x] * (int(wanted) + (draw < wanted - int(wanted)))
    assert sorted(map(str, rows)) == sorted(map(str, want)) and rows

    before = rows
    placed = stages["packing"](spark, docs, folder).collect()
    pieces = []
    for x in before:
        n = len(x[1].split())
        pieces += [packing.SIZES[-1]] * (n // packing.SIZES[-1]) + [n % packing.SIZES[-1]] * (n % packing.SIZES[-1] > 0)
    bins = piece_by_piece(pieces, packing.SIZES)
    assert len(placed) == len(pieces) and sum(x.n_tokens for x in placed) == sum(pieces)
    assert {x.bin_id: (x.bin_tokens, x.bin_size) for x in placed} == {k: (used, min(s for s in packing.SIZES if s >= used)) for k, (used, _) in enumerate(bins)}


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 30 and {"doc_id", "bin_id", "bin_size"} <= set(out.columns)
    empty = spark.createDataFrame([], KIND + ", _tokens int, row string, found int, label int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, empty, "")
        assert kept.columns == DOCUMENT_COLUMNS and kept.count() == 0
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pii.session_key(spark)
