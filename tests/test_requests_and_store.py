"""Options as data, stores of reports and repeated appends."""

import random

import pytest
from pyspark.sql import functions as F

from patchlens.operators.packet import review
from patchlens.operators.requests import globs_pattern, review_requests, with_options
from patchlens.operators.rules import Options
from patchlens.sinks.store import append_once, prune, read_store, runs, summaries_to, write_report_store, write_store
from patchlens.sources.patches import stream_patches
from patchlens.streaming.review import append_to, request_stream, review_stream
from tests.test_large import one_file

FIGURES = ["patch_id", "language", "order", "n_files", "n_ignored", "minutes", "over_budget", "score", "label", "gate_failed", "headline", "lede", "generated_at", "files", "findings", "clusters"]


def _text(seed):
    r = random.Random(seed)
    names = ["src/api/index.ts", "src/auth/login.py", "docs/a.md", "package-lock.json", "test/login.test.ts", "src/core/engine.ts"]
    return "".join(one_file(p, *["x"] * r.randrange(40), *["eval(x)"] * r.randrange(2)) for p in r.sample(names, 5))


def test_each_patch_by_its_own_options(spark):
    sets = [
        Options(now="a"), Options(lang="pt", order="risk", budget_minutes=1, ignore=("docs/**",), fail_on="high", now="b"), Options(large_file_lines=10, test_gap_lines=1, fail_on="low", now="c"),
        Options(ignore=("**",), now="d", lang="pt"), Options(order="risk", ignore=("src/*/*.ts", "*.json"), budget_minutes=0, fail_on="info", now="e"),
    ]
    texts = [(str(k), _text(k)) for k in range(len(sets))]
    patches = spark.createDataFrame([*texts, ("none", _text(9))], "patch_id string, text string")
    kinds = "patch_id string, lang string, order string, large_file_lines double, test_gap_lines double, budget_minutes double, ignore array<string>, fail_on string, now string"
    rows = [(str(k), {"pt": "PT-BR"}.get(o.lang, o.lang), o.order, float(o.large_file_lines), float(o.test_gap_lines), None if o.budget_minutes is None else float(o.budget_minutes), list(o.ignore), o.fail_on, o.now) for k, o in enumerate(sets)]
    table = spark.createDataFrame(rows, kinds)
    got = {x.patch_id: x for x in review_requests(patches, table).select(*FIGURES).collect()}
    for k, o in enumerate(sets):
        alone = review(patches.where(F.col("patch_id") == str(k)), o).select(*FIGURES).first()
        assert got[str(k)] == alone, k
    assert (got["none"].language, got["none"].order, got["none"].gate_failed) == ("en", "story", False)
    odd = with_options(patches.withColumns({"lang": F.lit("xx"), "order": F.lit("up"), "budget_minutes": F.lit(-1.0), "fail_on": F.lit(None).cast("string"), "extra": F.lit(1)})).select("options.*").first()
    assert (odd.lang, odd.order, odd.budget_minutes, odd.fail_on, odd.large_file_lines, odd.ignore) == ("en", "story", None, "none", 400.0, None)


def test_globs_as_one_pattern(spark):
    rows = [(["docs/**", "a?c"], "docs/x/y.md", True), (["a?c"], "abc", False), (["*.md"], "a/b.md", False), (["**/*.snap"], "x.snap", True), (["a/**/b"], "a/b", True), (["a\\Eb*"], "a\\Ebc", True), ([None], "x", None), ([], "x", None), (["x", None, "y"], "y", True), (["[a]{b}"], "[a]{b}", True)]
    got = spark.createDataFrame(rows, "g array<string>, p string, w boolean").select(F.rlike("p", globs_pattern(F.col("g"))).alias("r"), "w").collect()
    assert [x.r for x in got] == [x.w for x in got]


def test_a_stream_of_requests(spark, tmp_path):
    rows = [("p", _text(1), "pt", "risk"), ("q", _text(2), None, None)]
    frame = spark.createDataFrame(rows, "patch_id string, text string, lang string, order string")
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    request_stream(source, append_to(str(tmp_path / "out")), str(tmp_path / "check"), once=True).awaitTermination(200)
    got = {x.patch_id: (x.language, x.order, x.score) for x in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {x.patch_id: (x.language, x.order, x.score) for x in review_requests(frame).collect()}


def test_many_reports_in_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(100_000).select(F.format_string("p%06d", F.col("id")).alias("patch_id"), F.lit("md").alias("format"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("body"))
    rows = rows.unionByName(rows.where("patch_id = 'p000007'").withColumn("format", F.lit("text")))
    assert write_store(rows, path, files=5) == "run-00000001"
    assert len(list((tmp_path / "store" / "run-00000001" / "data").glob("part-*.parquet"))) <= 5
    assert {(x.format, x.body) for x in read_store(spark, path, "p000007").collect()} == {("md", "body 7"), ("text", "body 7")}
    for k in (0, 31_337, 99_999):
        one = read_store(spark, path, f"p{k:06d}")
        assert len(one.inputFiles()) == 1 and [x.body for x in one.collect()] == [f"body {k}"]
    assert read_store(spark, path, "p5").count() == 0 and read_store(spark, path).count() == 100_001
    # a job that dies half-way leaves the run before it
    broken = rows.withColumn("body", F.when(F.col("patch_id") == "p050000", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        write_store(broken, path, files=3)
    assert runs(spark, path) == ["run-00000001"] and read_store(spark, path, "p000001").first().body == "body 1"
    write_store(rows.withColumn("body", F.lit("new")), path, files=3)
    prune(spark, path)
    assert runs(spark, path) == ["run-00000002"] and read_store(spark, path, "p000001").first().body == "new"
    assert [p.name for p in (tmp_path / "store").iterdir() if p.is_dir()] == ["run-00000002"]


def test_a_batch_that_is_repeated_is_there_once(spark, tmp_path):
    patches = spark.createDataFrame([("p", _text(3)), ("q", _text(4))], "patch_id string, text string")
    path = str(tmp_path / "sum")
    rows = review(patches, Options(now="n"))
    sink = summaries_to(path)
    sink(rows, 4)
    sink(rows, 4)
    assert spark.read.text(path).where("value like '# %'").count() == 2
    assert append_once(rows.selectExpr("patch_id as value"), path, "other") and not append_once(rows.selectExpr("patch_id as value"), path, "other")
    # a stream that forgets that its batch went out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.patch").write_text(_text(5))
    for _ in range(2):
        review_stream(stream_patches(spark, str(tmp_path / "in")), summaries_to(str(tmp_path / "stream")), str(tmp_path / "check"), Options(now="n"), once=True).awaitTermination(200)
        for commit in (tmp_path / "check" / "commits").iterdir():
            commit.unlink()
    assert spark.read.text(str(tmp_path / "stream")).where("value like '# %'").count() == 1
    store = str(tmp_path / "reports")
    write_report_store(rows, store, ("md", "json"))
    assert {x.format for x in read_store(spark, store, "q").collect()} == {"md", "json"}
