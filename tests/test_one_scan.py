"""One scan for all patterns: what it finds, and that no pattern is passed by, against each pattern tried on each text.

This module runs as users do, with generated code.
"""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchlens.functions import patterns as P
from patchlens.operators.parse import diff_files
from patchlens.operators.redact import redact_text
from patchlens.operators.rules import assessed
from patchlens.sources.patches import MARKERS

ENDINGS = [".ts", ".py", ".rb", ".go", ".php", ".java", ".rs", ".cs", ".kt", "/Gemfile"]
#: Spellings that the corpus of markers doesn't have, near misses, and parts that overlap.
PIECES = [
    "shell_exec (x)", "proc_open(x)", "popen(x)", "system('x')", 'spawn "x"', "`ls #{x}`", "%x{ls #{x}}", "Open3.capture2e (x)", "exec.CommandContext(x)", "Runtime.getRuntime().exec(x)", "child_process", "execFileSync", "execSync",
    "xeval(x)", "_eval(x)", "éeval(x)", ".exec (x)", "->exec(x)", "$exec(x)", ":system(x)", "dangerouslySetInnerHTML", "xdangerouslySetInnerHTML", "a.innerHTML=1", "AKIAIzaAKIA", "AKIA" * 5, "ghp_" + "a" * 20, "gho_" + "b" * 22, "ghu_short",
    "xoxb-" + "1" * 10, "xoxz-" + "1" * 10, "rk_live_" + "q" * 8, "sk-admin-" + "z" * 20, "sk-svcacct-" + "z" * 20, "sk-ant-sk-proj-" + "y" * 30, "AIza" + "_" * 35, "AIza" + "_" * 36, "npm_" + "0" * 36, "npm_" + "0" * 37,
    "------BEGIN PRIVATE KEY-----", "-----BEGIN XPRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN rsa PRIVATE KEY-----", "new  Function(", "newFunction(", "shell=True", "shell = Truer", "unserialize (x)", "Command::new (x)", "Process.Start(x)",
]


@pytest.fixture(scope="module")
def compiled(spark):
    """The session with generated code, as it is by default."""
    changed = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _texts():
    r = random.Random(7)
    alone = [*PIECES, *[m[3] for m in MARKERS]]
    glue = ["", " ", "x", "_", ".", "\n", "é", "-"]
    return [*alone, "", "plain words", *["".join(x for _ in range(r.randrange(1, 5)) for x in (r.choice(glue), r.choice(alone))) for _ in range(400)]]


def test_a_scan_finds_the_plain_parts(compiled):
    texts = _texts()
    rows = compiled.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: set(r.found) for r in rows.select("k", P.plain_parts(F.col("t")).alias("found")).collect()}
    for k, text in enumerate(texts):
        want = set()
        for at in range(len(text)):
            edge = at == 0 or not re.match("[A-Za-z0-9_]", text[at - 1])
            here = [w for w in P.PLAIN if text.startswith(w, at) and (edge or not w[0].isalnum() or w in P.HTML_PLAIN)]
            want |= {max(here, key=len)} if here else set()
        assert got[k] == want, text


def test_no_pattern_is_passed_by(compiled):
    texts = _texts()
    rows = compiled.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    plain = P.plain_parts(F.col("t"))
    cases = [(n[0], p, w) for n, p, *_, w in P.SECRETS + P.EXECS] + [("html", P.HTML_SINK, P.HTML_PLAIN)]
    lost = [F.count_if(P.matches(F.col("t"), p) & ~P.may_match(plain, w)).alias(n) for n, p, w in cases]
    seen = [F.count_if(P.matches(F.col("t"), p)).alias(f"{n} seen") for n, p, w in cases]
    out = rows.agg(*lost, *seen).first().asDict()
    assert {n: out[n] for n, *_ in cases if out[n]} == {}
    assert all(out[f"{n} seen"] for n, *_ in cases), {n for n, *_ in cases if not out[f"{n} seen"]}


def test_masks_and_findings_are_those_of_every_pattern_tried(compiled):
    texts = _texts()
    rows = compiled.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    all_masks = F.regexp_replace(F.regexp_replace("t", P.KEY_BEGIN, P.KEY_MARK), P.KEY_END, "-----END PRIVATE KEY-----")
    for _, pattern, mask, _ in P.SECRETS:
        if mask != P.KEY_MARK:
            all_masks = F.regexp_replace(all_masks, P.jvm(pattern), mask)
    assert rows.where(~redact_text(F.col("t")).eqNullSafe(all_masks)).count() == 0

    def patch(k, text):
        path = f"src/f{k}{ENDINGS[k % len(ENDINGS)]}"
        lines = text.split("\n")
        return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines)

    patches = compiled.createDataFrame([(k, patch(k, t)) for k, t in enumerate(texts)], "patch_id long, text string")
    files = assessed(diff_files(patches)).where("file_no > 0").select("patch_id", "path", F.transform("findings", lambda f: f["rule_id"]).alias("rules"), F.filter("findings", lambda f: f["rule_id"].isin("secret-pattern", "code-exec")).alias("named"))
    t, path = F.col("t"), F.col("path")
    secrets = F.concat_ws(", ", *[F.when(P.matches(t, p), n[0]) for n, p, *_ in P.SECRETS])
    execs = F.concat_ws(", ", *[F.when((P.matches(path, where) if where else F.lit(True)) & P.matches(t, p), n[0]) for n, p, where, _ in P.EXECS])
    both = files.join(rows, F.col("patch_id") == F.col("k")).select("k", "rules", F.col("named.detail").alias("details"), secrets.alias("s"), execs.alias("e"), P.matches(t, P.HTML_SINK).alias("html")).collect()
    assert len(both) == len(texts)
    for r in both:
        assert (r.s != "") == ("secret-pattern" in r.rules) and (r.e != "") == ("code-exec" in r.rules) and r.html == ("html-sink" in r.rules), texts[r.k]
        assert all(any(names in d for d in r.details) for names in (r.s, r.e) if names), texts[r.k]
