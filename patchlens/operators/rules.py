"""Rules: conditions over files, gathered into findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import patterns as P
from patchlens.functions.patterns import matches, trimmed
from patchlens.functions.steps import Step, applied, built_once
from patchlens.operators.classify import band_of, base_name, cluster_of, covers_named, ignored, is_test, primary_role, roles_of, stem_of
from patchlens.plans.catalog import DETAILS, RULES, SEVERITY_RANK, SURFACES, TITLES


@dataclass(frozen=True)
class Options:
    """What a review may be told. now: the time it bears, as in 2024-05-31T12:00:00Z; by default that of the call."""

    lang: str = "en"
    order: str = "story"
    large_file_lines: float = 400
    test_gap_lines: float = 15
    budget_minutes: float | None = None
    ignore: tuple[str, ...] = field(default_factory=tuple)
    fail_on: str = "none"
    now: str | None = None


#: Options that each patch has itself, in a column `options` (operators.requests makes it).
BY_ROW = Options(lang="row", order="row")


def said(pair: tuple[str, str], lang: str) -> str:
    return pair[lang == "pt"]


def wording(pair: tuple[str, str], lang: str, make: Callable[[str], Column] = F.lit) -> Column:
    """make() of the words in lang, or in that of each row."""
    return F.when(F.col("options.lang") == "pt", make(pair[1])).otherwise(make(pair[0])) if lang == BY_ROW.lang else make(said(pair, lang))


def option(options: Options, name: str) -> Column:
    return F.col(f"options.{name}") if options.lang == BY_ROW.lang else F.lit(getattr(options, name))


def finding(rule: str, lang: str, what: Column | None = None) -> Column:
    """A finding as a struct that sorts by severity, weight (the larger first) and rule. what: stands in title and detail for {}."""
    severity, weight = RULES[rule]

    def filled(text: str) -> Column:
        return F.lit(text) if "{}" not in text else F.concat(*[x for k, part in enumerate(text.split("{}")) for x in ([what] if k else []) + [F.lit(part)]])

    def worded(pair: tuple[str, str]) -> Column:
        return wording(pair, lang, filled)

    return F.struct(
        F.lit(SEVERITY_RANK[severity]).alias("rank"), F.lit(-weight).alias("lead"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"),
        F.lit(weight).alias("weight"), worded(TITLES[rule]).alias("title"), worded(DETAILS[rule]).alias("detail"),
    )


FINDING_KIND = "struct<rank:int,lead:int,rule_id:string,severity:string,weight:int,title:string,detail:string>"


def _has(role: str) -> Column:
    return F.array_contains("roles", role)


def _named(patterns: list[tuple], lang: str, blob: Column, plain: Column, path: Column | None = None) -> Column:
    """The names of the patterns that match, joined. A pattern runs where one of its plain parts is in plain = plain_parts(blob)."""
    hits = []
    for names, pattern, where, words in patterns:
        hit = P.may_match(plain, words)
        if path is not None and where:
            hit = hit & matches(path, where)
        hits.append(F.when(hit & matches(blob, pattern), wording(names, lang)))
    return F.when(F.size(plain) > 0, F.concat_ws(", ", *hits)).otherwise("")


def _manifest_changed(base: Column, lines: Column) -> Column:
    key = lambda x: F.regexp_extract(x, P.jvm(r'^\s*"([^"]+)"\s*:\s*"[\d^~*<>=]'), 1)
    real = lambda x: (trimmed(x) != "") & ~trimmed(x).startswith("#") & ~trimmed(x).startswith("//")
    return (
        F.when(base == "package.json", F.exists(lines, lambda x: (key(x) != "") & (key(x) != "version")))
        .when(base.isin("requirements.txt", "go.mod", "cargo.toml", "gemfile"), F.exists(lines, real))
        .otherwise(F.size(lines) > 0)
    )


def assessed(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Files -> the same without their texts, with roles, role, stem, cluster, `out` (left out by a glob) and findings but for missing-tests.

    `gap` tells whether a file wants a test. All of it is worked out within a row.
    """
    return applied(files, _assessment(replace(options, order="", budget_minutes=None, fail_on="", now=None))).drop("_base", "_blob", "_plain", "_white", "_secrets", "_execs", "_high", "_publish", "add_texts", "del_texts")


@built_once
def _assessment(options: Options) -> list[Step]:
    """The columns that assessed() adds, step by step."""
    lang, path = options.lang, F.col("path")
    steps = [{
        "out": F.coalesce(F.rlike(path, F.col("options.ignore")), F.lit(False)) if options.lang == BY_ROW.lang else ignored(path, list(options.ignore)), "roles": roles_of(path), "stem": stem_of(path), "changes": F.col("additions") + F.col("deletions"), "_base": base_name(path), "_blob": F.array_join("add_texts", "\n"),
    }, {"role": primary_role(F.col("roles")), "_plain": P.plain_parts(F.col("_blob"))}]
    blob, role, plain = F.col("_blob"), F.col("role"), F.col("_plain")
    sorted_trim = lambda c: F.array_sort(F.transform(c, trimmed))
    even = (F.size("add_texts") > 0) & (F.size("add_texts") == F.size("del_texts"))
    white = even & (F.array_sort("add_texts") != F.array_sort("del_texts")) & (sorted_trim("add_texts") == sorted_trim("del_texts"))
    steps.append({"cluster": cluster_of(path, role), "_white": white, "_secrets": _named([(n, p, None, x) for n, p, _, x in P.SECRETS], lang, blob, plain), "_execs": _named(P.EXECS, lang, blob, plain, path), "_publish": _has("ci") & matches(blob, P.CI_PUBLISH)})
    compared = (blob.contains("==") | blob.contains("!=")) & blob.rlike("(?i)signature|digest|hmac")
    timing = compared & F.exists("add_texts", lambda x: matches(x, P.DIGEST_COMPARE, True) & ~matches(x, P.SENTINEL_COMPARE))
    api_file = F.lit(False)
    for pattern, ignore_case in P.API_FILE:
        api_file = api_file | matches(path, pattern, ignore_case)
    one = lambda rule, when, what=None: F.when(when, finding(rule, lang, what))
    found = lambda *x: F.filter(F.array(*x), lambda f: f.isNotNull())
    high = found(
        one("secret-pattern", F.col("_secrets") != "", F.col("_secrets")),
        one("code-exec", F.col("_execs") != "", F.col("_execs")),
        one("timing-compare", ~_has("test") & timing),
        one("workflow-permissions", _has("ci") & matches(blob, P.CI_WRITE)),
        one("privileged-trigger", _has("ci") & matches(blob, P.CI_TRIGGER)),
        one("deleted-tests", (F.col("status") == "deleted") & is_test(path)),
        one("migration", _has("migration") | (path.endswith(".sql") & matches(blob, P.DDL, True))),
    )
    steps.append({"_high": high})
    surface = F.coalesce(*[F.when(_has(r), wording(SURFACES[r], lang)) for r in ("auth", "payment", "crypto")])
    changed = F.concat("add_texts", "del_texts")
    rest = found(
        one("ci-publish", F.col("_publish")),
        one("html-sink", P.may_match(plain, P.HTML_PLAIN) & matches(blob, P.HTML_SINK)),
        one("sensitive-surface", (F.size("_high") == 0) & ~_has("test") & surface.isNotNull() & (F.col("status") != "deleted") & (F.col("changes") > 0), surface),
        one("dependency-manifest", _has("deps") & _manifest_changed(F.col("_base"), changed)),
        one("lockfile", _has("lockfile") & ((F.col("n_hunks") > 0) | F.col("is_binary") | (F.col("changes") > 0))),
        one("api-change", api_file & ~_has("test") & F.exists(changed, lambda x: matches(x, P.EXPORT))),
        one("runtime-config", _has("config")),
        one("large-file", ~role.isin("lockfile", "generated", "asset", "docs") & (F.col("changes") >= option(options, "large_file_lines")), F.col("changes").cast("string")),
        one("ci-changed", _has("ci") & ~F.col("_publish") & ~F.exists("_high", lambda f: f["rule_id"].isin("workflow-permissions", "privileged-trigger"))),
        one("binary-file", F.col("is_binary")),
        one("generated-file", _has("generated")),
    )
    gap = (
        (F.col("status") != "deleted") & ~F.col("is_binary") & ~F.col("_white") & role.isin("source", "api", "payment", "auth", "crypto")
        & ~(_has("test") | _has("generated") | _has("docs")) & (F.col("changes") >= option(options, "test_gap_lines")) & (F.length("stem") >= 3)
    )
    findings = F.when(F.col("out"), F.array().cast(f"array<{FINDING_KIND}>")).when(F.col("_white"), F.array(finding("whitespace-only", lang))).otherwise(F.concat("_high", rest))
    return [*steps, {"findings": findings, "gap": gap}]


def is_live_test(f: Column) -> Column:
    return F.array_contains(f["roles"], "test") & (f["status"] != "deleted")


def covered(f: Column, tests: Column) -> Column:
    """Whether one of tests(path in lower case, stem) belongs to the file."""
    return F.exists(tests, lambda t: covers_named(t["path"], t["stem"], f["stem"]))


def missing_tests_joined(files: DataFrame) -> DataFrame:
    """patch_id, file_no of the files with a gap that no live test of their patch covers, by an anti join with a condition.

    The rule as it is stated, for assessed files that are stored: it reads them twice.
    """
    kept = files.where("file_no > 0 and not out")
    tests = kept.where(F.array_contains("roles", "test") & (F.col("status") != "deleted")).select(F.col("patch_id").alias("_patch"), F.lower("path").alias("_path"), F.col("stem").alias("_stem"))
    gaps = kept.where("gap").select("patch_id", "file_no", "stem")
    return gaps.join(tests, (F.col("patch_id") == F.col("_patch")) & covers_named(F.col("_path"), F.col("_stem"), F.col("stem")), "left_anti").select("patch_id", "file_no")


def score_of(findings: Column) -> Column:
    """The sum of weights, at most 100 with a high finding and 69 without."""
    top = F.when(has_severity(findings, "high"), 100).otherwise(69)
    return F.least(top, F.aggregate(findings, F.lit(0), lambda a, f: a + f["weight"]))


def has_severity(findings: Column, severity: str) -> Column:
    return F.exists(findings, lambda f: f["rank"] == SEVERITY_RANK[severity])


def label_of(findings: Column, score: Column) -> Column:
    some = lambda s: has_severity(findings, s)
    return F.when(some("high") | (score >= 70), "high").when(some("medium") | (score >= 32), "medium").when(some("low") | (score >= 10), "low").otherwise("calm")


def graded(f: Column, findings: Column) -> list[Column]:
    """findings, score, label, band (at most 20 with a high finding) and disposition of a file."""
    high = has_severity(findings, "high")
    band = F.when(high, F.least(band_of(f["role"]), F.lit(20))).otherwise(band_of(f["role"]))
    later = f["role"].isin("lockfile", "generated", "asset", "docs")
    disposition = F.when(high, "now").when(later, "later").when(has_severity(findings, "medium"), "soon").otherwise("later")
    return [findings.alias("findings"), score_of(findings).alias("score"), label_of(findings, score_of(findings)).alias("label"), band.alias("band"), disposition.alias("disposition")]
