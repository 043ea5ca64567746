"""Review packets: one nested row for each patch.

Files are worked out row by row; one shuffle of their small rows gathers each patch, without texts but for the lines that are to
be shown, and what needs all files of a patch (missing tests, order, clusters, sums) is worked out on the arrays of its row.
operators.wide does the same without a row that holds a whole patch.

Rows that share a patch_id are one patch: their files follow each other in the order of the rows' contents, numbered on. A row that
is repeated whole counts once. A row without patch_id is a patch of its own.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.functions.steps import Step, applied, built_once, once
from patchlens.operators.parse import diff_files
from patchlens.operators.redact import redact_line, redact_text
from patchlens.operators.rules import BY_ROW, FINDING_KIND, Options, assessed, covered, finding, graded, is_live_test, label_of, option, score_of, wording
from patchlens.plans.catalog import CLUSTER_TITLES, EMPTY_LEDE, HEADLINES, LEDE, ROLE_NAMES, SEVERITY_RANK

FILE_FIELDS = ["part", "file_no", "path", "old_path", "new_path", "previous_path", "status", "is_binary", "similarity", "n_hunks", "roles", "role", "stem", "cluster", "additions", "deletions", "changes"]


def looked_up(pairs: dict[str, tuple[str, str]], key: Column, lang: str) -> Column:
    """The wording for key, or the key itself."""
    found = lambda at: F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v[at])]), key)
    return F.coalesce(F.when(F.col("options.lang") == "pt", found(1)).otherwise(found(0)) if lang == BY_ROW.lang else found(int(lang == "pt")), key)


def short_name(path: Column, others: Column) -> Column:
    """The shortest tail of path that no other of the top paths shares."""
    parts = F.reverse(F.split(path, "/", -1))

    def common(other: Column) -> Column:
        theirs = F.reverse(F.split(other, "/", -1))
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))

        def step(a: Column, i: Column) -> Column:
            more = a["go"] & F.coalesce(F.get(parts, i) == F.get(theirs, i), F.lit(False))
            return F.struct((a["n"] + more.cast("int")).alias("n"), more.alias("go"))

        return F.aggregate(F.sequence(F.lit(0), F.size(parts)), start, step, lambda a: a["n"])

    depth = F.least(F.size(parts), F.aggregate(F.filter(others, lambda o: o != path), F.lit(0), lambda a, o: F.greatest(a, common(o))) + 1)
    # two files with the very same path stay alike, however much of it is shown
    same = F.size(F.filter(others, lambda o: o == path)) > 1
    return F.array_join(F.reverse(F.slice(parts, F.lit(1), F.when(same, F.size(parts)).otherwise(depth))), "/")


def _sorted(files: Column, order: str) -> Column:
    """Files in reading order. Paths compare by the root collation, equal ones by their place in the patch."""

    def keyed(f: Column) -> Column:
        a, b = (-f["score"], f["band"]) if order == "risk" else (f["band"], -f["score"])
        if order == BY_ROW.order:
            risk = F.col("options.order") == "risk"
            a, b = F.when(risk, b).otherwise(a), F.when(risk, a).otherwise(b)
        keys = [a.alias("a"), b.alias("b")]
        return F.struct(*keys, F.collate(f["path"], "UNICODE").alias("c"), f["file_no"].alias("d"), f.alias("f"))

    return F.transform(F.array_sort(F.transform(files, keyed)), lambda x: x["f"])


def packets(patches: DataFrame, options: Options = Options(), spread: bool = False, lines: int | None = None) -> DataFrame:
    """One row for each patch, also for one without a file that is kept. lines: how many lines of each file `hunks` shows, 0 for all, None for no hunks."""
    files = assessed(diff_files(patches, spread, lines), options)
    by_row = options.lang == BY_ROW.lang
    kept = (F.col("file_no") > 0) & ~F.col("out")
    row = F.struct(*FILE_FIELDS, "findings", "gap", *["hunks"] * (lines is not None))
    at = F.struct("part", "file_no")
    alone = F.when(F.col("patch_id").isNull(), F.col("part"))  # a patch of its own
    out = files.groupBy("patch_id", alone.alias("_alone")).agg(
        F.min("id").alias("id"), F.size(F.collect_set(F.when((F.col("file_no") > 0) & F.col("out"), at))).alias("n_ignored"),
        F.collect_set(F.when(F.col("file_no") == 0, F.struct("part", "n_files"))).alias("_parts"), F.count_if(F.col("file_no") == 0).alias("_rows"), F.collect_set(F.when(kept, row)).alias("_files"),
        *[F.min_by("options", "part").alias("options")] * by_row,
    )
    now = options.now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    out = applied(out, _merged())
    out = applied(out, _contents(replace(options, now=None), lines is not None)).withColumn("generated_at", F.coalesce(F.col("options.now"), F.lit(now)) if by_row else F.lit(now))
    return out.drop("options", "_files", "_tests", "_top", "_parts", "_before", "_rows", "_alone")


@built_once
def _merged() -> list[Step]:
    """_before: for several rows of one patch, how many files the rows before each part have; null for one row."""
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<part:bigint,n:int>>").alias("out"))
    step = lambda a, p: F.struct((a["n"] + p["n_files"]).alias("n"), F.array_append(a["out"], F.struct(p["part"].alias("part"), a["n"].alias("n"))).alias("out"))
    before = F.map_from_entries(F.aggregate(F.array_sort("_parts"), begin, step, lambda a: a["out"]))
    return [{"_before": once(F.when(F.col("_rows") > 1, before))}]


@built_once
def _contents(options: Options, hunks: bool = False) -> list[Step]:
    """The columns of a packet, step by step, from the patch's id, n_ignored and _files."""
    lang = options.lang
    fields = [*FILE_FIELDS[1:], *["hunks"] * hunks]
    own = lambda f, c: f[c] + F.coalesce(F.try_element_at("_before", f["part"]), F.lit(0)) if c == "file_no" else f[c]
    steps: list[Step] = []
    steps.append({"_tests": once(F.transform(F.filter("_files", is_live_test), lambda f: F.struct(F.lower(f["path"]).alias("path"), f["stem"].alias("stem"))))})
    gap = lambda f: F.when(f["gap"] & ~covered(f, F.col("_tests")), F.array(finding("missing-tests", lang, f["stem"]))).otherwise(F.array().cast(f"array<{FINDING_KIND}>"))
    steps.append({"_files": F.transform("_files", lambda f: f.withField("findings", F.array_sort(F.concat(f["findings"], gap(f)))))})
    steps.append({"_files": F.transform("_files", lambda f: F.struct(*[own(f, c).alias(c) for c in fields], *graded(f, f["findings"])))})
    reason = lambda f: F.coalesce(F.get(f["findings"], F.lit(0))["title"], looked_up(ROLE_NAMES, f["role"], lang))
    steps.append({"files": F.transform(_sorted(F.col("_files"), options.order), lambda f, i: f.withField("rank", i + 1).withField("reason", reason(f)))})

    total = lambda what, when=None: F.aggregate(F.col("files") if when is None else F.filter("files", when), F.lit(0), lambda a, f: a + f[what])
    counted = total("changes", lambda f: ~f["role"].isin("lockfile", "generated", "asset"))
    steps.append({"n_files": F.size("files"), "additions": total("additions"), "deletions": total("deletions")})
    steps.append({"minutes": F.when(F.col("n_files") > 0, F.greatest(F.lit(2), F.floor(counted / 40 + 0.5))).otherwise(0).cast("int")})
    over = F.coalesce((F.col("n_files") > 0) & (F.col("minutes") > option(options, "budget_minutes")), F.lit(False))
    steps.append({"over_budget": over})
    budget = F.when(F.col("over_budget"), F.array(F.struct(finding("over-budget", lang, F.col("minutes").cast("string")).alias("f"), F.lit(None).cast("string").alias("path"), F.lit(1 << 30).alias("k"))))
    each = F.flatten(F.transform("files", lambda f: F.transform(f["findings"], lambda x: F.struct(x.alias("f"), f["path"].alias("path"), f["rank"].alias("k")))))
    each = F.concat(each, F.coalesce(budget, F.array().cast(f"array<struct<f:{FINDING_KIND},path:string,k:int>>")))
    keyed = F.transform(each, lambda x: F.struct(x["f"]["rank"].alias("a"), x["f"]["lead"].alias("b"), F.collate(F.coalesce(x["path"], F.lit("")), "UNICODE").alias("c"), F.collate(x["f"]["rule_id"], "UNICODE").alias("d"), x["k"].alias("e"), x.alias("x")))
    steps.append({"findings": F.transform(F.array_sort(keyed), lambda y: y["x"]["f"].withField("path", y["x"]["path"]))})
    of = lambda rank: lambda f: f["rank"] == rank
    counts = {f"n_{s}": F.size(F.filter("findings", of(rank))) for s, rank in SEVERITY_RANK.items()}
    steps.append({"score": score_of(F.col("findings")), "_top": F.transform(F.slice("files", 1, 3), lambda f: f["path"]), **counts})
    steps.append({"label": label_of(F.col("findings"), F.col("score")), "top": F.transform("_top", lambda p: short_name(p, F.col("_top")))})
    stats = F.struct(F.col("n_files").alias("files"), F.col("n_ignored").alias("ignored"), "additions", "deletions", "minutes", F.col("score").alias("risk_score"), F.col("label").alias("risk_label"), F.struct(*[F.col(f"n_{s}").alias(s) for s in ("info", "low", "medium", "high")]).alias("counts"))
    headline = F.when(F.col("n_files") == 0, wording(HEADLINES["empty"], lang)).otherwise(looked_up({k: v for k, v in HEADLINES.items() if k != "empty"}, F.col("label"), lang))
    lede = wording(LEDE, lang, lambda text: F.format_string(text, "n_files", "additions", "deletions", "minutes", "n_high", F.array_join("top", ", ")))
    stops = F.transform("files", lambda f: F.struct(*[f[c].alias(c) for c in ("path", "reason", "label", "score", "disposition", "role")]))
    rank = F.coalesce(*[F.when(option(options, "fail_on") == s, k) for s, k in SEVERITY_RANK.items()], F.lit(-1))
    steps.append({
        "version": F.lit(1), "language": option(options, "lang"), "order": option(options, "order"), "stats": stats, "headline": headline,
        "lede": F.when(F.col("n_files") == 0, wording(EMPTY_LEDE, lang)).otherwise(lede), "reading_order": stops, "clusters": _clusters(lang),
        "gate_failed": F.exists("findings", lambda f: f["rank"] <= rank),
    })
    return steps


def _clusters(lang: str) -> Column:
    """Clusters in the order in which files are read; the ranks of a cluster are found by sorting (cluster, rank) once."""
    # a file starts its cluster where the one before it, in the order of (cluster, rank), is of another
    by = F.array_sort(F.transform("files", lambda f: F.struct(f["cluster"].alias("c"), f["rank"].alias("k"), f["path"].alias("p"))))
    start = F.filter(F.transform(by, lambda x, i: F.when((i == 0) | (F.get(by, i - 1)["c"] != x["c"]), F.struct(x["k"].alias("k"), x["c"].alias("c"), i.alias("i")))), lambda x: x.isNotNull())
    whole = F.transform(start, lambda s, j: F.struct(s["k"].alias("k"), s["c"].alias("c"), F.slice(by, s["i"] + 1, F.coalesce(F.get(start, j + 1)["i"], F.size(by)) - s["i"]).alias("of")))
    return F.transform(F.array_sort(whole), lambda s: F.struct(s["c"].alias("id"), looked_up(CLUSTER_TITLES, s["c"], lang).alias("title"), F.transform(s["of"], lambda x: x["p"]).alias("paths")))


def files_of(patches: DataFrame, options: Options = Options(), spread: bool = False) -> DataFrame:
    """One row for each kept file, in the packet's order by rank."""
    return packets(patches, options, spread).select("patch_id", F.inline("files"))


def findings_of(packets: DataFrame) -> DataFrame:
    """One row for each finding of a packet, numbered in its order."""
    rows = packets.select("patch_id", F.posexplode("findings").alias("_at", "f"))
    return rows.select("patch_id", (F.col("_at") + 1).alias("finding_no"), *[f"f.{c}" for c in ("rule_id", "severity", "weight", "path", "title", "detail")])


def redact_packets(packets: DataFrame) -> DataFrame:
    """Packets that may be shown: headline, lede, the texts of findings and reasons and lines masked; paths and sections stay."""
    masked = lambda f: f.withField("title", redact_text(f["title"])).withField("detail", redact_text(f["detail"]))
    line = lambda x: x.withField("text", redact_line(x["text"], x["in_key"]))
    shown = lambda f: f.withField("hunks", F.transform(f["hunks"], lambda h: h.withField("lines", F.transform(h["lines"], line))))
    kind = packets.schema["files"].dataType
    own = shown if isinstance(kind, T.ArrayType) and "hunks" in kind.elementType.names else lambda f: f
    files = F.transform("files", lambda f: own(f.withField("reason", redact_text(f["reason"])).withField("findings", F.transform(f["findings"], masked))))
    stops = F.transform("reading_order", lambda s: s.withField("reason", redact_text(s["reason"])))
    return packets.withColumns({"headline": redact_text(F.col("headline")), "lede": redact_text(F.col("lede")), "files": files, "findings": F.transform("findings", masked), "reading_order": stops})


def review(patches: DataFrame, options: Options = Options(), redact: bool = True, hunks: bool = False, lines: int = 0) -> DataFrame:
    """What a user asks for: packets, masked unless told otherwise, with their hunks if wanted, of which a file shows `lines` lines (0: all)."""
    out = packets(patches, options, lines=lines if hunks else None)
    return redact_packets(out) if redact else out
