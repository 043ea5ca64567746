"""Reviews of patches that are too large for one row.

packets() gathers the files of a patch in its row. Here files stay rows: tests are found by an equi-join, order comes from ranks
that are put together from a histogram, and what is asked of a whole patch from sums. Results are those of packets().

`files` are assessed files (operators.rules.assessed), with null or repeated patch_ids as packets() has them: rows without one
are patches of their own, and file_no goes on over the rows of a patch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.ranks import ranked
from patchlens.functions.staging import stored
from patchlens.operators.packet import FILE_FIELDS, looked_up, short_name
from patchlens.operators.rules import FINDING_KIND, Options, finding, graded, said, wording
from patchlens.plans.catalog import CLUSTER_TITLES, EMPTY_LEDE, HEADLINES, LEDE, ROLE_NAMES, SEVERITY_RANK

PATCH = ["patch_id", "alone"]
_key = lambda kind, c: F.concat(F.lit(kind), c)


def merged(files: DataFrame) -> DataFrame:
    """Assessed files with `alone` (the part of a row without patch_id) and file_no numbered on over the rows of a patch; repeated rows once.

    The files, small rows without texts, become a table, as several joins read them. The sums run over one small row for each
    row of patches, not over files.
    """
    files = stored(files.withColumn("alone", F.when(F.col("patch_id").isNull(), F.col("part"))), "files")
    rows = files.where("file_no = 0").groupBy(*PATCH, "part").agg(F.first("n_files").alias("_n"), F.count(F.lit(1)).alias("_copies"))
    before = Window.partitionBy(*PATCH).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*[F.col(c).alias(f"_{c}") for c in (*PATCH, "part")], F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_before"), "_copies")
    moved = rows.where("_before > 0 or _copies > 1")
    both = files.join(moved, [files[c].eqNullSafe(moved[f"_{c}"]) for c in (*PATCH, "part")], "left")
    once = both.where("_copies > 1").dropDuplicates([*PATCH, "part", "file_no"])
    out = both.where("coalesce(_copies, 1) = 1").unionByName(once)
    return out.select(*[(F.col("file_no") + F.when(F.col("file_no") > 0, F.coalesce("_before", F.lit(0))).otherwise(0)).alias(c) if c == "file_no" else F.col(c) for c in files.columns])


def index_of_tests(tests: DataFrame) -> DataFrame:
    """Live tests -> (patch, key): what a stem may be covered by. s: stems of tests and path parts that end at a dot; h: beginnings of test names."""
    parts = F.split(F.lower("path"), "/", -1)
    words = lambda part: F.split(part, r"\.", -1)
    dotted = lambda part: F.transform(F.sequence(F.lit(1), F.size(words(part)) - 1), lambda k: F.array_join(F.slice(words(part), F.lit(1), k), "."))
    inner = F.flatten(F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.contains(".")), dotted))
    head = F.get(F.split("stem", r"[._-]", -1), F.lit(0))
    keys = F.concat(F.array(_key("s", F.col("stem"))), F.transform(inner, lambda x: _key("s", x)), F.when(F.length(head) >= 3, F.array(_key("h", head))).otherwise(F.array().cast("array<string>")))
    return tests.select(*PATCH, F.explode(F.array_distinct(keys)).alias("key")).distinct()


def missing_tests(files: DataFrame) -> DataFrame:
    """patch_id, alone, file_no of the files with a gap that no live test of their patch covers: an equi-join of stems and their beginnings with an index of tests.

    A frequent beginning is a frequent key of the files alone, as the index has each key of a patch once; Spark splits such a join.
    """
    kept = files.where("file_no > 0 and not out")
    index = index_of_tests(kept.where(F.array_contains("roles", "test") & (F.col("status") != "deleted")))
    gaps = kept.where("gap").select(*PATCH, "file_no", "stem")
    begins = F.transform(F.sequence(F.lit(3), F.length("stem")), lambda n: _key("h", F.substr("stem", F.lit(1), n)))
    asked = gaps.select(*PATCH, "file_no", F.explode(F.concat(F.array(_key("s", F.col("stem"))), begins)).alias("key"))
    index = index.select(*[F.col(c).alias(f"_{c}") for c in PATCH], F.col("key").alias("_key"))
    met = asked.join(index, [*[asked[c].eqNullSafe(index[f"_{c}"]) for c in PATCH], asked["key"] == index["_key"]], "left_semi").select(*PATCH, "file_no").distinct()
    met = met.select(*[F.col(c).alias(f"_{c}") for c in (*PATCH, "file_no")])
    return gaps.select(*PATCH, "file_no").join(met, [*[gaps[c].eqNullSafe(met[f"_{c}"]) for c in PATCH], gaps["file_no"] == met["_file_no"]], "left_anti")


def wide_files(files: DataFrame, options: Options = Options(), piece: int | None = None) -> DataFrame:
    """Merged files -> one row for each that is kept, with findings, score, label, band, disposition, rank and reason."""
    lang = options.lang
    lost = missing_tests(files)
    lost = lost.select(*[F.col(c).alias(f"_{c}") for c in (*PATCH, "file_no")], F.lit(True).alias("_missing"))
    kept = files.where("file_no > 0 and not out")
    rows = kept.join(lost, [*[kept[c].eqNullSafe(lost[f"_{c}"]) for c in PATCH], kept["file_no"] == lost["_file_no"]], "left")
    more = F.when(F.col("_missing"), F.array(finding("missing-tests", lang, F.col("stem")))).otherwise(F.array().cast(f"array<{FINDING_KIND}>"))
    names = [*PATCH, *FILE_FIELDS[1:]]
    rows = rows.select(*[kept[c] for c in names], F.array_sort(F.concat("findings", more)).alias("findings"))
    # grading speaks of a file as a struct
    rows = rows.select(*names, F.struct("role", "findings").alias("_f")).select(*names, *graded(F.col("_f"), F.col("_f.findings")))
    cell = [(-F.col("score")).alias("_a"), F.col("band").alias("_b")] if options.order == "risk" else [F.col("band").alias("_a"), (-F.col("score")).alias("_b")]
    given = {} if piece is None else {"piece": piece}
    out = ranked(rows.select("*", *cell), PATCH, ["_a", "_b"], [F.collate("path", "UNICODE"), F.col("file_no")], **given).drop("_a", "_b")
    return out.withColumn("reason", F.coalesce(F.get("findings", F.lit(0))["title"], looked_up(ROLE_NAMES, F.col("role"), lang)))


def wide_clusters(rows: DataFrame, lang: str = "en") -> DataFrame:
    """wide_files() -> patch, cluster_no, cluster, title, n_files: the groups of each patch in the order in which their first files are read."""
    groups = rows.groupBy(*PATCH, "cluster").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("n_files"))
    groups = ranked(groups, PATCH, ["_first"], [F.col("cluster")], "cluster_no")
    return groups.select(*PATCH, "cluster_no", "cluster", looked_up(CLUSTER_TITLES, F.col("cluster"), lang).alias("title"), "n_files")


def wide_packets(files: DataFrame, rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Merged files, and wide_files() of them -> one row for each patch with what packets() has outside its arrays."""
    lang = options.lang
    whole = files.groupBy(*PATCH).agg(F.min("id").alias("id"), F.count_if((F.col("file_no") > 0) & F.col("out")).cast("int").alias("n_ignored"))
    each = lambda s: F.size(F.filter("findings", lambda f: f["rank"] == SEVERITY_RANK[s]))
    sums = rows.groupBy(*PATCH).agg(
        F.count(F.lit(1)).cast("int").alias("n_files"), F.sum("additions").cast("int").alias("additions"), F.sum("deletions").cast("int").alias("deletions"),
        F.sum(F.when(~F.col("role").isin("lockfile", "generated", "asset"), F.col("changes")).otherwise(0)).alias("_read"), *[F.sum(each(s)).cast("int").alias(f"n_{s}") for s in SEVERITY_RANK],
        F.sum(F.aggregate("findings", F.lit(0), lambda a, f: a + f["weight"])).alias("_weights"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "path")))).alias("_top"),
    )
    sums = sums.select(*[F.col(c).alias(f"_{c}") if c in PATCH else F.col(c) for c in sums.columns])
    out = whole.join(sums, [whole[c].eqNullSafe(sums[f"_{c}"]) for c in PATCH], "left").drop(*[f"_{c}" for c in PATCH])
    out = out.fillna(0, ["n_files", "additions", "deletions", "_read", "_weights", *[f"n_{s}" for s in SEVERITY_RANK]])
    out = out.withColumn("minutes", F.when(F.col("n_files") > 0, F.greatest(F.lit(2), F.floor(F.col("_read") / 40 + 0.5))).otherwise(0).cast("int"))
    over = F.lit(False) if options.budget_minutes is None else (F.col("n_files") > 0) & (F.col("minutes") > F.lit(options.budget_minutes))
    budget = finding("over-budget", lang, F.col("minutes").cast("string"))
    out = out.withColumn("over_budget", over).withColumns({"n_medium": F.col("n_medium") + F.col("over_budget").cast("int"), "_weights": F.col("_weights") + F.when(F.col("over_budget"), budget["weight"]).otherwise(0)})
    out = out.withColumn("score", F.least(F.when(F.col("n_high") > 0, 100).otherwise(69), F.col("_weights")).cast("int"))
    label = F.when((F.col("n_high") > 0) | (F.col("score") >= 70), "high").when((F.col("n_medium") > 0) | (F.col("score") >= 32), "medium").when((F.col("n_low") > 0) | (F.col("score") >= 10), "low").otherwise("calm")
    out = out.withColumn("label", label).withColumn("_top", F.transform("_top", lambda x: x["path"]))
    names = F.array_join(F.transform("_top", lambda p: short_name(p, F.col("_top"))), ", ")
    lede = F.format_string(said(LEDE, lang), "n_files", "additions", "deletions", "minutes", "n_high", names)
    empty = F.col("n_files") == 0
    headline = F.when(empty, wording(HEADLINES["empty"], lang)).otherwise(looked_up({k: v for k, v in HEADLINES.items() if k != "empty"}, F.col("label"), lang))
    return out.withColumns({"headline": headline, "lede": F.when(empty, wording(EMPTY_LEDE, lang)).otherwise(lede)}).drop("_read", "_weights", "_top")
