"""Options as data: each patch is reviewed by its own language, order, thresholds, ignored paths, budget and gate, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.operators.packet import packets, redact_packets
from patchlens.operators.rules import BY_ROW, Options

#: What an options table may have beside patch_id. A column that is missing or null has the default.
FIELDS = {"lang": "string", "order": "string", "large_file_lines": "double", "test_gap_lines": "double", "budget_minutes": "double", "ignore": "array<string>", "fail_on": "string", "now": "string"}


def globs_pattern(globs: Column) -> Column:
    """An array of globs as one pattern for whole paths, so a path is read once for all; null for none.

    ** crosses folders, * does not, everything else stands for itself.
    """

    def one(glob: Column) -> Column:
        # what stands for something becomes a mark of its own, as longer marks hold shorter ones
        plain = F.replace(F.replace(F.replace(glob, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("\x03"))
        out = F.concat(F.lit(r"\Q"), F.replace(plain, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        for mark, pattern in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*")):
            out = F.replace(out, F.lit(mark), F.lit(rf"\E{pattern}\Q"))
        return out

    given = F.filter(globs, lambda g: g.isNotNull())
    return F.when(F.size(given) > 0, F.concat(F.lit(r"(?s)\A(?:"), F.array_join(F.transform(given, one), "|"), F.lit(r")\z")))


def _checked(row: DataFrame) -> DataFrame:
    """The column options, a struct; a language, order or gate that isn't known has the default, and so has a number below 0."""
    plain = Options()

    def value(name: str, kind: str) -> Column:
        given = F.col(f"_o_{name}") if f"_o_{name}" in row.columns else F.lit(None)
        given = given.cast(kind)
        if name == "lang":
            low = F.lower(given)
            return F.when(low.isin("pt", "pt-br", "pt_br"), "pt").otherwise("en")
        if name in ("order", "fail_on"):
            return F.when(given.isin(*{"order": ("story", "risk"), "fail_on": ("none", "info", "low", "medium", "high")}[name]), given).otherwise(getattr(plain, name))
        if kind == "double":
            return F.when((given >= 0) & (given < float("inf")), given).otherwise(F.lit(getattr(plain, name)).cast("double"))
        return globs_pattern(given) if name == "ignore" else given

    return row.withColumn("options", F.struct(*[value(n, k).alias(n) for n, k in FIELDS.items()]))


def with_options(patches: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """patches(patch_id, text) with the column `options`: from a table by patch_id, one row each, or from the patches' own columns.

    A patch that the table lacks has the defaults. Columns of patches move no text; a table is joined, and broadcast if it is small.
    """
    if options is None:
        rows = patches.select("patch_id", "text", *[F.col(c).alias(f"_o_{c}") for c in FIELDS if c in patches.columns])
    else:
        given = options.select(F.col("patch_id").alias("_of"), *[F.col(c).alias(f"_o_{c}") for c in FIELDS if c in options.columns])
        rows = patches.select("patch_id", "text").join(given, F.col("patch_id") == F.col("_of"), "left")
    return _checked(rows).select("patch_id", "text", "options")


def review_requests(patches: DataFrame, options: DataFrame | None = None, redact: bool = True, lines: int | None = None) -> DataFrame:
    """Packets of patches, each by its own options."""
    out = packets(with_options(patches, options), BY_ROW, lines=lines)
    return redact_packets(out) if redact else out
