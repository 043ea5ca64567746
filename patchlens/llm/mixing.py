"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The tokens of the cells are raked until the weighted totals meet the
target marginals of source, language and topic; the expected token shares of a sample drawn by the cells' factors are then
the targets. There are two ways to draw it:
- `mix`, the pipeline's stage: a document is taken `budget` x factor times, the fraction by a draw. The sample has `budget`
  times the tokens whatever the largest factor is; documents of cells with a factor above 1 / `budget` are repeated.
- `calibrated`, which op1 and its SQL show: no document is repeated. Factors are scaled so that none exceeds 1 and are the
  probabilities to be kept, so the rarest cell sets the size of the sample.

Cells, not documents, go through the rounds. They stay a distributed table: each half-step sums a margin by a
pre-aggregated groupBy and joins its correction back, so one hot source is one partial sum for each task.

The topic is an expression over the documents' columns, also over one that documents don't have, such as the class that
a classifier gave; without one it is guessed from the form of the text (`topic_of`).

Targets default to tempered shares: a value's share of tokens to the power `alpha`, normalised. A null source, language or
topic is a value of its own (`unknown`). A cell without tokens has factor 1 and is taken at the common rate. Margins that
contradict each other can't all be met; a warning then tells the error left. An
empty table gives an empty result. Repeated rows draw alike, as the draw hashes doc_id, text and the seed; documents without
doc_id are told apart by their texts. There is no order, so there are no ties. Texts of any length are counted whole. Columns that documents don't have are dropped, so none can clash.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import DOCUMENT_COLUMNS, drop_kept, keep, table, with_columns_of

MARGINS = ["source", "lang", "topic"]
#: Raking ends when no margin is off by more than this share of it, or after so many rounds, or where the error no longer falls.
TOLERANCE, MOST_ROUNDS, STALLED = 1e-6, 200, 8


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text: table, notice, record, code or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("icense"), "notice")
        .when(text.contains("@") | text.rlike("[0-9]{3}"), "record")
        .when(text.rlike("[#$%&*]{3}"), "code")
        .otherwise("prose")
    )


def _with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    docs = with_columns_of(docs, *([] if topic is None else [topic.cast("string").alias("_given")]))
    found = topic_of(F.col("text")) if topic is None else F.col("_given")
    known = [F.coalesce(F.col(c), F.lit("unknown")).alias(f"_{c}") for c in MARGINS[:2]]
    return docs.select("*", *known, F.coalesce(found, F.lit("unknown")).alias("_topic"), n_tokens(F.col("text")).alias("_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest")).drop("_given")


def margin_error(raked: DataFrame) -> float:
    """The largest relative error of a margin of raked cells(source, lang, topic, weight, wish_source, wish_lang, wish_topic)."""
    each = [raked.groupBy(m).agg(F.sum("weight").alias("got"), F.max(f"wish_{m}").alias("wish")).select("got", "wish") for m in MARGINS]
    both = each[0].unionByName(each[1]).unionByName(each[2]).where("wish > 0")
    return both.agg(F.max(F.abs(F.col("got") - F.col("wish")) / F.col("wish"))).first()[0] or 0.0


def rake(cells: DataFrame, alpha: float = 0.7, rounds: int = 6, targets: dict[str, DataFrame] | None = None, settle: bool = True) -> DataFrame:
    """cells(source, lang, topic, tokens) -> the same with factor.

    targets: for a margin, a frame (value, share) over the values to be met; by default tempered shares. Shares are
    normalised over the values that cells have; a value that targets don't name gets no weight. Each round rakes every
    margin once; the cells are written after each round, as a margin's step reads them twice. There are `rounds` rounds at
    least, and more until every margin is within TOLERANCE, or just so many without `settle`. Where the tolerance isn't
    reached, a warning gives the error left.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("had"))
        wish = F.when(F.col("had") > 0, F.pow(F.col("had"), F.lit(float(alpha)))).otherwise(0.0)
        if targets and m in targets:
            given = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias("share"))
            sums, wish = sums.join(given, m, "left"), F.when(F.col("had") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)
        sums = sums.select(m, wish.alias("wish"))
        whole = sums.agg(F.sum("wish")).first()[0] or 1.0
        now = now.join(sums.select(m, (F.col("wish") * (total / whole)).alias(f"wish_{m}")), m)
    now = keep(now, "raked")
    errors: list[float] = []
    for done in range(1, (max(rounds, MOST_ROUNDS) if settle else rounds) + 1):
        before = now
        for m in MARGINS:
            got = now.groupBy(m).agg(F.sum("weight").alias("got"))
            now = now.join(got, m).withColumn("weight", F.when(F.col("got") > 0, F.col("weight") * (F.col(f"wish_{m}") / F.col("got"))).otherwise(0.0)).drop("got")
        now = keep(now, "raked")
        drop_kept(before)
        if done < rounds:
            continue
        errors.append(margin_error(now))
        if errors[-1] <= TOLERANCE or len(errors) > STALLED and errors[-1] > 0.9 * errors[-1 - STALLED]:
            break
    if errors and errors[-1] > TOLERANCE:
        warnings.warn(f"mixing: after {done} rounds a margin is off by {errors[-1]:.2g} of its target", stacklevel=2)
    return now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))


def _raked(docs: DataFrame, alpha: float, rounds: int, targets: dict[str, DataFrame] | None, texts: bool = True, settle: bool = True, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with their cells, and the cells with _factor. Without texts each text is read once: what is left of a row is kept."""
    rows = _with_cells(docs, topic) if texts else keep(_with_cells(docs, topic).drop("text"), "rows")
    cells = rows.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(F.sum("_tokens").alias("tokens"))
    return rows, rake(keep(cells, "cells"), alpha, rounds, targets, settle).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("factor").alias("_factor"))


def _draw(seed: str) -> Column:
    """A uniform draw for each document, of its id and its text, so documents without an id are drawn one by one."""
    parts = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_digest"))
    return F.conv(F.substring(F.md5(parts), 1, 12), 16, 10).cast("double") / float(16**12)


def calibrated(docs: DataFrame, alpha: float = 0.7, rounds: int = 6, budget: float = 1.0, targets: dict[str, DataFrame] | None = None, seed: str = "mix", texts: bool = True, settle: bool = True, topic: Column | None = None) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _factor, _p (the probability to be kept) and _kept.

    `budget` is the wanted share of all tokens; where the largest factor allows less, the sample is smaller, as clipping
    probabilities at 1 would miss the targets. `mix` meets the budget.
    """
    rows, factors = _raked(docs, alpha, rounds, targets, texts, settle, topic)
    most = factors.agg(F.max("_factor")).first()[0] or 1.0
    scale = min(float(budget), 1.0 / most)
    return rows.join(factors, [f"_{m}" for m in MARGINS]).withColumn("_p", F.least(F.lit(1.0), F.col("_factor") * F.lit(scale))).withColumn("_kept", _draw(seed) < F.col("_p"))


def mix(docs: DataFrame, alpha: float = 0.7, rounds: int = 6, budget: float = 1.0, targets: dict[str, DataFrame] | None = None, seed: str = "mix", topic: Column | None = None) -> DataFrame:
    """The sample, with the columns of documents: `budget` times all tokens in expectation, each document `budget` x factor times."""
    rows, factors = _raked(docs, alpha, rounds, targets, topic=topic)
    wanted = F.col("_factor") * F.lit(float(budget))
    copies = (F.floor(wanted) + (_draw(seed) < wanted - F.floor(wanted)).cast("long")).cast("int")
    taken = rows.join(factors, [f"_{m}" for m in MARGINS]).withColumn("_copies", copies).where("_copies > 0")
    return taken.select(*DOCUMENT_COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*DOCUMENT_COLUMNS)


def op1_mix_raked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, factor, probability and decision, after six rounds, as its SQL has it."""
    rows = calibrated(table(spark, sf_dir, "documents"), texts=False, settle=False)
    return rows.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_factor", 6).alias("factor"), F.round("_p", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


def _oracle(alpha: float = 0.7, rounds: int = 6, budget: float = 1.0, seed: str = "mix") -> str:
    """DuckDB SQL for op1: the same rounds, one common table for each margin's step."""
    ctes = [
        """docs AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
        coalesce(CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'notice'
          WHEN contains(text, '@') OR regexp_matches(text, '[0-9]{3}') THEN 'record'
          WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'code' WHEN text IS NOT NULL THEN 'prose' END, 'unknown') AS topic,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens, md5(coalesce(text, '')) AS digest FROM documents)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, sum(n_tokens)::DOUBLE AS weight FROM docs GROUP BY ALL)",
    ]
    for m in MARGINS:
        ctes.append(f"wish_{m} AS MATERIALIZED (SELECT {m}, wish * ((SELECT sum(tokens) FROM w0)::DOUBLE / sum(wish) OVER ()) AS wish FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {alpha}) AS wish FROM w0 GROUP BY {m} HAVING sum(tokens) > 0))")
    n = 0
    for m in MARGINS * rounds:
        n += 1
        got = f"SELECT {m}, sum(weight) AS got FROM w{n - 1} GROUP BY {m}"
        ctes.append(f"w{n} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN got > 0 THEN weight * (coalesce(wish, 0) / got) ELSE 0 END AS weight FROM w{n - 1} JOIN ({got}) USING ({m}) LEFT JOIN wish_{m} USING ({m}))")
    ctes.append(f"cells AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS factor FROM w{n})")
    ctes.append(f"scaled AS (SELECT *, least(1.0, factor * least({budget}, 1.0 / (SELECT max(factor) FROM cells))) AS p FROM cells)")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 12))::BIGINT::DOUBLE / {16**12}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(factor, 6) AS factor, round(p, 6) AS probability, {draw} < p AS kept FROM docs JOIN scaled USING (source, lang, topic)"


ORACLE_SQL = _oracle()
