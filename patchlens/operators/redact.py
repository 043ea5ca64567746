"""Masks for credentials in texts and in sequences of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.patterns import DOTS, KEY_BEGIN, KEY_END, KEY_MARK, SECRET_PLAIN, SECRETS, jvm, scan_for

KEY_STOP = "-----END PRIVATE KEY-----"


def redact_text(text: Column) -> Column:
    """Text with masks. A text without the plain parts of any credential is passed by after one scan for all of them."""
    masked = F.regexp_replace(F.regexp_replace(text, KEY_BEGIN, KEY_MARK), KEY_END, KEY_STOP)
    for _, pattern, mask, _ in SECRETS:
        if mask != KEY_MARK:
            masked = F.regexp_replace(masked, jvm(pattern), mask)
    return F.when(text.rlike(scan_for(SECRET_PLAIN)), masked).otherwise(text)


def redact_line(text: Column, in_key: Column) -> Column:
    """A line of a hunk with masks; it is masked whole where a private key begins in it or was open before it."""
    begins = text.contains("PRIVATE KEY-----") & text.rlike(KEY_BEGIN)
    return F.when(begins, KEY_MARK).when(in_key, DOTS).otherwise(redact_text(text))


def redact_lines(lines: DataFrame) -> DataFrame:
    """Lines of hunks with `redacted`: whole lines from a key's first to its last, masks elsewhere."""
    return lines.withColumn("redacted", redact_line(F.col("text"), F.col("in_key")))
