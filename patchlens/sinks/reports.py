"""Packets to files: a folder for each format, in it one for each patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.render import html_of, json_of, markdown_of, text_of


def bodies(packets: DataFrame, lang: str = "en") -> dict[str, Column]:
    """The column of each format."""
    files = packets.schema["files"].dataType
    return {"html": html_of(files, lang), "md": markdown_of(files, lang), "json": json_of(), "text": text_of(lang)}


def write_reports(packets: DataFrame, path: str, formats: tuple[str, ...] = ("html", "md", "json", "text"), lang: str = "en") -> None:
    """One file for each patch and format, at path/format/patch_id=.../; folders are made, old reports replaced.

    The packets are worked out once, with all formats side by side, and kept in memory or on disk while they are written.
    """
    columns = bodies(packets, lang)
    unknown = set(formats) - set(columns)
    if unknown:
        raise ValueError(f"no such format: {', '.join(sorted(unknown))}")
    made = packets.select("patch_id", *[columns[f].alias(f) for f in formats]).persist()
    for f in formats:
        made.select("patch_id", F.col(f).alias("value")).write.mode("overwrite").partitionBy("patch_id").text(f"{path}/{f}")
    made.unpersist()


def append_summaries(packets: DataFrame, path: str, lang: str = "en") -> None:
    """Adds each packet's summary, in Markdown, to the text files under path."""
    packets.select(markdown_of(lang=lang, summary=True).alias("value")).write.mode("append").text(path)
