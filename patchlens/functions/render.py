"""Packets as text, Markdown, HTML and JSON: one string column each, built from a packet's columns.

Markdown and HTML of whole packets show each file's lines where the packet has them (packets(..., lines=...)), the first
80 of a file. `lang` is that of the packets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.plans.catalog import DISPOSITIONS, EMPTY_HINT, FOOTER, LABELS, ROLE_NAMES, STATUSES, WORDS

SHOWN_LINES, SUMMARY_STOPS = 80, 50
#: Terminal colours of labels and severities.
COLOURS = {"high": "31", "medium": "33", "low": "32", "calm": "2", "info": "2"}
STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto}code,pre{font-family:monospace}.add{background:#e6ffec}.del{background:#ffebe9}.tag{border:1px solid;border-radius:4px;padding:0 .4em}"
SCRIPT = "document.querySelectorAll('button').forEach(b=>b.onclick=()=>document.querySelectorAll('[data-s]').forEach(x=>x.hidden=b.value!='all'&&x.dataset.s!=b.value))"


def _said(pair: tuple[str, str], lang: str) -> str:
    return pair[lang == "pt"]


def _word(name: str, lang: str) -> Column:
    return F.lit(_said(WORDS[name], lang))


def _named(pairs: dict[str, tuple[str, str]], key: Column, lang: str) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(_said(v, lang))) for k, v in pairs.items()], key)


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _each(items: Column, one: Callable[..., Column], between: str = "\n") -> Column:
    return F.array_join(F.transform(items, one), between)


def padded(text: Column, width: int, left: bool = False) -> Column:
    """text filled up with spaces to width; a longer one stays whole."""
    filled = F.lpad(text, width, " ") if left else F.rpad(text, width, " ")
    return F.when(F.length(text) < width, filled).otherwise(text)


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def painted(text: Column, key: Column, color: bool) -> Column:
    code = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in COLOURS.items()], F.lit("1"))
    return F.concat(F.lit("\x1b["), code, F.lit("m"), text, F.lit("\x1b[0m")) if color else text


def _size(lang: str) -> Column:
    return _cat(F.col("stats.files"), f" {_said(WORDS['files'], lang).lower()} · +", F.col("stats.additions"), " −", F.col("stats.deletions"), " · ~", F.col("stats.minutes"), " min")


def text_of(lang: str = "en", color: bool = False) -> Column:
    """For a terminal; an empty packet gives a hint."""
    number = lambda f: padded(f["rank"].cast("string"), 3, left=True)
    stop = lambda f: _cat(number(f), "  ", f["path"], "\n     ", _named(DISPOSITIONS, f["disposition"], lang), " · ", f["reason"])
    found = lambda x: _cat(painted(padded(_named(LABELS, x["severity"], lang), 7), x["severity"], color), x["title"], F.when(x["path"].isNotNull(), F.concat(F.lit("  "), x["path"])), "\n       ", x["detail"])
    head = _cat(F.col("headline"), "\n", F.col("lede"), "\n\n", F.col("id"), "  ", painted(_named(LABELS, F.col("label"), lang), F.col("label"), color), " ", F.col("score"), "  ", _size(lang))
    whole = F.concat_ws("\n", head, F.lit(""), _word("order", lang), _each(F.col("files"), stop), F.lit(""), _word("findings", lang), F.when(F.size("findings") == 0, _word("none", lang)).otherwise(_each(F.col("findings"), found)), F.lit(""), F.lit(_said(FOOTER, lang)), F.lit(""))
    return F.when(F.size("files") == 0, F.lit(_said(EMPTY_HINT, lang))).otherwise(whole)


def _flat_lines(f: Column) -> Column:
    """The hunk lines of a file, each with its place in the file and, before the first of a hunk, the hunk's header."""
    def lines(h: Column) -> Column:
        head = F.rtrim(_cat("@@ -", h["old_start"], ",", h["old_count"], " +", h["new_start"], ",", h["new_count"], " @@ ", h["section"]))
        first = F.struct(F.lit("hunk").alias("kind"), head.alias("text"), F.lit(None).cast("int").alias("n"))
        row = lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), F.when(x["kind"] == "del", x["old_line"]).otherwise(x["new_line"]).alias("n"))
        return F.concat(F.array(first), F.transform(h["lines"], row))

    return F.flatten(F.transform(f["hunks"], lines))


def _shown(f: Column) -> Column:
    """What of _flat_lines is shown: up to the first line too many. cut: whether there is one."""
    flat = _flat_lines(f)
    counted = F.filter(F.transform(flat, lambda x, i: F.struct((x["kind"] != "hunk").alias("line"), i.alias("i"))), lambda x: x["line"])
    stop = F.get(counted, F.lit(SHOWN_LINES))["i"]
    return F.struct(F.when(stop.isNull(), flat).otherwise(F.slice(flat, F.lit(1), F.coalesce(stop, F.lit(0)))).alias("rows"), stop.isNotNull().alias("cut"))


def _has_hunks(files: T.DataType) -> bool:
    return isinstance(files, T.ArrayType) and "hunks" in files.elementType.names


def markdown_of(files: T.DataType | None = None, lang: str = "en", summary: bool = False) -> Column:
    """files: the type of the packets' column of that name, which tells whether there are lines. A summary has the first 50 stops and no files."""
    w = lambda name: _word(name, lang)
    item = lambda s, i: _cat(i + 1, ". `", s["path"], "` — ", _named(DISPOSITIONS, s["disposition"], lang), " · ", s["reason"])
    stops = F.slice("reading_order", 1, SUMMARY_STOPS) if summary else F.col("reading_order")
    more = F.when(F.size("reading_order") > SUMMARY_STOPS, F.format_string("\n" + _said(WORDS["more"], lang), F.size("reading_order") - SUMMARY_STOPS)) if summary else F.lit(None).cast("string")
    severity = lambda x: _cat("**", _named(LABELS, x["severity"], lang), "** ")
    found = lambda x: _cat("- ", severity(x), x["title"], F.when(x["path"].isNotNull(), _cat(" `", x["path"], "`")), " — ", x["detail"])
    counts = _cat(*[p for k, s in enumerate(("high", "medium", "low", "info")) for p in ((" · " if k else "- ") + _said(LABELS[s], lang) + " ", F.col(f"stats.counts.{s}"))])
    head = [_cat("# ", F.col("headline")), F.lit(""), F.col("lede"), F.lit(""), _cat("- `", F.col("id"), "` · ", _named(LABELS, F.col("label"), lang), " (", F.col("score"), ")"), _cat("- ", _size(lang)), counts]
    groups = lambda c: _cat("- ", c["title"], ": ", F.array_join(F.transform(c["paths"], lambda p: _cat("`", p, "`")), ", "))
    parts = [*head, F.lit(""), _cat("## ", w("order")), F.lit(""), _each(stops, item), more, F.lit(""), _cat("## ", w("clusters")), F.lit(""), _each(F.col("clusters"), groups)]
    parts += [F.lit(""), _cat("## ", w("findings")), F.lit(""), F.when(F.size("findings") == 0, w("none")).otherwise(_each(F.col("findings"), found))]
    if not summary:
        sign = {"add": "+", "del": "-", "context": " ", "hunk": ""}
        line = lambda x: F.concat(F.coalesce(*[F.when(x["kind"] == k, F.lit(v)) for k, v in sign.items()]), x["text"])

        def diff(f: Column) -> Column:
            if files is None or not _has_hunks(files):
                return F.lit(None).cast("string")
            body = F.concat_ws("\n", _each(_shown(f)["rows"], line), F.when(_shown(f)["cut"], F.lit("…")))
            return _cat("```diff\n", F.when(f["is_binary"], w("binary")).otherwise(body), "\n```")

        def file(f: Column) -> Column:
            sub = _cat(_named(STATUSES, f["status"], lang), " · ", _named(ROLE_NAMES, f["role"], lang), " · +", f["additions"], " −", f["deletions"], " · ", _named(LABELS, f["label"], lang), " ", f["score"])
            own = lambda x: _cat("- ", severity(x), x["title"], ". ", x["detail"])
            return F.concat_ws("\n", _cat("### `", f["path"], "`"), F.lit(""), sub, F.when(f["previous_path"].isNotNull(), _cat("\n", w("was"), " `", f["previous_path"], "`.")), F.when(F.size(f["findings"]) > 0, _cat("\n", _each(f["findings"], own))), F.lit(""), diff(f))

        parts += [F.lit(""), _cat("## ", w("files")), F.lit(""), _each(F.col("files"), file, "\n\n")]
    return F.concat_ws("\n", *parts, F.lit(""), F.lit("---"), F.lit(_said(FOOTER, lang)), F.lit(""))


def escaped(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def html_of(files: T.DataType | None = None, lang: str = "en") -> Column:
    """A page of its own, with buttons that show the findings of one severity."""
    w = lambda name: _word(name, lang)
    tag = lambda key, pairs: _cat('<span class="tag">', escaped(_named(pairs, key, lang)), "</span> ")
    stop = lambda s, i: _cat('<li><a href="#f', i + 1, '"><code>', escaped(s["path"]), "</code></a> ", tag(s["disposition"], DISPOSITIONS), escaped(s["reason"]), "</li>")
    found = lambda x: _cat('<p data-s="', x["severity"], '">', tag(x["severity"], LABELS), "<b>", escaped(x["title"]), "</b> ", F.when(x["path"].isNotNull(), _cat("<code>", escaped(x["path"]), "</code> ")), escaped(x["detail"]), "</p>")
    button = lambda s: _cat(f'<button value="{s}"', F.when(F.col(f"stats.counts.{s}") == 0, F.lit(" disabled")), ">", capital(F.lit(_said(LABELS[s], lang))), " ", F.col(f"stats.counts.{s}"), "</button>")
    sign = {"add": "+", "del": "−", "context": " ", "hunk": ""}
    line = lambda x: _cat('<div class="', x["kind"], '">', x["n"], " ", F.coalesce(*[F.when(x["kind"] == k, F.lit(v)) for k, v in sign.items()]), escaped(x["text"]), "</div>")

    def diff(f: Column) -> Column:
        if files is None or not _has_hunks(files):
            return F.lit("")
        shown = _cat(_each(_shown(f)["rows"], line, ""), F.when(_shown(f)["cut"], w("cut")))
        return _cat("<pre>", F.when(f["is_binary"], w("binary")).when(F.size(f["hunks"]) == 0, w("no hunks")).otherwise(shown), "</pre>")

    def file(f: Column, i: Column) -> Column:
        own = lambda x: _cat("<p>", tag(x["severity"], LABELS), "<b>", escaped(x["title"]), ".</b> ", escaped(x["detail"]), "</p>")
        sub = _cat(_named(STATUSES, f["status"], lang), " · ", _named(ROLE_NAMES, f["role"], lang), " · +", f["additions"], " −", f["deletions"], " · ", _named(LABELS, f["label"], lang), " ", f["score"])
        return _cat('<section id="f', i + 1, '"><h3>', escaped(f["path"]), "</h3><p>", sub, "</p>", F.when(f["previous_path"].isNotNull(), _cat("<p>", w("was"), " ", escaped(f["previous_path"]), "</p>")), _each(f["findings"], own, ""), diff(f), "</section>")

    made = F.replace(F.substring("generated_at", 1, 16), F.lit("T"), F.lit(" "))
    head = _cat(f'<!doctype html><html lang="{"pt-BR" if lang == "pt" else "en"}"><meta charset="utf-8"><title>', escaped(F.col("headline")), f"</title><style>{STYLE}</style><p>", F.col("id"), " · ", made, " · ", F.col("order"), "</p><h1>", escaped(F.col("headline")), "</h1><p>", escaped(F.col("lede")), "</p><p>", _size(lang), " · ", tag(F.col("label"), LABELS), F.col("score"), "</p>")
    buttons = _cat(f'<p><button value="all">{_said(WORDS["all"], lang)}</button>', *[button(s) for s in ("high", "medium", "low", "info")], "</p>")
    return _cat(
        head, "<h2>", w("order"), "</h2><ol>", _each(F.col("reading_order"), stop, ""), "</ol><h2>", w("findings"), "</h2>", buttons,
        F.when(F.size("findings") == 0, _cat("<p>", w("none"), "</p>")).otherwise(_each(F.col("findings"), found, "")), "<h2>", w("files"), "</h2>", _each(F.col("files"), file, ""),
        "<footer>", escaped(F.lit(_said(FOOTER, lang))), f"</footer><script>{SCRIPT}</script></html>\n",
    )


PACKET_COLUMNS = ["version", "id", "language", "order", "generated_at", "headline", "lede", "stats", "files", "clusters", "findings", "reading_order"]


def json_of(hunks: bool = True, files: T.DataType | None = None) -> Column:
    """The whole packet; without hunks, lines are left out where the packet has them."""
    rows = F.col("files")
    if not hunks and files is not None and _has_hunks(files):
        rows = F.transform("files", lambda f: f.dropFields("hunks"))
    return F.to_json(F.struct(*[rows.alias(c) if c == "files" else F.col(c) for c in PACKET_COLUMNS]), {"pretty": "true", "ignoreNullFields": "false"})
