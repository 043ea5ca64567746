"""Unified diffs to files, hunks and lines.

A patch is split into files at their headers, and a file into sections at its @@ lines, by two splits with a look-ahead. What
is asked of a whole file (paths, status, added and removed lines) is then worked out on the arrays of its row: no shuffle and
no sort. Lines are numbered by segmented prefix sums: a hunk's lines are cut into blocks, the blocks' sums (old and new lines,
the last line that begins or ends a private key) are scanned within the hunk's row, and each block goes on as a row of its own
that counts from its start. So texts are never moved; with spread, blocks are dealt over tasks, also those of one hunk.

Numbers in headers that don't fit 32 bits are null, and so are line numbers that follow from them. A null text is an empty
patch. `part` names a row by its content, so rows that share a patch_id, or have none, keep their files apart; a row that is
repeated whole has the same part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.patterns import KEY_BEGIN, KEY_END, jvm, trimmed
from patchlens.functions.steps import Step, built_once, once

HUNK = jvm(r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@(.*)$")
TOKEN = r'("(?:[^"\\]|\\.)*"?|[^ ]+)'
BINARY = "\nGIT binary patch"
BLOCK = 128
#: What the lines before a line amount to: old and new lines, and whether a private key is open (null: none was seen).
RUN = "struct<old:int,new:int,key:boolean>"


def _count(raw: Column, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, HUNK, group), F.lit("")), F.lit("1")).try_cast("int")


def _bare(path: Column) -> Column:
    """A path without quotes, escapes and the a/ or b/ in front; null for an empty one."""
    plain = F.when(path.startswith('"'), F.regexp_replace(F.regexp_replace(path, r'(?s)\A"((?:[^"\\]|\\.)*)"?\z', "$1"), r"(?s)\\(.)", "$1")).otherwise(path)
    return F.regexp_replace(F.nullif(plain, F.lit("")), r"\A[ab]/", "")


def _named(raw: Column) -> Column:
    """The path of a --- or +++ line, without a pair of quotes around it; null for /dev/null."""
    path = F.regexp_replace(F.regexp_replace(trimmed(F.substr(raw, F.lit(5))), r"(?s)\t.*\z", ""), r'(?s)\A"(.*)"\z', "$1")
    return F.when(path != "/dev/null", F.regexp_replace(path, r"\A[ab]/", ""))


def _starts(*words: str) -> Callable[[Column], Column]:
    def one(x: Column) -> Column:
        out = x.startswith(words[0])
        for w in words[1:]:
            out = out | x.startswith(w)
        return out

    return one


def _body(section: Column) -> Column:
    """The lines of a section without its first."""
    lines = F.split(section, "\n", -1)
    return F.slice(lines, F.lit(2), F.size(lines))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has; with a number, Spark doesn't put them together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def split_files(patches: DataFrame, spread: bool = False) -> DataFrame:
    """patches(patch_id, text) -> patch_id, part, id, n_files, file_no, sections, and options, if patches have them; file_no 0 is what stands before the first file.

    part and id name the row by its content, n_files counts its files. sections: hunk (whether its first line is a valid @@ line) and text; of a file with a
    binary body nothing after the mark of it. With spread, files are dealt out over tasks, for few patches of many files.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    whole = F.when(whole.endswith("\n"), F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    chunks = F.split(F.concat(F.lit("\n"), whole), r"\n(?=diff --(?:git|cc) )", -1)
    own = ["options"] if "options" in patches.columns else []
    # all that is asked of a whole patch, before its files become rows: what stands beside an explode is worked out for each of them
    rows = patches.select("patch_id", *own, F.sha2(text, 256).alias("_sha"), chunks.alias("_chunks"))
    rows = rows.select("patch_id", *own, F.conv(F.substring("_sha", 1, 15), 16, 10).cast("long").alias("part"), F.substring("_sha", 1, 8).alias("id"), (F.size("_chunks") - 1).alias("n_files"), once(F.col("_chunks")).alias("_chunks"))
    rows = rows.select("patch_id", *own, "part", "id", "n_files", F.posexplode("_chunks").alias("file_no", "chunk"))
    if spread:
        rows = _dealt(rows, "patch_id", "part", "file_no")
    return sectioned(rows)


def sectioned(rows: DataFrame) -> DataFrame:
    """Rows with a file's text in `chunk`, the preamble's where file_no is 0 -> the same with its sections instead."""
    keys = [c for c in rows.columns if c != "chunk"]
    parts = F.split("chunk", r"\n(?=@@)", -1)
    sections = F.transform(parts, lambda s, i: F.struct(((i > 0) & F.substring_index(s, "\n", 1).rlike(HUNK)).alias("hunk"), s.alias("text")))
    rows = rows.select(*keys, F.when(F.col("file_no") > 0, sections).alias("sections"), F.col("chunk").contains(BINARY).alias("_binary"))
    marked = F.array_position(F.transform("sections", lambda s: ~s["hunk"] & s["text"].contains(BINARY)), True).cast("int")
    rows = rows.withColumn("_cut", F.when(F.col("_binary"), marked).otherwise(0))
    last = F.get("sections", F.col("_cut") - 1)
    cut = F.concat(F.slice("sections", F.lit(1), F.greatest(F.col("_cut") - 1, F.lit(0))), F.array(F.struct(last["hunk"].alias("hunk"), F.concat(F.substring_index(last["text"], BINARY, 1), F.lit(BINARY)).alias("text"))))
    return rows.select(*keys, F.when(F.col("_cut") > 0, cut).otherwise(F.col("sections")).alias("sections"))


def diff_files(patches: DataFrame, spread: bool = False, lines: int | None = None) -> DataFrame:
    """One row for each file, with its added and removed lines in order, and one with file_no 0 for each row of patches.

    lines: how many lines each file has in `hunks`, and one more if there are more; 0 for all; None for no such column.
    """
    return files_in(split_files(patches, spread), lines)


def files_in(rows: DataFrame, lines: int | None = None) -> DataFrame:
    """Rows with sections -> what diff_files() has, beside their other columns."""
    keys = [c for c in rows.columns if c != "sections"]
    if lines is not None:
        rows = rows.withColumn("hunks", _hunks_of(lines))
        keys.append("hunks")
    for step in _file_columns():
        rows = rows.select(*keys, *[c.alias(n) for n, c in step.items()])
    return rows


def _text(raw: Column) -> Column:
    return F.when(raw.rlike(r"\A[+\- ]"), F.substr(raw, F.lit(2))).otherwise(raw)


def _after(run: Column, raw: Column) -> Column:
    """The run with one line more."""
    counts = ~raw.startswith("\\")
    key = F.when(counts & raw.contains("PRIVATE KEY-----"), F.when(_text(raw).rlike(KEY_BEGIN), True).when(_text(raw).rlike(KEY_END), False))
    return F.struct(
        (run["old"] + (counts & ~raw.startswith("+")).cast("int")).alias("old"), (run["new"] + (counts & ~raw.startswith("-")).cast("int")).alias("new"),
        F.coalesce(key, run["key"]).alias("key"),
    )


def _plus(a: Column, b: Column) -> Column:
    return F.struct((a["old"] + b["old"]).alias("old"), (a["new"] + b["new"]).alias("new"), F.coalesce(b["key"], a["key"]).alias("key"))


def _zipped(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.lit(None).cast("boolean").alias("key"))


def _scanned(items: Column, start: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each item what stands before it: start, start plus the first item, and so on."""
    begin = F.struct(start.cast(RUN).alias("run"), F.array().cast(f"array<{RUN}>").alias("out"))
    return F.aggregate(items, begin, lambda a, x: F.struct(plus(a["run"], x).cast(RUN).alias("run"), F.array_append(a["out"], a["run"]).alias("out")), lambda a: a["out"])


def _blocks(body: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(body), F.lit(1)) - 1) / F.lit(BLOCK)).cast("int")), lambda j: F.slice(body, j * BLOCK + 1, F.lit(BLOCK)))


def _starts_of(blocks: Column) -> Column:
    """The run that each block starts with; a hunk of one block needs no sums."""
    total = lambda b: F.aggregate(b, _nothing().cast(RUN), lambda a, x: _after(a, x).cast(RUN))
    return F.when(F.size(blocks) > 1, _scanned(F.transform(blocks, total), _nothing(), _plus)).otherwise(F.array(_nothing().cast(RUN)))


def _numbered(block: Column, start: Column, base: Column, old_start: Column, new_start: Column) -> Column:
    """A block's lines as structs; base: lines of the hunk before it. Lines that only comment are left out."""
    runs = _zipped(block, _scanned(block, start, _after))

    def number(at: Column, first: Column, own: Column) -> Column:
        return F.when(own, (first.cast("long") + at).try_cast("int"))

    def line(x: Column, i: Column) -> Column:
        raw, run = x["a"], x["b"]
        kind = F.when(raw.startswith("+"), "add").when(raw.startswith("-"), "del").otherwise("context")
        return F.struct(
            (base + i).alias("line_no"), kind.alias("kind"), _text(raw).alias("text"), number(run["old"], old_start, ~raw.startswith("+")).alias("old_line"),
            number(run["new"], new_start, ~raw.startswith("-")).alias("new_line"), F.coalesce(run["key"], F.lit(False)).alias("in_key"), raw.startswith("\\").alias("note"),
        )

    return F.transform(F.filter(F.transform(runs, line), lambda x: ~x["note"]), lambda x: x.dropFields("note"))


def _hunks_of(most: int) -> Column:
    """A file's hunks with their numbered lines: those that begin within its first `most` lines, and of these one line more at most. 0: all.

    Which lines are needed is known from the hunks' sizes, so no others are made.
    """
    head = lambda s: F.substring_index(s["text"], "\n", 1)
    raw = F.transform(F.filter("sections", lambda s: s["hunk"]), lambda s, i: F.struct((i + 1).alias("hunk_no"), head(s).alias("head"), _body(s["text"]).alias("body")))
    if most:
        raw = F.transform(raw, lambda h: h.withField("body", F.filter(h["body"], lambda x: ~x.startswith("\\"))))
        sizes = F.transform(raw, lambda h: F.struct(F.size(h["body"]).alias("old"), F.lit(0).alias("new"), F.lit(None).cast("boolean").alias("key")).cast(RUN))
        near = F.filter(_zipped(raw, _scanned(sizes, _nothing(), _plus)), lambda z: z["b"]["old"] <= most)
        raw = F.transform(near, lambda z: z["a"].withField("body", F.slice(z["a"]["body"], F.lit(1), most + 1 - z["b"]["old"])))

    def whole(h: Column) -> Column:
        numbers = [_count(h["head"], k).alias(n) for k, n in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)]
        blocks = _blocks(h["body"])
        lines = F.flatten(F.transform(_zipped(blocks, _starts_of(blocks)), lambda z, j: _numbered(z["a"], z["b"], j * BLOCK, _count(h["head"], 1), _count(h["head"], 3))))
        return F.struct(h["hunk_no"].alias("hunk_no"), *numbers, trimmed(F.regexp_extract(h["head"], HUNK, 5)).alias("section"), lines.alias("lines"))

    return F.transform(raw, whole)


@built_once
def _file_columns() -> list[Step]:
    """What diff_files() works out of a file's sections, step by step."""
    heads = F.flatten(F.transform(F.filter("sections", lambda s: ~s["hunk"]), lambda s: _body(s["text"])))
    body = F.filter(F.flatten(F.transform(F.filter("sections", lambda s: s["hunk"]), lambda s: _body(s["text"]))), lambda x: ~x.startswith("\\"))
    first = F.substring_index(F.get("sections", F.lit(0))["text"], "\n", 1)
    sections = {"_first": first, "_heads": heads, "_body": body, "n_hunks": F.size(F.filter("sections", lambda s: s["hunk"]))}
    tokens = F.regexp_extract_all(F.substr("_first", F.lit(len("diff --git ") + 1)), F.lit(TOKEN), F.lit(1))
    some = lambda *words: F.exists("_heads", _starts(*words))
    last = lambda *words: F.try_element_at(F.filter("_heads", _starts(*words)), F.lit(-1))

    def path(side: int, verb: str, mark: str) -> Column:
        line = last(f"rename {verb} ", f"copy {verb} ", mark)
        given = F.when(F.col("_first").startswith("diff --git "), _bare(F.get(tokens, F.lit(side))))
        return F.when(line.isNull(), given).when(line.startswith(mark), _named(line)).otherwise(trimmed(F.regexp_replace(line, rf"\A\w+ {verb} ", "")))

    texts = lambda sign: F.transform(F.filter("_body", lambda x: x.startswith(sign)), lambda x: F.substr(x, F.lit(2)))
    parts = {
        "n_hunks": F.col("n_hunks"), "old_path": path(0, "from", "--- "), "new_path": path(1, "to", "+++ "), "_copied": some("copy from ", "copy to "), "_renamed": some("rename from ", "rename to "),
        "_deleted": some("deleted file mode "), "_new": some("new file mode "), "is_binary": some("Binary files ", "GIT binary patch"),
        "similarity": F.regexp_extract(last("similarity index "), r"([0-9]+)%", 1).try_cast("int"), "add_texts": texts("+"), "del_texts": texts("-"),
    }
    status = (
        F.when(F.col("_copied"), "copied").when(F.col("_renamed"), "renamed")
        .when(F.col("_deleted") | (F.col("new_path").isNull() & F.col("old_path").isNotNull()), "deleted")
        .when(F.col("_new") | (F.col("old_path").isNull() & F.col("new_path").isNotNull()), "added").otherwise("modified")
    )
    whole = F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")), F.lit("(unknown)"))
    kept = {c: F.col(c) for c in ("n_hunks", "old_path", "new_path", "is_binary", "similarity", "add_texts", "del_texts")}
    out = kept | {"status": status, "path": whole, "additions": F.size("add_texts"), "deletions": F.size("del_texts")}
    return [sections, parts, out | {"previous_path": F.when(F.col("old_path") != whole, F.col("old_path"))}]


def diff_hunks(patches: DataFrame, spread: bool = False) -> DataFrame:
    """One row for each hunk: its place, its numbers, its section and its lines as they stand."""
    return hunks_in(split_files(patches, spread))


def hunks_in(rows: DataFrame) -> DataFrame:
    hunks = F.filter("sections", lambda s: s["hunk"])
    rows = rows.where("file_no > 0").select("patch_id", "part", "file_no", F.posexplode(hunks).alias("at", "section"))
    rows = rows.select("patch_id", "part", "file_no", (F.col("at") + 1).alias("hunk_no"), F.substring_index("section.text", "\n", 1).alias("_raw"), _body(F.col("section.text")).alias("body"))
    numbers = [_count(F.col("_raw"), k).alias(n) for k, n in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)]
    return rows.select("patch_id", "part", "file_no", "hunk_no", *numbers, trimmed(F.regexp_extract("_raw", HUNK, 5)).alias("section"), "body")


def diff_lines(patches: DataFrame, spread: bool = False) -> DataFrame:
    """One row for each line of a hunk, with its numbers in the old and the new file. in_key: a private key was open before it."""
    return lines_in(split_files(patches, spread), spread)


def lines_in(rows: DataFrame, spread: bool = False) -> DataFrame:
    hunks = hunks_in(rows).select("patch_id", "part", "file_no", "hunk_no", "old_start", "new_start", _blocks(F.col("body")).alias("blocks"))
    keys = ["patch_id", "part", "file_no", "hunk_no"]
    blocks = hunks.select(*keys, "old_start", "new_start", F.posexplode(_zipped(F.col("blocks"), _starts_of(F.col("blocks")))).alias("block", "z"))
    if spread:
        blocks = _dealt(blocks, *keys, "block")
    lines = _numbered(F.col("z.a"), F.col("z.b"), F.col("block") * BLOCK, F.col("old_start"), F.col("new_start"))
    return blocks.select(*keys, F.inline(lines))
