"""Format-preserving pseudonyms by keyed Feistel networks.

Personal data found in texts is replaced by a value of the same format: a keyed permutation of all values of that format,
so equal values get equal pseudonyms in every document and unequal ones never meet. Values are validated first (check
digits, octets, calendar dates, number ranges); what fails stays as it is. Separators keep their places, a card number
keeps a valid check digit, a date stays a date.

A value's characters are split into two halves. Each round adds a keystream, made from the other half and the secret key,
to one half, character by character within its class (digit, lower-case, upper-case or hex letter): an unbalanced Feistel
network with modular addition, hence a bijection. All of it is SQL expressions over the matches of a document; a text
without a trigger character is passed by after one scan.

The key is a secret of its own: `pseudonymise` has no default for it. The registered query and the pipeline read it from the
session setting `patchlens.pii.secret` (or `patchlens.pii.key`, whose value Spark does not mask in its logs as it does that of a
setting so named); where both are unset, a random one is drawn and kept for the application, in no setting, so values are linked
within it and nobody can invert them later. Expressions get the key as data, by a scalar subquery over a table of one row: it is no
literal of the plan, and so in no plan, UI or event log.

Defined cases: null text stays null and an empty one empty; texts of any length are worked whole; repeated rows give
repeated results; an empty table gives an empty result; other columns pass through, whatever their names are, but for
`_n_replaced`, which is replaced. An address whose octets have leading zeros becomes one of the same widths.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import DOCUMENT_COLUMNS, table, with_columns_of

ROUNDS = 8
#: What names a secret, in any case; what stands between name and value; the value. After '=' a password may be any word;
#: elsewhere a value has a digit or is hex, so that prose after a colon is left alone.
_PASSWORD = "password|passwd|pwd"
_NAMED = f"{_PASSWORD}|secret|token|api[_-]?key"
_IS, _VALUE = r"[\"']? {0,3}[=:] {0,3}[\"']?", r"[^\s\"'<>,;]{8,}"
#: What is looked for, in order of precedence where several start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": rf"(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|(?i:{_PASSWORD}){_IS.replace(':', '')}{_VALUE}|(?i:{_NAMED}){_IS}(?=[^\s\"'<>,;]*[0-9]|[0-9a-fA-F]{{16}}){_VALUE}",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?:/[0-9]{2}/|-[0-9]{2}-)[0-9]{4})(?![0-9/-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
    r"|(?<![0-9A-Za-z+])\+(?=(?:[ .()-]{0,2}[0-9]){8})[0-9]{1,15}(?:[ .-]?\([0-9]{1,5}\)[ .-]?[0-9]{1,6}|[ .-][0-9]{1,6}){0,5}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
PATTERN = "|".join(PATTERNS.values())
#: A text with none of these holds none of the above.
TRIGGER = f"[0-9@]|AKIA|(?i:{_NAMED})"
#: Dates are permuted among this many days from FIRST_DAY (1900-01-01 to 2099-10-03); 256 x 285.
FIRST_DAY, DAYS = "1900-01-01", 256 * 285
#: The other dates of the years 1 to 9999 are permuted among themselves: so many days before FIRST_DAY, and so many in all.
DAYS_BEFORE, FAR_DAYS = 693_595, 3_652_059 - DAYS


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hex_at(digest: Column, i: Column) -> Column:
    """Two hex digits of a digest as a number, i from 0."""
    return F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _added(text: Column, digest: Column, letters: str) -> Column:
    """text with the digest's bytes added to its characters, each within its class. letters: last letter of a class (z, or f for hex)."""

    def one(i: Column) -> Column:
        c = F.substr(text, i + 1, F.lit(1))
        code, add = F.ascii(c), _hex_at(digest, F.pmod(i, F.lit(32)))
        low, span = ord("a"), ord(letters) - ord("a") + 1
        return (
            F.when(c.between("0", "9"), F.char(F.lit(48) + (code - 48 + add) % 10))
            .when(c.between("a", letters), F.char(F.lit(low) + (code - low + add) % span))
            .when(c.between("A", "Z"), F.char(F.lit(65) + (code - 65 + add) % 26))
            .otherwise(c)
        )

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), ""))


def feistel(text: Column, key: str | Column, tweak: str, letters: str = "z") -> Column:
    """The keyed permutation of text among the texts of its format. A text of one character is only shifted."""
    n = F.length(text)
    half = F.ceil(n / F.lit(2)).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, n).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), acc["r"]), 256)
        return F.struct(acc["r"].alias("l"), _added(acc["l"], digest, letters).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def feistel_number(value: Column, left: int | Column, right: int | Column, key: str | Column, tweak: str) -> Column:
    """The keyed permutation of the numbers 0 to left * right - 1."""
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))
    start = F.struct((value / right).cast("long").alias("l"), (value % right).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        def drawn(other: Column, most: Column) -> Column:
            return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long") % most

        return F.when(i % 2 == 1, F.struct(((acc["l"] + drawn(acc["r"], left)) % left).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), ((acc["r"] + drawn(acc["l"], right)) % right).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["l"] * right + acc["r"])


def _other_day(offset: Column, key: str | Column) -> Column:
    """The keyed permutation of days, as offsets from FIRST_DAY: near ones become near ones, far ones far ones."""
    rank = F.when(offset < 0, offset + DAYS_BEFORE).otherwise(offset - DAYS + DAYS_BEFORE)
    step = lambda x: feistel_number(x, 1892, 1892, key, "far date")  # noqa: E731  1892 x 1892 is 565 more than FAR_DAYS
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), step(rank), lambda acc, _: F.when(acc < FAR_DAYS, acc).otherwise(step(acc)))
    far = _once(walked, lambda x: F.when(x < DAYS_BEFORE, x - DAYS_BEFORE).otherwise(x - DAYS_BEFORE + DAYS))
    return F.when(offset.between(0, DAYS - 1), feistel_number(offset, 256, DAYS // 256, key, "date")).otherwise(far)


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counted once."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(digits: Column, form: Column, skip: Column) -> Column:
    """form with its digits, after the first `skip`, replaced by digits in order."""

    def filled(d: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substr(form, i, F.lit(1))
            at = F.length(_digits(F.substr(form, F.lit(1), i)))
            return F.when(c.between("0", "9") & (at > skip), F.substr(d, at - skip, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")

    return _once(digits, filled)


def pseudonym(found: Column, key: str | Column) -> Column:
    """What a match of PATTERN becomes; itself where validation fails."""
    digits = _digits(found)
    n = F.length(digits)

    def like(kind: str) -> Column:
        return found.rlike(rf"\A(?:{PATTERNS[kind]})\z")

    local = F.regexp_extract(found, "^([^@]*)@", 1)
    email = F.concat(feistel(local, key, "email"), F.regexp_extract(found, "(@.*)$", 1))
    named = rf"(?s)\A((?i:{_NAMED}){_IS})(.*)\z"

    def disguised(value: Column) -> Column:
        def step(x: Column) -> Column:
            return feistel(x, key, "secret")

        hexes = "^([0-9a-f]+|[0-9A-F]+)$"
        lower = feistel(F.lower(value), key, "secret", "f")
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), step(value), lambda acc, _: F.when(acc.rlike(hexes), step(acc)).otherwise(acc))
        return F.when(value.rlike("^[0-9a-f]+$"), lower).when(value.rlike("^[0-9A-F]+$"), F.upper(lower)).otherwise(walked)

    key_of = F.concat(F.lit("AKIA"), feistel(F.substr(found, F.lit(5)), key, "access key"))
    secret = F.when(found.startswith("AKIA"), key_of).otherwise(F.concat(F.regexp_extract(found, named, 1), _once(F.regexp_extract(found, named, 2), disguised)))

    iso = found.substr(5, 1) == "-"
    mark = F.substr(found, F.lit(3), F.lit(1))
    slashed = F.replace(found, F.lit("-"), F.lit("/"))
    day_first = F.try_to_timestamp(slashed, F.lit("dd/MM/yyyy"))
    month_first = ~iso & day_first.isNull()
    day = F.when(iso, F.try_to_timestamp(found, F.lit("yyyy-MM-dd"))).otherwise(F.coalesce(day_first, F.try_to_timestamp(slashed, F.lit("MM/dd/yyyy")))).cast("date")
    to_day = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))

    def dated(offset: Column) -> Column:
        # a date that can only be read month first becomes another such date, so no two texts meet
        once = _other_day(offset, key)
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(40)), once, lambda acc, _: F.when(F.dayofmonth(to_day(acc)) > 12, acc).otherwise(_other_day(acc, key)))
        other = F.when(month_first, F.date_format(to_day(walked), "MM/dd/yyyy")).otherwise(F.date_format(to_day(once), "dd/MM/yyyy"))
        shown = F.when(iso, F.date_format(to_day(once), "yyyy-MM-dd")).otherwise(F.replace(other, F.lit("/"), mark))
        return F.when(offset >= -DAYS_BEFORE, shown).otherwise(found)

    date = _once(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), dated)

    skip = F.greatest(F.lit(0), F.least(n - 9, F.lit(4)))
    phone = _laid_out(feistel(F.substr(digits, skip + 1, n), key, "phone"), found, skip)

    def ssn_valid(d: Column) -> Column:
        return ~d.rlike("^(000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), feistel(digits, key, "ssn"), lambda acc, _: F.when(ssn_valid(acc), acc).otherwise(feistel(acc, key, "ssn")))
    ssn = F.when(ssn_valid(digits), _laid_out(walked, found, F.lit(0))).otherwise(found)

    # an octet that begins with 0 keeps its width, so it has 100 or 10 values; the halves are the pairs of octets
    octets = F.transform(F.split(found, r"\."), lambda x: F.struct(x.cast("long").alias("v"), F.when((F.length(x) > 1) & x.startswith("0"), F.when(F.length(x) == 3, 100).otherwise(10)).otherwise(256).cast("long").alias("of"), F.length(x).alias("w")))

    def other_ip(o: Column) -> Column:
        of = [o[i]["of"] for i in range(4)]
        left, right = of[0] * of[1], of[2] * of[3]
        number = (o[0]["v"] * of[1] + o[1]["v"]) * right + o[2]["v"] * of[3] + o[3]["v"]

        def shown(m: Column) -> Column:
            parts = [F.floor(m / (right * of[1])), F.floor(m / right) % of[1], F.floor(m / of[3]) % of[2], m % of[3]]
            texts = [F.when(of[i] == 256, x.cast("string")).otherwise(F.lpad(x.cast("string"), o[i]["w"], F.lit("0"))) for i, x in enumerate(parts)]
            return F.concat_ws(".", *texts)

        return F.when(~F.exists(o, lambda x: x["v"] > 255), _once(feistel_number(number, left, right, key, "ip"), shown)).otherwise(found)

    ip = _once(octets, other_ip)

    body = feistel(F.substr(digits, F.lit(1), n - 1), key, "card")
    checked = _once(body, lambda b: F.concat(b, ((F.lit(10) - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    card = F.when(_luhn_sum(digits) % 10 == 0, _laid_out(checked, found, F.lit(0))).otherwise(found)

    return (
        F.when(found.rlike(rf"\A(?:AKIA[A-Z0-9]{{16}}\z|(?i:{_NAMED}){_IS}{_VALUE})"), secret)
        .when(found.contains("@"), email)
        .when(like("date"), date)
        .when(like("ip"), ip)
        .when(like("ssn"), ssn)
        .when(like("phone"), phone)
        .when(like("card"), card)
        .otherwise(found)
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with the personal data in `column` replaced; adds _n_replaced."""
    text = F.col(column)
    hit = text.rlike(TRIGGER)
    found = F.when(hit, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # the steps are fields of one struct, so no column of docs is overwritten
    kept = [c for c in docs.columns if c not in (column, "_n_replaced")]
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), text.alias("text"), found.alias("found"), hidden(docs.sparkSession, key).alias("key"))
    rows = rows.withColumn("new", F.transform("found", lambda x: pseudonym(x, F.col("key"))))
    rest = F.when(F.size("found") > 0, F.split("text", PATTERN, -1))
    rows = rows.withColumn("rest", rest)
    woven = F.concat(F.flatten(F.zip_with(F.slice("rest", F.lit(1), F.size("new")), F.col("new"), lambda a, b: F.array(a, b))), F.array(F.element_at("rest", -1)))
    changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda x: x["found"] != x["new"]))
    some = F.size("found") > 0
    names = {c: F.col("row")[c] for c in kept} | {column: F.when(some, F.array_join(woven, "")).otherwise(F.col("text"))}
    return rows.select(*[names[c].alias(c) for c in docs.columns if c != "_n_replaced"], F.when(some, changed).otherwise(0).alias("_n_replaced"))


def hidden(spark: SparkSession, key: str) -> Column:
    """The key as a value that plans refer to and don't show."""
    return spark.createDataFrame([(key,)], "k string").scalar()


#: Keys drawn, by application.
_DRAWN: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The setting patchlens.pii.secret or patchlens.pii.key; where they are unset, a random key kept for the application."""
    for name in ("patchlens.pii.secret", "patchlens.pii.key"):
        if given := spark.conf.get(name, None):
            return given
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", F.col("_n_replaced").alias("n_replaced"))


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """documents with pseudonyms; n_chars follows the new text."""
    out = pseudonymise(with_columns_of(docs), key or session_key(docs.sparkSession))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*DOCUMENT_COLUMNS)
