"""Registered queries over a corpus of patches made from documents, and their SQL.

The SQL works on documents directly and never parses a patch, so it holds the parser and all that follows against another
derivation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions.patterns import DOTS, KEY_MARK
from patchlens.functions.render import SHOWN_LINES, html_of, json_of, markdown_of, text_of
from patchlens.operators.packet import files_of, findings_of, packets, review
from patchlens.functions.staging import staged
from patchlens.operators.parse import diff_files, diff_hunks, diff_lines, files_in, sectioned
from patchlens.operators.redact import redact_lines
from patchlens.operators.requests import review_requests
from patchlens.operators.rules import Options, assessed
from patchlens.operators.wide import merged, missing_tests, wide_clusters, wide_files, wide_packets
from patchlens.plans.catalog import CLUSTER_TITLES, DETAILS, DISPOSITIONS, FOOTER, HEADLINES, LABELS, LEDE, ROLE_NAMES, STATUSES, TITLES, WORDS
from patchlens.sources.large import read_sections, write_joined
from patchlens.sources.patches import DELETED_FILE, MARKERS, NEW_FILE, ODD, PATHS, corpus, named_corpus, odd_corpus

OPTIONS = Options(budget_minutes=5)
#: Files that all patches are put into, to be read in splits.
LARGE = 8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(_documents(spark, sf_dir))


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_lines(_patches(spark, sf_dir)).select("patch_id", "file_no", F.col("hunk_no").cast("long").alias("hunk_no"), "kind", F.md5("text").alias("text_md5"), "old_line", "new_line")


def parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = diff_files(_patches(spark, sf_dir)).where("file_no > 0")
    return files.select("patch_id", "file_no", "path", "old_path", "new_path", "status", "is_binary", "additions", "deletions", "n_hunks")


def parse_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = diff_hunks(odd_corpus(_documents(spark, sf_dir)))
    return hunks.select("patch_id", "hunk_no", "old_start", "old_count", "new_start", "new_count", "section", F.size("body").alias("n_lines"))


def odd_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, copies, binary bodies, quoted paths, CR LF, combined diffs, numbers out of range, white space, mode changes."""
    files = files_of(odd_corpus(_documents(spark, sf_dir)))
    return files.select("patch_id", "path", "old_path", "new_path", "previous_path", "status", "is_binary", "similarity", "additions", "deletions", "n_hunks", F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule_id"])), ",").alias("rules"))


def packet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(odd_corpus(_documents(spark, sf_dir)), Options(fail_on="low", now="2024-05-31T12:00:00.000Z")).select("patch_id", "id", "n_files", "gate_failed", "generated_at", "version")


def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(_patches(spark, sf_dir), OPTIONS)
    rules = F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule_id"])), ",")
    return files.select("patch_id", "file_no", "path", F.array_join("roles", ",").alias("roles"), "role", "stem", "cluster", rules.alias("rules"), "score", "label", "band", "disposition", "rank")


def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files_of(_patches(spark, sf_dir), OPTIONS).select("patch_id", "path", F.explode("findings").alias("f"))
    return rows.select("patch_id", "path", "f.rule_id", "f.severity", "f.weight")


def packet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(packets(_patches(spark, sf_dir), OPTIONS))


def packet_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(_patches(spark, sf_dir), OPTIONS).select("patch_id", F.posexplode("clusters").alias("at", "c"))
    return rows.select("patch_id", (F.col("at") + 1).alias("cluster_no"), F.col("c.id").alias("cluster"), F.col("c.title").alias("title"), F.array_join("c.paths", ",").alias("paths"))


def packet_ledes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and figures in Portuguese; the first names are left to tests."""
    out = packets(_patches(spark, sf_dir), Options(lang="pt"))
    return out.select("patch_id", "headline", F.substring_index("lede", "; comece", 1).alias("figures"))


def packet_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet, masked, in each format; its length and digest stand for it."""
    out = review(_patches(spark, sf_dir), Options(budget_minutes=5, now="2024-05-31T12:00:00.000Z"), hunks=True, lines=SHOWN_LINES)
    files = out.schema["files"].dataType
    formats = {"html": html_of(files), "md": markdown_of(files), "summary": markdown_of(summary=True), "text": text_of(), "json": json_of(False, files)}
    rows = out.select("patch_id", F.explode(F.array(*[F.struct(F.lit(k).alias("format"), c.alias("body")) for k, c in formats.items()])).alias("r"))
    return rows.select("patch_id", "r.format", F.length("r.body").alias("n_chars"), F.md5("r.body").alias("body_md5"))


def packet_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet, masked, as Markdown: its head, order, groups, findings, and 80 lines of each file."""
    out = review(_patches(spark, sf_dir), Options(budget_minutes=5, now="2024-05-31T12:00:00.000Z"), hunks=True, lines=SHOWN_LINES)
    body = markdown_of(out.schema["files"].dataType)
    return out.select("patch_id", body.alias("body")).select("patch_id", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed files of all patches, put into eight large ones and read back in splits."""
    path = staged(spark, "large")
    write_joined(_patches(spark, sf_dir).withColumn("bucket", F.col("patch_id") % LARGE), path, "bucket")
    return merged(assessed(files_in(sectioned(read_sections(spark, path))), OPTIONS))


def _bucket_of() -> Column:
    return F.regexp_extract("patch_id", "bucket=([0-9]+)", 1).cast("long").alias("bucket")


def large_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_scores of large patches: no row holds one."""
    files = wide_files(_large(spark, sf_dir), OPTIONS)
    rules = F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule_id"])), ",")
    return files.select(_bucket_of(), "file_no", "path", "status", "additions", "deletions", "n_hunks", rules.alias("rules"), "score", "label", "band", "disposition", "rank")


def large_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _large(spark, sf_dir)
    out = wide_packets(files, wide_files(files, OPTIONS), OPTIONS)
    return out.select(_bucket_of(), "n_files", "n_ignored", "additions", "deletions", "minutes", "over_budget", "score", "label", "n_high", "n_medium", "n_low", "n_info", "lede")


def large_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wide_clusters(wide_files(_large(spark, sf_dir), OPTIONS))
    return out.select(_bucket_of(), "cluster_no", "cluster", "title", "n_files")


def untested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no test of their patch belongs to, by name, by a part of a test's path or by the beginning of their name."""
    files = merged(assessed(diff_files(named_corpus(_documents(spark, sf_dir)))))
    lost = missing_tests(files).select(F.col("patch_id").alias("_p"), F.col("file_no").alias("_f"))
    return files.join(lost, (F.col("patch_id") == F.col("_p")) & (F.col("file_no") == F.col("_f"))).select("patch_id", "file_no", "path", "stem")


#: Option sets, for patches by patch_id % 8: lang, order, large_file_lines, test_gap_lines, budget_minutes, ignore, fail_on.
OPTION_SETS = [
    ("en", "story", 400, 15, None, [], "none"), ("PT-br", "risk", 10, 15, 5, ["docs/**", "**/*.json"], "high"), ("pt", "story", 50, 3, 2.5, ["src/*/login.py"], "medium"), ("en", "risk", 400, 1000, 0, ["**/engine*"], "low"),
    ("en", "story", 0, 0, 100, ["*"], "info"), ("pt_BR", "risk", 30, 20, 7, [".github/**", "migrations/*", "lib/**"], "high"), ("en", "risk", 15, 5, None, ["**"], "medium"), ("pt", "story", 5, 10, 3, ["src/**/*.ts", "dist/*"], "low"),
]


def reviews_by_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch by its own options, all in one plan."""
    kinds = "lang string, order string, large_file_lines double, test_gap_lines double, budget_minutes double, ignore array<string>, fail_on string"
    rows = ", ".join(f"named_struct({', '.join(f'{chr(39)}{n.split()[0]}{chr(39)}, {_spark(v)}' for n, v in zip(kinds.split(', '), x, strict=True))})" for x in OPTION_SETS)
    sets = F.expr(f"element_at(array({rows}), cast(patch_id % {len(OPTION_SETS)} as int) + 1)")
    requests = _patches(spark, sf_dir).withColumn("o", sets).select("patch_id", "text", "o.*")
    out = review_requests(requests)
    return out.select("patch_id", "language", "order", "n_files", "n_ignored", "minutes", "over_budget", "score", "label", "n_high", "n_medium", "gate_failed", "headline", F.get("files", F.lit(0))["path"].alias("first_path"))


def _spark(value: object) -> str:
    if isinstance(value, list):
        return f"array({', '.join(map(_q, value))})" if value else "cast(array() as array<string>)"
    return "cast(null as double)" if value is None else _q(value) if isinstance(value, str) else f"cast({value} as double)"


def _shared(spark: SparkSession, sf_dir: str, repeats: bool = True) -> DataFrame:
    """Patches of which four share an id, every seventh has none, and, with repeats, every fifth comes twice."""
    rows = odd_corpus(_documents(spark, sf_dir))
    if repeats:
        rows = rows.unionByName(rows.where("patch_id % 5 = 0"))
    return rows.select(F.expr("CASE WHEN patch_id % 7 <> 0 THEN patch_id div 4 END").alias("patch_id"), "text")


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a patch_id are numbered on as one patch, a row without one is a patch of its own, a repeated one counts once."""
    files = F.inline(F.transform("files", lambda f: F.struct(f["file_no"].alias("file_no"), f["path"].alias("path"), f["additions"].alias("file_additions"))))
    return packets(_shared(spark, sf_dir)).select("patch_id", "n_files", "additions", files)


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diff_lines(_shared(spark, sf_dir, repeats=False))
    return lines.select("patch_id", "kind", F.md5("text").alias("text_md5"), "old_line", "new_line")


def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(_patches(spark, sf_dir), Options(order="risk")).select("patch_id", "path", "rank")


def review_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets(_patches(spark, sf_dir), OPTIONS)
    return out.select("patch_id", "n_files", "additions", "deletions", "minutes", "over_budget", "score", "label", "n_high", "n_medium", "n_low", "n_info", F.get("files", F.lit(0))["path"].alias("first_path"))


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets(_patches(spark, sf_dir), Options(ignore=("docs/**", "**/*.json", "src/*/login.py")))
    return out.select("patch_id", "n_files", "n_ignored", "additions")


def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = redact_lines(diff_lines(_patches(spark, sf_dir)))
    return lines.select("patch_id", "file_no", "kind", F.md5("redacted").alias("redacted_md5"), (F.col("redacted") != F.col("text")).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_lines, parse_files, parse_hunks, odd_patches, packet_ids, file_scores, file_findings, packet_findings, packet_clusters, packet_ledes, packet_reports, packet_markdown,
        shared_ids, shared_lines, large_scores, large_packets, large_clusters, untested_files, reviews_by_options, risk_order, review_packets, ignored_files, redacted_lines,
    )
}

# What each path of the corpus is, written down by hand: roles, role, band, stem, cluster.
_KNOWN = [
    ("source", "source", 50, "engine", "src/core"), ("api", "api", 10, "users", "src/api"), ("auth", "auth", 20, "login", "src/auth"), ("payment", "payment", 20, "charge", "src/billing"),
    ("test", "test", 70, "engine", "test"), ("docs", "docs", 80, "guide.md", "docs"), ("migration,migration", "migration", 20, "0001_init.sql", "migration"), ("ci", "ci", 20, "ci.yml", "ci"),
    ("deps", "deps", 30, "package.json", "deps"), ("lockfile", "lockfile", 90, "package-lock.json", "lockfile"), ("asset", "asset", 90, "logo.svg", "asset"), ("generated", "generated", 90, "bundle", "generated"),
    ("crypto", "crypto", 20, "verify", "src/webhooks"), ("types", "types", 10, "model.d", "types"), ("schema", "schema", 10, "order.json", "schemas"), ("config", "config", 40, "app.tf", "config"),
    ("source", "source", 50, "parser", "lib"), ("source", "source", 50, "util", "lib"), ("migration", "migration", 20, "schema.sql", "migration"), ("api", "api", 10, "index", "src"),
    ("deps", "deps", 30, "requirements.txt", "deps"), ("docs", "docs", 80, "readme", "docs"), ("source", "source", 50, "page.html", "web"), ("test", "test", 70, "login", "test"),
    ("source", "source", 50, "main", "lib"), ("source", "source", 50, "app.cs", "lib"), ("source", "source", 50, "start", "lib"),
]
# What masking makes of each secret marker, written down by hand.
_MASKED = {
    "AWS access key": 'key = "AKIA••••••••••••"', "private key": KEY_MARK, "GitHub access token": "t = ghp_••••", "GitHub scoped token": "t = github_pat_••••", "Slack credential": "t = xox••••",
    "Stripe production key": "t = sk_live_••••", "Anthropic key": "t = sk-ant-••••", "OpenAI key": "t = sk-proj-••••", "Google key": "t = AIza••••", "npm publishing token": "t = npm_••••",
}
# Markers that a further pattern finds in some files: marker, ending, names.
_ALSO = [
    ("os.system call", ".php", "os.system call, PHP command function"), ("os.popen call", ".php", "PHP command function"), ("Ruby process pipe", ".php", "PHP command function"),
    ("Python exec", ".rb", "Ruby command call"), ("Python exec", ".php", "PHP command function"),
]
_q = lambda s: "'" + s.replace("'", "''") + "'"
_BASE = f"""
known(k, path, roles, role, band, stem, cluster) AS (VALUES {", ".join(f"({k}, {_q(p)}, {_q(r)}, {_q(o)}, {b}, {_q(s)}, {_q(c)})" for k, (p, (r, o, b, s, c)) in enumerate(zip(PATHS, _KNOWN, strict=True)))}),
marks(m, mark, name, ending, marker, masked) AS (VALUES {", ".join(f"({k}, {_q(x)}, {_q(n)}, {_q(e)}, {_q(t)}, {_q(_MASKED.get(n, t))})" for k, (x, n, e, t) in enumerate(MARKERS))}),
docs AS (SELECT doc_id, doc_id // 20 AS patch_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS file_no, known.*, marker, masked, mark, name,
  CASE WHEN mark = 'secret' THEN name END AS secrets,
  CASE {" ".join(f"WHEN name = {_q(n)} AND path LIKE '%{e}' THEN {_q(names)}" for n, e, names in _ALSO)} WHEN mark = 'exec' AND path LIKE '%' || ending THEN name END AS execs,
  CASE doc_id % 11 WHEN {NEW_FILE} THEN 'added' WHEN {DELETED_FILE} THEN 'deleted' ELSE 'modified' END AS status, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS parts
  FROM documents JOIN known ON k = doc_id % {len(PATHS)} JOIN marks ON m = doc_id % {len(MARKERS)}),
lines AS (SELECT doc_id, patch_id, file_no, 0 AS i, 'add' AS kind, marker AS text FROM docs UNION ALL
  SELECT doc_id, patch_id, file_no, i, CASE (i - 1) % 5 WHEN 3 THEN 'del' WHEN 4 THEN 'context' ELSE 'add' END, parts[i] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
files AS (SELECT docs.*, (SELECT count(*) FROM lines l WHERE l.doc_id = docs.doc_id AND kind = 'add') AS additions, (SELECT count(*) FROM lines l WHERE l.doc_id = docs.doc_id AND kind = 'del') AS deletions FROM docs)"""
_ODD = f"""
forms(f, form) AS (VALUES {", ".join(f"({k}, {_q(t)})" for k, t in enumerate(ODD))}),
odd AS (SELECT doc_id AS patch_id, f, form, doc_id::VARCHAR AS n, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS parts FROM documents JOIN forms ON f = doc_id % {len(ODD)})"""
_RULED = (
    _BASE
    + """,
hits AS (SELECT f.*, additions + deletions AS changes,
  (SELECT count(*) FROM lines l WHERE l.doc_id = f.doc_id AND l.kind <> 'context' AND trim(l.text) <> '') AS filled FROM files f),
found AS (
  SELECT doc_id, unnest(list_filter([
    CASE WHEN secrets IS NOT NULL THEN 'secret-pattern' END, CASE WHEN execs IS NOT NULL THEN 'code-exec' END, CASE WHEN mark = 'timing' AND role <> 'test' THEN 'timing-compare' END,
    CASE WHEN mark = 'write' AND role = 'ci' THEN 'workflow-permissions' END, CASE WHEN mark = 'trigger' AND role = 'ci' THEN 'privileged-trigger' END, CASE WHEN mark = 'publish' AND role = 'ci' THEN 'ci-publish' END, CASE WHEN status = 'deleted' AND role = 'test' THEN 'deleted-tests' END,
    CASE WHEN role = 'migration' OR (path LIKE '%.sql' AND mark = 'ddl') THEN 'migration' END, CASE WHEN mark = 'html' THEN 'html-sink' END,
    CASE WHEN role IN ('auth', 'crypto', 'payment') AND status <> 'deleted' AND secrets IS NULL AND execs IS NULL AND mark <> 'timing' THEN 'sensitive-surface' END,
    CASE WHEN path = 'requirements.txt' AND filled > 0 THEN 'dependency-manifest' END, CASE WHEN role = 'lockfile' THEN 'lockfile' END,
    CASE WHEN role = 'api' AND mark = 'export' THEN 'api-change' END, CASE WHEN role = 'config' THEN 'runtime-config' END,
    CASE WHEN role NOT IN ('lockfile', 'generated', 'asset', 'docs') AND changes >= 400 THEN 'large-file' END,
    CASE WHEN role = 'ci' AND mark NOT IN ('write', 'trigger', 'publish') THEN 'ci-changed' END, CASE WHEN role = 'generated' THEN 'generated-file' END,
    CASE WHEN status <> 'deleted' AND role IN ('source', 'api', 'payment', 'auth', 'crypto') AND changes >= 15 AND NOT EXISTS (
      SELECT 1 FROM files t WHERE t.patch_id = h.patch_id AND t.role = 'test' AND t.status <> 'deleted' AND t.stem = h.stem) THEN 'missing-tests' END
  ], lambda x: x IS NOT NULL)) AS rule_id FROM hits h),
weights(rule_id, severity, weight) AS (VALUES ('secret-pattern', 'high', 34), ('code-exec', 'high', 32), ('timing-compare', 'high', 30), ('workflow-permissions', 'high', 28), ('privileged-trigger', 'high', 5), ('ci-publish', 'medium', 5), ('deleted-tests', 'high', 26),
  ('migration', 'high', 24), ('sensitive-surface', 'medium', 14), ('missing-tests', 'medium', 12), ('html-sink', 'medium', 12), ('dependency-manifest', 'medium', 10), ('runtime-config', 'medium', 9),
  ('api-change', 'medium', 8), ('large-file', 'medium', 8), ('lockfile', 'medium', 5), ('ci-changed', 'low', 4), ('generated-file', 'info', 1)),
summed AS (SELECT doc_id, coalesce(sum(weight), 0) AS raw, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l, count(*) FILTER (severity = 'info') AS i,
  string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM found JOIN weights USING (rule_id) GROUP BY doc_id),
scored AS (SELECT f.*, coalesce(rules, '') AS rules, coalesce(h, 0) AS h, coalesce(s.m, 0) AS md, coalesce(l, 0) AS lo, coalesce(s.i, 0) AS inf, coalesce(raw, 0) AS raw,
  least(CASE WHEN coalesce(h, 0) > 0 THEN 100 ELSE 69 END, coalesce(raw, 0))::INT AS score,
  CASE WHEN coalesce(h, 0) > 0 THEN 'high' WHEN coalesce(s.m, 0) > 0 OR coalesce(raw, 0) >= 32 THEN 'medium' WHEN coalesce(l, 0) > 0 OR coalesce(raw, 0) >= 10 THEN 'low' ELSE 'calm' END AS label,
  CASE WHEN coalesce(h, 0) > 0 THEN least(band, 20) ELSE band END AS low_band FROM files f LEFT JOIN summed s USING (doc_id))"""
)
_ODD_TEXT = f"""{_ODD}, plus AS (SELECT *, list_transform(parts, lambda x: '+' || x) AS added FROM odd),
shared AS (SELECT CASE WHEN patch_id % 7 <> 0 THEN patch_id // 4 END AS id, patch_id AS doc_id, f, n, parts,
  replace(replace(replace(form, '{{n}}', n), '{{body}}', array_to_string(added, chr(10))), '{{crlf}}', array_to_string(added, chr(13) || chr(10))) AS text FROM plus)"""
_values = lambda pairs, lang=0: ", ".join(f"({_q(k)}, {_q(v[lang])})" for k, v in pairs.items())
_lede = lambda *what: " || ".join(x for k, part in enumerate(LEDE[0].split("%s")) for x in ([what[k - 1]] if k else []) + [_q(part)])
_NL = "chr(10)"
#: A packet's Markdown: its parts are put together from the files, findings and lines that _RULED has.
_MARKDOWN = f"""WITH {_RULED}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY low_band, score DESC, path) AS rank,
  CASE WHEN label = 'high' THEN 'now' WHEN role IN ('lockfile', 'generated', 'asset', 'docs') THEN 'later' WHEN label = 'medium' THEN 'soon' ELSE 'later' END AS disposition FROM scored),
texts(rule_id, title, detail) AS (VALUES {", ".join(f"({_q(r)}, {_q(TITLES[r][0])}, {_q(DETAILS[r][0])})" for r in TITLES)}),
minutes AS (SELECT patch_id, greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes FROM files GROUP BY patch_id),
each AS (SELECT patch_id, doc_id, rule_id, severity, weight, path, CASE rule_id WHEN 'secret-pattern' THEN secrets WHEN 'code-exec' THEN execs WHEN 'large-file' THEN (additions + deletions)::VARCHAR WHEN 'missing-tests' THEN stem
    WHEN 'sensitive-surface' THEN CASE role WHEN 'auth' THEN 'access control' WHEN 'payment' THEN 'payments' ELSE 'cryptography' END END AS what FROM found JOIN weights USING (rule_id) JOIN files USING (doc_id)
  UNION ALL SELECT patch_id, NULL, 'over-budget', 'medium', 10, NULL, minutes::VARCHAR FROM minutes WHERE minutes > 5),
labels(k, said) AS (VALUES {_values(LABELS)}),
told AS MATERIALIZED (SELECT patch_id, doc_id, rule_id, path, severity, weight, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS sev, '**' || said || '** ' AS mark,
  replace(title, '{{}}', coalesce(what, '')) AS title, replace(detail, '{{}}', coalesce(what, '')) AS detail FROM each JOIN texts USING (rule_id) JOIN labels ON k = severity),
own AS (SELECT doc_id, arg_min(title, (sev, -weight, rule_id)) AS reason, string_agg('- ' || mark || title || '. ' || detail, {_NL} ORDER BY sev, weight DESC, rule_id) AS items FROM told WHERE doc_id IS NOT NULL GROUP BY doc_id),
shown AS (SELECT l.*, CASE kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || CASE WHEN i = 0 THEN masked WHEN name = 'private key' THEN '{DOTS}' ELSE text END AS r FROM lines l JOIN docs USING (doc_id)),
diffs AS (SELECT doc_id, string_agg(r, {_NL} ORDER BY i) FILTER (i < {SHOWN_LINES}) || CASE WHEN count(*) > {SHOWN_LINES} THEN {_NL} || '…' ELSE '' END AS body,
  string_agg(CASE kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || text, {_NL} ORDER BY i) AS whole,
  '@@ -1,' || count(*) FILTER (kind <> 'add') || ' +1,' || count(*) FILTER (kind <> 'del') || ' @@ part' AS head FROM shown GROUP BY doc_id),
ids AS (SELECT patch_id, substr(sha256(string_agg('diff --git a/' || path || ' b/' || path || {_NL} || CASE status WHEN 'added' THEN 'new file mode 100644' || {_NL} WHEN 'deleted' THEN 'deleted file mode 100644' || {_NL} ELSE '' END
  || '--- ' || CASE status WHEN 'added' THEN '/dev/null' ELSE 'a/' || path END || {_NL} || '+++ ' || CASE status WHEN 'deleted' THEN '/dev/null' ELSE 'b/' || path END || {_NL} || head || {_NL} || whole, {_NL} ORDER BY doc_id) || {_NL}), 1, 8) AS id
  FROM docs JOIN diffs USING (doc_id) GROUP BY patch_id),
dispositions(k, said) AS (VALUES {_values(DISPOSITIONS)}), roles(k, said) AS (VALUES {_values(ROLE_NAMES)}), statuses(k, said) AS (VALUES {_values(STATUSES)}),
titles(cluster, title) AS (VALUES {_values(CLUSTER_TITLES)}), heads(label, headline) AS (VALUES {_values({k: v for k, v in HEADLINES.items() if k != "empty"})}),
stops AS (SELECT patch_id, string_agg(rank || '. `' || path || '` — ' || d.said || ' · ' || coalesce(reason, o.said), {_NL} ORDER BY rank) AS stops,
  string_agg('### `' || path || '`' || {_NL} || {_NL} || s.said || ' · ' || o.said || ' · +' || additions || ' −' || deletions || ' · ' || l.said || ' ' || score || {_NL} || coalesce({_NL} || items || {_NL}, '') || {_NL}
    || '```diff' || {_NL} || head || {_NL} || body || {_NL} || '```', {_NL} || {_NL} ORDER BY rank) AS parts
  FROM ranked LEFT JOIN own USING (doc_id) JOIN diffs USING (doc_id) JOIN dispositions d ON d.k = disposition JOIN roles o ON o.k = role JOIN statuses s ON s.k = status JOIN labels l ON l.k = label GROUP BY patch_id),
groups AS (SELECT patch_id, cluster, min(rank) AS first, string_agg('`' || path || '`', ', ' ORDER BY rank) AS paths FROM ranked GROUP BY patch_id, cluster),
clusters AS (SELECT patch_id, string_agg('- ' || coalesce(title, cluster) || ': ' || paths, {_NL} ORDER BY first) AS clusters FROM groups LEFT JOIN titles USING (cluster) GROUP BY patch_id),
findings AS (SELECT patch_id, string_agg('- ' || mark || title || coalesce(' `' || path || '`', '') || ' — ' || detail, {_NL} ORDER BY sev, weight DESC, coalesce(path, ''), rule_id) AS findings FROM told GROUP BY patch_id),
top AS (SELECT patch_id, rank, path, string_split(path, '/') AS p FROM ranked WHERE rank <= 3),
shared_tails AS (SELECT a.patch_id, a.rank, a.p, coalesce(max(len(list_filter(range(1, 9), lambda k: k <= len(a.p) AND k <= len(b.p) AND a.p[-k:] = b.p[-k:]))), 0) AS n FROM top a LEFT JOIN top b ON a.patch_id = b.patch_id AND a.path <> b.path GROUP BY ALL),
names AS (SELECT patch_id, string_agg(array_to_string(p[-least(len(p), n + 1)::INT:], '/'), ', ' ORDER BY rank) AS names FROM shared_tails GROUP BY patch_id),
sums AS (SELECT patch_id, count(*) AS n_files, sum(additions)::INT AS additions, sum(deletions)::INT AS deletions, sum(h)::INT AS h, sum(md)::INT AS md, sum(lo)::INT AS lo, sum(inf)::INT AS inf, sum(raw)::INT AS raw FROM scored GROUP BY patch_id),
graded AS (SELECT *, md + CASE WHEN minutes > 5 THEN 1 ELSE 0 END AS mediums, least(CASE WHEN h > 0 THEN 100 ELSE 69 END, raw + CASE WHEN minutes > 5 THEN 10 ELSE 0 END) AS score,
  CASE WHEN h > 0 THEN 'high' WHEN md > 0 OR minutes > 5 OR raw >= 32 THEN 'medium' WHEN lo > 0 OR raw >= 10 THEN 'low' ELSE 'calm' END AS label FROM sums JOIN minutes USING (patch_id)),
bodies AS (SELECT patch_id, array_to_string(['# ' || headline, '', {_lede("n_files", "additions", "deletions", "minutes", "h", "names")}, '', '- `' || id || '` · ' || said || ' (' || score || ')',
  '- ' || n_files || ' {WORDS["files"][0].lower()} · +' || additions || ' −' || deletions || ' · ~' || minutes || ' min', '- {LABELS["high"][0]} ' || h || ' · {LABELS["medium"][0]} ' || mediums || ' · {LABELS["low"][0]} ' || lo || ' · {LABELS["info"][0]} ' || inf,
  '', '## {WORDS["order"][0]}', '', stops, '', '## {WORDS["clusters"][0]}', '', clusters, '', '## {WORDS["findings"][0]}', '', coalesce(findings, {_q(WORDS["none"][0])}), '', '## {WORDS["files"][0]}', '', parts, '', '---', {_q(FOOTER[0])}, ''], {_NL}) AS body
  FROM graded JOIN heads USING (label) JOIN labels ON k = label JOIN ids USING (patch_id) JOIN stops USING (patch_id) JOIN clusters USING (patch_id) JOIN names USING (patch_id) LEFT JOIN findings USING (patch_id))
SELECT patch_id, length(body)::INT AS n_chars, md5(body) AS body_md5 FROM bodies"""
_LARGE = _RULED.replace("doc_id // 20", f"doc_id // 20 % {LARGE}") + """, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY low_band, score DESC, path, file_no) AS rank FROM scored)"""
# Which paths of the corpus each option set leaves out, written down by hand.
_GONE = ["false", "path LIKE 'docs/%' OR path LIKE '%.json'", "path = 'src/auth/login.py'", "path LIKE '%engine%'", "path NOT LIKE '%/%'", "path LIKE '.github/%' OR path LIKE 'migrations/%' OR path LIKE 'lib/%'", "true", "path LIKE 'src/%.ts' OR path LIKE 'dist/%'"]
_sql = lambda v: "NULL::DOUBLE" if v is None else _q(v) if isinstance(v, str) else f"{v}::DOUBLE"
_OPTED = (
    f"""opts(o, said, ordering, big, small, budget, gate) AS (VALUES {", ".join(f"({k}, {_q('pt' if x[0].lower().startswith('pt') else 'en')}, {', '.join(map(_sql, (*x[1:5], x[6])))})" for k, x in enumerate(OPTION_SETS))}),"""
    + _RULED.replace(f"JOIN marks ON m = doc_id % {len(MARKERS)})", f"JOIN marks ON m = doc_id % {len(MARKERS)} JOIN opts ON o = doc_id // 20 % {len(OPTION_SETS)})").replace("marker, masked, mark, name,", "marker, masked, mark, name, opts.*,", 1)
    .replace("AS deletions FROM docs)", f"AS deletions FROM docs WHERE NOT (CASE o {' '.join(f'WHEN {k} THEN {g}' for k, g in enumerate(_GONE))} END))").replace("changes >= 400", "changes >= big").replace("changes >= 15", "changes >= small")
)
ORACLES = {
    "reviews_by_options": f"""WITH {_OPTED}, patches AS (SELECT doc_id // 20 AS patch_id, any_value(o) AS o, any_value(said) AS said, any_value(ordering) AS ordering, any_value(budget) AS budget, any_value(gate) AS gate, count(*) AS n_docs FROM docs GROUP BY doc_id // 20),
        sums AS (SELECT patch_id, count(*) AS n, sum(h) AS h, sum(md) AS md, sum(lo) AS lo, sum(inf) AS inf, sum(raw) AS raw, greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes,
          arg_min(path, (CASE WHEN ordering = 'risk' THEN -score ELSE low_band END, CASE WHEN ordering = 'risk' THEN low_band ELSE -score END, path)) AS first_path FROM scored GROUP BY patch_id),
        known_sums AS (SELECT p.patch_id, said, ordering, gate, n_docs, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(md, 0) AS md, coalesce(lo, 0) AS lo, coalesce(inf, 0) AS inf, coalesce(raw, 0) AS raw, coalesce(minutes, 0) AS minutes,
          coalesce(n, 0) > 0 AND coalesce(minutes > budget, false) AS over, first_path FROM patches p LEFT JOIN sums USING (patch_id)),
        graded AS (SELECT *, CASE WHEN h > 0 THEN 'high' WHEN md > 0 OR over OR raw >= 32 THEN 'medium' WHEN lo > 0 OR raw >= 10 THEN 'low' ELSE 'calm' END AS label FROM known_sums),
        heads(label, en, pt) AS (VALUES {", ".join(f"({_q(k)}, {_q(v[0])}, {_q(v[1])})" for k, v in HEADLINES.items())})
        SELECT patch_id, said AS language, ordering AS "order", n::INT AS n_files, (n_docs - n)::INT AS n_ignored, minutes::INT AS minutes, over AS over_budget, least(CASE WHEN h > 0 THEN 100 ELSE 69 END, raw + CASE WHEN over THEN 10 ELSE 0 END)::INT AS score, g.label,
        h::INT AS n_high, (md + CASE WHEN over THEN 1 ELSE 0 END)::INT AS n_medium, CASE gate WHEN 'high' THEN h > 0 WHEN 'medium' THEN h + md > 0 OR over WHEN 'low' THEN h + md + lo > 0 OR over WHEN 'info' THEN h + md + lo + inf > 0 OR over ELSE false END AS gate_failed,
        CASE said WHEN 'pt' THEN pt ELSE en END AS headline, first_path FROM graded g JOIN heads ON heads.label = CASE WHEN n = 0 THEN 'empty' ELSE g.label END""",
    "packet_markdown": _MARKDOWN,
    "large_scores": f"""WITH {_LARGE} SELECT patch_id AS bucket, file_no::INT AS file_no, path, status, additions::INT AS additions, deletions::INT AS deletions, 1 AS n_hunks, rules, score, label, low_band AS band,
        CASE WHEN label = 'high' THEN 'now' WHEN role IN ('lockfile', 'generated', 'asset', 'docs') THEN 'later' WHEN label = 'medium' THEN 'soon' ELSE 'later' END AS disposition, rank::INT AS rank FROM ranked""",
    "large_clusters": f"""WITH {_LARGE}, titles(cluster, title) AS (VALUES {_values(CLUSTER_TITLES)}), groups AS (SELECT patch_id, cluster, min(rank) AS first, count(*) AS n_files FROM ranked GROUP BY patch_id, cluster)
        SELECT patch_id AS bucket, (row_number() OVER (PARTITION BY patch_id ORDER BY first))::INT AS cluster_no, cluster, coalesce(title, cluster) AS title, n_files FROM groups LEFT JOIN titles USING (cluster)""",
    "large_packets": f"""WITH {_LARGE}, sums AS (SELECT patch_id, count(*)::INT AS n_files, sum(additions)::INT AS additions, sum(deletions)::INT AS deletions,
        greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes, sum(h)::INT AS n_high, sum(md) AS md, sum(lo)::INT AS n_low, sum(inf)::INT AS n_info, sum(raw) AS raw FROM scored GROUP BY patch_id),
        top AS (SELECT patch_id, rank, path, string_split(path, '/') AS p FROM ranked WHERE rank <= 3),
        tails AS (SELECT a.patch_id, a.rank, a.p, count(*) FILTER (a.path = b.path) > 1 AS same, coalesce(max(len(list_filter(range(1, 9), lambda k: k <= len(a.p) AND k <= len(b.p) AND a.p[-k:] = b.p[-k:]))) FILTER (a.path <> b.path), 0) AS n FROM top a JOIN top b ON a.patch_id = b.patch_id GROUP BY ALL),
        names AS (SELECT patch_id, string_agg(array_to_string(p[-(CASE WHEN same THEN len(p) ELSE least(len(p), n + 1) END)::INT:], '/'), ', ' ORDER BY rank) AS names FROM tails GROUP BY patch_id)
        SELECT patch_id AS bucket, n_files, 0 AS n_ignored, additions, deletions, minutes, minutes > 5 AS over_budget, least(CASE WHEN n_high > 0 THEN 100 ELSE 69 END, raw + CASE WHEN minutes > 5 THEN 10 ELSE 0 END)::INT AS score,
        CASE WHEN n_high > 0 THEN 'high' WHEN md > 0 OR minutes > 5 OR raw >= 32 THEN 'medium' WHEN n_low > 0 OR raw >= 10 THEN 'low' ELSE 'calm' END AS label, n_high, (md + CASE WHEN minutes > 5 THEN 1 ELSE 0 END)::INT AS n_medium, n_low, n_info,
        {_lede("n_files", "additions", "deletions", "minutes", "n_high", "names")} AS lede FROM sums JOIN names USING (patch_id)""",
    "untested_files": """WITH named AS (SELECT doc_id, doc_id // 40 AS patch_id, regexp_extract(coalesce(text, ''), '[a-z]{3,8}') AS a, regexp_extract(substr(coalesce(text, ''), 40), '[a-z]{2,6}') AS b FROM documents),
        files AS (SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY doc_id) AS file_no, doc_id % 4 = 0 AS test, a, b, a || b AS stem, (doc_id // 4) % 3 AS k FROM named),
        tests AS (SELECT patch_id, CASE k WHEN 0 THEN a || b WHEN 1 THEN CASE WHEN b = '' THEN a || '.' ELSE a || '.' || b END ELSE 'a' END AS stem,
          CASE k WHEN 0 THEN 'tests/' || a || b || '_test.py' WHEN 1 THEN 'test/' || a || '.' || b || '.ts' ELSE 'test/' || a || b || '.d/a.py' END AS path FROM files WHERE test)
        SELECT patch_id, file_no::INT AS file_no, 'src/' || stem || '.py' AS path, stem FROM files f WHERE NOT test AND length(stem) >= 3 AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.patch_id = f.patch_id AND
          (t.stem = f.stem OR contains(t.path, '/' || f.stem || '.') OR (length(regexp_extract(t.stem, '^[^._-]*')) >= 3 AND starts_with(f.stem, regexp_extract(t.stem, '^[^._-]*')))))""",
    "shared_ids": f"""WITH {_ODD_TEXT}, placed AS (SELECT *, CASE WHEN id IS NULL THEN doc_id END AS alone, CASE WHEN f IN (0, 3, 4, 6) THEN len(parts) WHEN f = 7 THEN 1 ELSE 0 END AS added,
        CASE f WHEN 0 THEN 'new' || n || '.txt' WHEN 1 THEN 'two' || n || '.rs' WHEN 2 THEN 'pic' || n || '.bin' WHEN 3 THEN 'quo"te ' || n || '.ts' WHEN 4 THEN 'win' || n || '.ts' WHEN 5 THEN 'both' || n || '.ts' WHEN 6 THEN 'far' || n || '.ts'
          WHEN 7 THEN 'white' || n || '.ts' WHEN 8 THEN 'sub' || n || '/yarn.lock' ELSE 'img' || n || '.png' END AS path FROM shared)
        SELECT id AS patch_id, (count(*) OVER w)::INT AS n_files, (sum(added) OVER w)::INT AS additions, (row_number() OVER (w ORDER BY sha256(text)))::INT AS file_no, path, added::INT AS file_additions FROM placed WINDOW w AS (PARTITION BY id, alone)""",
    "shared_lines": f"""WITH {_ODD_TEXT}, starts(f, start) AS (VALUES (0, 1), (3, 6), (4, 1), (6, 1))
        SELECT id AS patch_id, 'add' AS kind, md5(parts[i]) AS text_md5, NULL::INT AS old_line, (start + i - 1)::INT AS new_line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM shared JOIN starts USING (f))
        UNION ALL SELECT id, unnest(['del', 'add']), unnest([md5('a b'), md5(' a b')]), unnest([1, NULL])::INT, unnest([NULL, 1])::INT FROM shared WHERE f = 7""",
    "parse_lines": f"""WITH {_BASE} SELECT patch_id, file_no::INT AS file_no, 1::BIGINT AS hunk_no, kind, md5(text) AS text_md5,
        CASE WHEN kind <> 'add' THEN (1 + count(*) FILTER (kind <> 'add') OVER w)::INT END AS old_line, CASE WHEN kind <> 'del' THEN (1 + count(*) FILTER (kind <> 'del') OVER w)::INT END AS new_line
        FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "parse_files": f"""WITH {_BASE} SELECT patch_id, file_no, path, CASE WHEN status <> 'added' THEN path END AS old_path, CASE WHEN status <> 'deleted' THEN path END AS new_path, status, false AS is_binary,
        additions::INT AS additions, deletions::INT AS deletions, 1 AS n_hunks FROM files""",
    "file_scores": f"""WITH {_RULED} SELECT patch_id, file_no, path, roles, role, stem, cluster, rules, score, label, low_band AS band,
        CASE WHEN label = 'high' THEN 'now' WHEN role IN ('lockfile', 'generated', 'asset', 'docs') THEN 'later' WHEN label = 'medium' THEN 'soon' ELSE 'later' END AS disposition,
        row_number() OVER (PARTITION BY patch_id ORDER BY low_band, score DESC, path) AS rank FROM scored""",
    "file_findings": f"WITH {_RULED} SELECT patch_id, path, rule_id, severity, weight FROM found JOIN weights USING (rule_id) JOIN files USING (doc_id)",
    "risk_order": f"WITH {_RULED} SELECT patch_id, path, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, low_band, path) AS rank FROM scored",
    "review_packets": f"""WITH {_RULED}, sums AS (SELECT patch_id, count(*)::INT AS n_files, sum(additions)::INT AS additions, sum(deletions)::INT AS deletions,
        greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes, sum(h)::INT AS n_high, sum(md) AS md, sum(lo)::INT AS n_low, sum(inf)::INT AS n_info, sum(raw) AS raw,
        arg_min(path, (low_band, -score, path)) AS first_path FROM scored GROUP BY patch_id)
        SELECT patch_id, n_files, additions, deletions, minutes, minutes > 5 AS over_budget, least(CASE WHEN n_high > 0 THEN 100 ELSE 69 END, raw + CASE WHEN minutes > 5 THEN 10 ELSE 0 END)::INT AS score,
        CASE WHEN n_high > 0 THEN 'high' WHEN md > 0 OR minutes > 5 OR raw >= 32 THEN 'medium' WHEN n_low > 0 OR raw >= 10 THEN 'low' ELSE 'calm' END AS label,
        n_high, (md + CASE WHEN minutes > 5 THEN 1 ELSE 0 END)::INT AS n_medium, n_low, n_info, first_path FROM sums""",
    "ignored_files": f"""WITH {_BASE}, kept AS (SELECT *, path LIKE 'docs/%' OR path LIKE '%.json' OR path = 'src/auth/login.py' AS gone FROM files)
        SELECT patch_id, count(*) FILTER (NOT gone)::INT AS n_files, count(*) FILTER (gone)::INT AS n_ignored, coalesce(sum(additions) FILTER (NOT gone), 0)::INT AS additions FROM kept GROUP BY patch_id""",
    "redacted_lines": f"""WITH {_BASE}, shown AS (SELECT l.*, CASE WHEN i = 0 THEN masked WHEN name = 'private key' THEN '{DOTS}' ELSE text END AS r FROM lines l JOIN docs USING (doc_id))
        SELECT patch_id, file_no, kind, md5(r) AS redacted_md5, r <> text AS changed FROM shown""",
    "packet_findings": f"""WITH {_RULED}, texts(rule_id, title, detail) AS (VALUES {", ".join(f"({_q(r)}, {_q(TITLES[r][0])}, {_q(DETAILS[r][0])})" for r in TITLES)}),
        minutes AS (SELECT patch_id, greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes FROM files GROUP BY patch_id),
        each AS (SELECT patch_id, rule_id, severity, weight, path, CASE rule_id WHEN 'secret-pattern' THEN secrets WHEN 'code-exec' THEN execs WHEN 'large-file' THEN (additions + deletions)::VARCHAR WHEN 'missing-tests' THEN stem
            WHEN 'sensitive-surface' THEN CASE role WHEN 'auth' THEN 'access control' WHEN 'payment' THEN 'payments' ELSE 'cryptography' END END AS what FROM found JOIN weights USING (rule_id) JOIN files USING (doc_id)
            UNION ALL SELECT patch_id, 'over-budget', 'medium', 10, NULL, minutes::VARCHAR FROM minutes WHERE minutes > 5)
        SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, weight DESC, coalesce(path, ''), rule_id) AS finding_no,
        rule_id, severity, weight, path, replace(title, '{{}}', coalesce(what, '')) AS title, replace(detail, '{{}}', coalesce(what, '')) AS detail FROM each JOIN texts USING (rule_id)""",
    "packet_clusters": f"""WITH {_RULED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY low_band, score DESC, path) AS rank FROM scored),
        titles(cluster, title) AS (VALUES {", ".join(f"({_q(c)}, {_q(t[0])})" for c, t in CLUSTER_TITLES.items())}),
        groups AS (SELECT patch_id, cluster, min(rank) AS first, string_agg(path, ',' ORDER BY rank) AS paths FROM ranked GROUP BY patch_id, cluster)
        SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY first) AS cluster_no, cluster, coalesce(title, cluster) AS title, paths FROM groups LEFT JOIN titles USING (cluster)""",
    "packet_ledes": f"""WITH {_RULED}, heads(label, headline) AS (VALUES {", ".join(f"({_q(k)}, {_q(v[1])})" for k, v in HEADLINES.items() if k != "empty")}),
        sums AS (SELECT patch_id, count(*) AS n, sum(additions) AS a, sum(deletions) AS d, greatest(2, floor(coalesce(sum(additions + deletions) FILTER (role NOT IN ('lockfile', 'generated', 'asset')), 0) / 40.0 + 0.5))::INT AS minutes,
        sum(h)::INT AS h, sum(md) AS md, sum(lo) AS lo, sum(raw) AS raw FROM scored GROUP BY patch_id)
        SELECT patch_id, headline, n || ' ficheiros, +' || a || ' −' || d || ', cerca de ' || minutes || ' min; ' || h || ' achados altos' AS figures
        FROM sums JOIN heads ON label = CASE WHEN h > 0 THEN 'high' WHEN md > 0 OR raw >= 32 THEN 'medium' WHEN lo > 0 OR raw >= 10 THEN 'low' ELSE 'calm' END""",
    "parse_hunks": f"""WITH {_ODD}, hunks(f, old_start, old_count, new_start, new_count, section) AS (VALUES (0, 1, 1, 1, 9, ''), (3, 5, 0, 6, 9, 'here'), (4, 1, 1, 1, 9, ''), (6, NULL, 1, 1, 1, ''), (7, 1, 1, 1, 1, ''))
        SELECT patch_id, 1 AS hunk_no, old_start, old_count, new_start, new_count, section, CASE f WHEN 7 THEN 2 ELSE len(parts) END AS n_lines FROM odd JOIN hunks USING (f)""",
    "odd_patches": f"""WITH {_ODD}, paths AS (SELECT *, CASE f WHEN 0 THEN 'old ' || n || '.txt' WHEN 1 THEN 'one' || n || '.rs' END AS before, CASE f WHEN 0 THEN 'new' || n || '.txt' WHEN 1 THEN 'two' || n || '.rs' WHEN 2 THEN 'pic' || n || '.bin'
            WHEN 3 THEN 'quo"te ' || n || '.ts' WHEN 4 THEN 'win' || n || '.ts' WHEN 5 THEN 'both' || n || '.ts' WHEN 6 THEN 'far' || n || '.ts' WHEN 7 THEN 'white' || n || '.ts' WHEN 8 THEN 'sub' || n || '/yarn.lock' ELSE 'img' || n || '.png' END AS path,
            CASE WHEN f IN (0, 3, 4, 6) THEN len(parts) WHEN f = 7 THEN 1 ELSE 0 END AS additions FROM odd)
        SELECT patch_id, path, coalesce(before, path) AS old_path, path AS new_path, before AS previous_path, CASE f WHEN 0 THEN 'renamed' WHEN 1 THEN 'copied' ELSE 'modified' END AS status, f IN (2, 9) AS is_binary,
        CASE f WHEN 0 THEN 90 END AS similarity, additions, CASE f WHEN 7 THEN 1 ELSE 0 END AS deletions, CASE WHEN f IN (0, 3, 4, 6, 7) THEN 1 ELSE 0 END AS n_hunks,
        CASE WHEN f = 7 THEN 'whitespace-only' WHEN f IN (2, 9) THEN 'binary-file' WHEN additions >= 400 THEN 'large-file,missing-tests' WHEN additions >= 15 THEN 'missing-tests' ELSE '' END AS rules FROM paths""",
    "packet_ids": f"""WITH {_ODD} SELECT patch_id, substr(sha256(replace(replace(replace(form, '{{n}}', n), '{{body}}', array_to_string(list_transform(parts, lambda x: '+' || x), chr(10))), '{{crlf}}', array_to_string(list_transform(parts, lambda x: '+' || x), chr(13) || chr(10)))), 1, 8) AS id,
        1 AS n_files, f IN (2, 9) OR (f IN (0, 3, 4, 6) AND len(parts) >= 15) AS gate_failed, '2024-05-31T12:00:00.000Z' AS generated_at, 1 AS version FROM odd""",
}
