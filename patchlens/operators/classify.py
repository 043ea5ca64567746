"""Paths to roles, bands, stems and clusters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions.patterns import matches
from patchlens.plans.catalog import BANDS, CLUSTER_ROLES, LOCKFILES, MANIFESTS, PATH_WORDS, ROLE_PATHS, TEST_PATHS


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _any(path: Column, *patterns: str, ignore_case: bool = False) -> Column:
    return matches(path, "|".join(patterns), ignore_case)


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(normal(path), "/"), -1))


def is_test(path: Column) -> Column:
    return _any(normal(path), *TEST_PATHS)


def roles_of(path: Column) -> Column:
    """All roles of a path, in a fixed order; a path may have one twice."""
    p, base = normal(path), base_name(path)
    test = is_test(path)
    generated = _any(p, *ROLE_PATHS["generated"])
    asset = _any(p, *ROLE_PATHS["asset"], ignore_case=True)
    docs = _any(p, *ROLE_PATHS["docs"], ignore_case=True) | _any(p, *ROLE_PATHS["docs folder"]) | base.rlike(r"\A(?:readme|changelog)")
    code = ~(test | generated | asset | docs)
    within = lambda words: code & _any(p, rf"(?:^|\/)(?:{words})(?:\/|\.|$)", ignore_case=True)
    found = [
        ("test", test), ("lockfile", base.isin(LOCKFILES)), ("generated", generated), ("asset", asset), ("docs", docs),
        ("migration", _any(p, *ROLE_PATHS["migration"], ignore_case=True)),
        ("migration", p.endswith(".sql") & _any(p, *ROLE_PATHS["migration sql"], ignore_case=True)),
        ("ci", p.contains(".github/workflows/") | p.contains(".github/actions/") | _any(p, *ROLE_PATHS["ci"], ignore_case=True)
            | _any(p, *ROLE_PATHS["ci folder"])),
        ("deps", base.isin(MANIFESTS)),
        ("auth", within(PATH_WORDS["auth"])),
        ("crypto", within(PATH_WORDS["crypto"])),
        ("payment", within(PATH_WORDS["payment"])),
        ("api", _any(p, *ROLE_PATHS["api"])),
        ("types", _any(p, *ROLE_PATHS["types"])),
        ("schema", _any(p, *ROLE_PATHS["schema"], ignore_case=True)),
        ("config", _any(p, *ROLE_PATHS["config"]) | p.endswith(".tf")),
    ]
    named = F.filter(F.array(*[F.when(c, F.lit(role)) for role, c in found]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("source")))


def primary_role(roles: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(roles, r), F.lit(r)) for r in BANDS], F.lit("source"))


def band_of(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair]), role)


def stem_of(path: Column) -> Column:
    stem = base_name(path)
    for pattern in (r"\.(?:tsx|ts|jsx|js|mjs|cjs|py|go|rb|rs|java|kt|php)\z", r"\.(?:test|spec)\z", r"_test\z", r"\Atest_"):
        stem = F.regexp_replace(stem, pattern, "")
    return stem


def cluster_of(path: Column, role: Column) -> Column:
    parts = F.split(normal(path), "/", -1)
    inner = F.when(F.size(parts) <= 1, "root").when(F.size(parts) == 2, F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("root"))).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(role.isin(CLUSTER_ROLES), role).otherwise(inner)


def covers_named(lower_path: Column, test_stem: Column, stem: Column) -> Column:
    """Whether a test belongs to a stem: by name, by a path part, or by an abbreviated name."""
    head = F.get(F.split(test_stem, r"[._-]", -1), F.lit(0))
    return (test_stem == stem) | F.contains(lower_path, F.concat(F.lit("/"), stem, F.lit("."))) | ((F.length(head) >= 3) & F.startswith(stem, head))


def glob_pattern(glob: str) -> str:
    """A whole-path pattern: ** crosses folders, * does not, everything else stands for itself."""
    out, at = [], 0
    for token, pattern in iter(lambda: next(((t, p) for t, p in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*")) if glob.startswith(t, at)), (glob[at : at + 1], None)), ("", None)):
        out.append(pattern or (rf"\Q{token}\E"))
        at += len(token)
    return rf"(?s)\A{''.join(out)}\z"


def ignored(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit
