"""Scores against labels: domains, features, flow invariants, pairs, modes (E-01 to E-13, A-29 to A-32)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import canonical_key, contract_identity


def domain_findings(actual: DataFrame, must_have: DataFrame, must_not_merge: DataFrame, forbidden: DataFrame) -> DataFrame:
    """finding, subject: expected keys that are missing, keys that sit in one domain but must not, forbidden keys (E-02).

    actual: domain, key; must_have: key; must_not_merge: left_key, right_key; forbidden: key.
    """
    missing = must_have.select("key").distinct().join(actual.select("key"), "key", "left_anti").select(F.lit("missing").alias("finding"), F.col("key").alias("subject"))
    a, b = actual.select("domain", F.col("key").alias("left_key")), actual.select("domain", F.col("key").alias("right_key"))
    merged = must_not_merge.join(a, "left_key").join(b, ["right_key", "domain"]).select(F.lit("overMerge"), F.concat_ws("/", "left_key", "right_key")).distinct()
    bad = actual.join(forbidden.select("key").distinct(), "key", "left_semi").select(F.lit("forbidden"), "key").distinct()
    return missing.union(merged).union(bad)


def split_findings(actual: DataFrame, must_not_split: DataFrame) -> DataFrame:
    """Keys that must be one domain but are several (E-02)."""
    n = actual.join(must_not_split.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("domain").alias("n"))
    return n.where("n > 1").select(F.lit("overSplit").alias("finding"), F.col("key").alias("subject"))


def feature_findings(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """contract, finding: missing, duplicate, wrongDomain or found (E-03). actual: contract, domain; expected: contract, domain (null: any)."""
    n = actual.groupBy("contract").agg(F.count("*").alias("n"), F.collect_set("domain").alias("domains"))
    met = expected.join(n, "contract", "left")
    wrong = F.col("domain").isNotNull() & ~F.array_contains("domains", F.col("domain"))
    return met.select("contract", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(wrong, "wrongDomain").otherwise("found").alias("finding"))


def flow_findings(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Required edge kinds that a feature's flows lack (E-04). edges: contract, kind; expected: contract, kinds."""
    own = edges.groupBy("contract").agg(F.collect_set("kind").alias("__own"))
    met = expected.join(own, "contract", "left")
    return met.select("contract", F.array_sort(F.array_except("kinds", F.coalesce("__own", F.array().cast("array<string>")))).alias("lacking"))


def outcome(positive: DataFrame, negative: DataFrame, project: str) -> DataFrame:
    """passPositive, passNegativeOnly or fail for each project (E-05). positive and negative: project, n (findings)."""
    p, q = (d.groupBy(project).agg(F.sum("n").alias(name)) for d, name in ((positive, "p"), (negative, "q")))
    both = p.join(q, project, "full").na.fill(0, ["p", "q"])
    return both.select(project, F.when((F.col("p") == 0) & (F.col("q") == 0), "passPositive").when(F.col("q") == 0, "passNegativeOnly").otherwise("fail").alias("outcome"))


def gold_pairs(labels: DataFrame, group: str, item: str, apart: DataFrame) -> DataFrame:
    """left_key, right_key, positive: pairs within a group, and pairs across two groups that must stay apart (E-06).

    apart: left_group, right_group. Labels are written by hand, so groups are small.
    """
    own = labels.select(group, item).distinct()
    a, b = own.select(group, F.col(item).alias("l")), own.select(group, F.col(item).alias("r"))
    inside = a.join(b, group).where("l < r").select(F.col("l").alias("left_key"), F.col("r").alias("right_key"), F.lit(True).alias("positive"))
    x = apart.join(own.select(F.col(group).alias("left_group"), F.col(item).alias("l")), "left_group").join(own.select(F.col(group).alias("right_group"), F.col(item).alias("r")), "right_group")
    across = x.where("l != r").select(F.least("l", "r"), F.greatest("l", "r"), F.lit(False))
    return inside.union(across).distinct()


def pair_signals(pairs: DataFrame, signals: DataFrame, columns: list[str]) -> DataFrame:
    """Mean signals of positive and negative pairs, and how many were found (E-07, A-29)."""
    met = pairs.join(signals, ["left_key", "right_key"], "left")
    found = F.sum(F.when(F.col(columns[0]).isNotNull(), 1).otherwise(0))
    return met.groupBy("positive").agg(F.count("*").alias("pairs"), found.alias("found"), *[F.avg(c).alias(c) for c in columns])


def two_level_average(rows: DataFrame, project: str, value: str) -> DataFrame:
    """The mean over projects of each project's mean (A-30)."""
    return rows.groupBy(project).agg(F.avg(value).alias("m")).agg(F.avg("m").alias(value), F.count("*").alias("projects"))


def mode_summary(findings: DataFrame, mode: str, finding: str, kinds: list[str]) -> DataFrame:
    """Findings of each kind, by mode (A-31, A-32, E-08)."""
    return findings.groupBy(mode).pivot(finding, kinds).agg(F.count(F.lit(1))).na.fill(0)


# Names of folders, which are no domains.
FOLDERS = ["src", "lib", "app", "apps", "packages", "frontend", "backend", "web", "api", "core", "utils", "common", "python", "rust", "go"]


def forbidden_key(key: Column, forbidden: Column) -> Column:
    """A folder's name, or one that the labels forbid, in any case (P-16)."""
    return F.lower(key).isin(FOLDERS) | F.coalesce(F.exists(forbidden, lambda f: F.lower(f) == F.lower(key)), F.lit(False))


def gold_contract(raw: Column) -> Column:
    """`GET /x`, `GET:/x` or `/x` as METHOD:/path (F-31)."""
    text = F.trim(raw)
    spaced = F.regexp_extract(text, r"^(\S+)\s+(.*)$", 1), F.regexp_extract(text, r"^(\S+)\s+(.*)$", 2)
    joined = F.regexp_extract(text, r"^([^:/]+):(/.*)$", 1), F.regexp_extract(text, r"^([^:/]+):(/.*)$", 2)
    none = F.lit(None).cast("string")
    return F.when(spaced[0] != "", contract_identity(*spaced)).when(joined[0] != "", contract_identity(*joined)).otherwise(contract_identity(none, text))


def expanded_keys(expected: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, name: each expected key under its own name and all its aliases, in lower case (E-11). aliases: key, names."""
    own = expected.select("key", F.lower("key").alias("name"))
    more = expected.select("key", F.lower("key").alias("__k")).join(aliases.select(F.lower("key").alias("__k"), F.explode("names").alias("name")), "__k").select("key", F.lower("name").alias("name"))
    return own.unionByName(more).distinct()


def matched_domains(actual: DataFrame, expected: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, domain: domains of a snapshot by an expected key or one of its aliases (J-25). actual: domain, key."""
    names = actual.select("domain", F.lower(canonical_key(F.col("key"))).alias("name"))
    return expanded_keys(expected, aliases).join(names, "name").select("key", "domain").distinct()


def matched_contracts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """expected, contract: contracts of one path whose methods agree, `*` with any (J-25). Both: contract."""
    cut = lambda rows, c, m, p: rows.select(F.col("contract").alias(c), F.regexp_extract("contract", r"^([^:]*):", 1).alias(m), F.regexp_replace("contract", r"^[^:]*:", "").alias(p))
    a, b = cut(expected, "expected", "em", "path"), cut(actual, "contract", "am", "path")
    return a.join(b, "path").where("em = am or em in ('*', 'HTTP') or am in ('*', 'HTTP')").select("expected", "contract")


def evaluate_catalog(golds: DataFrame, available: DataFrame, findings: DataFrame) -> DataFrame:
    """project, findings, status: passed without findings, failed with some, unavailable without a bundle (E-09, E-12).

    golds: project; available: project; findings: project, finding.
    """
    n = findings.groupBy("project").agg(F.count("*").alias("findings"))
    met = golds.select("project").distinct().join(available.select("project", F.lit(True).alias("__has")).distinct(), "project", "left").join(n, "project", "left").na.fill(0, ["findings"])
    status = F.when(F.col("__has").isNull(), "unavailable").when(F.col("findings") == 0, "passed").otherwise("failed")
    return met.select("project", "findings", status.alias("status"))


def catalog_counts(reports: DataFrame) -> DataFrame:
    """Passed and failed projects; one that is unavailable has failed (A-32)."""
    return reports.agg(F.sum(F.when(F.col("status") == "passed", 1).otherwise(0)).alias("passed"), F.sum(F.when(F.col("status") != "passed", 1).otherwise(0)).alias("failed"))


def diagnose(golds: DataFrame, wanted: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """project, path, mode, skipped: what a diagnosis runs, a row a project and mode, and why a project is left out
    (E-10). golds: project, path, exists."""
    rows = golds.where(F.col("project").isin(list(wanted))) if wanted else golds
    why = F.when(F.col("path").isNull(), "no path").when(~F.coalesce("exists", F.lit(False)), "missing directory")
    return rows.select("project", "path", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), why.alias("skipped"))


def summary_lines(reports: DataFrame) -> DataFrame:
    """ord, line: what a console shows of a catalog's reports (E-13)."""
    each = reports.select(F.concat(F.lit("1"), "project").alias("ord"), F.concat_ws(" ", F.upper("status"), "project", F.concat(F.col("findings").cast("string"), F.lit(" findings"))).alias("line"))
    total = catalog_counts(reports).select(F.lit("2").alias("ord"), F.concat_ws(" ", F.col("passed").cast("string"), F.lit("passed,"), F.col("failed").cast("string"), F.lit("failed")).alias("line"))
    return each.unionByName(total)
