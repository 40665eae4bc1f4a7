"""Selections, projections, orders and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from .deltas import delta
from .search import lexical

#: Patterns of text that must not be kept, by name.
FORBIDDEN = {
    "access-key": "AKIA[0-9A-Z]{16}", "token": "token\\s*=\\s*\"[0-9a-f]{40}\"", "private-key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer": "(?i)bearer\\s+[a-z0-9._~+/-]{20,}=*",
    "github": "gh[pousr]_[A-Za-z0-9]{20,}", "slack": "xox[abprs]-[A-Za-z0-9-]{10,}", "url-password": "[a-z][a-z0-9+.-]*://[^\\s/:@]+:[^\\s/@]+@", "assignment": "(?i)(?:password|passwd|secret|api_?key)\\s*[:=]\\s*[\"']?[A-Za-z0-9+/_-]{8,}", "home-path": "(?:/home/|/Users/|[A-Z]:\\\\Users\\\\)[A-Za-z0-9._-]+",
}


def forbidden(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, pattern: the names of the forbidden patterns that a row holds; the value itself is not returned."""
    names = F.array(*(F.when(F.col(column).rlike(p), n) for n, p in FORBIDDEN.items()))
    return df.select(F.col(id_column).alias("id"), F.explode(F.array_compact(names)).alias("pattern"))


def one_file(files: DataFrame, selector: str) -> DataFrame:
    """The file whose path or id is the selector (P6); an error if there is none."""
    found = files.where((F.col("path") == selector) | (F.col("id") == selector)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no file has the path or id {selector}")
    return found


def with_symbol(files: DataFrame, symbol: str) -> DataFrame:
    """Files (with an array ``symbols``) that export a symbol."""
    return files.where(F.array_contains("symbols", symbol))


def source_paths(path: Column, related: Column, evidence: Column, instances: Column) -> Column:
    """All paths of a finding, distinct and in order; evidence and instances are arrays of structs with ``path``."""
    of = lambda rows: F.transform(F.coalesce(rows, F.array()), lambda x: x["path"])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(path), F.coalesce(related, F.array()), of(evidence), of(instances)))))


def evidence_ids(evidence: Column) -> Column:
    """Ids of the records that a finding's evidence (array of structs with ``record_ids``) cites."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(evidence, lambda e: F.coalesce(e["record_ids"], F.array())))))


def projection(df: DataFrame, drop: list[str], rename: dict[str, str]) -> DataFrame:
    """``df`` without some columns and with others renamed (P10)."""
    return df.drop(*drop).withColumnsRenamed(rename)


def summary(findings: DataFrame) -> DataFrame:
    """What a comparison shows of a finding; a missing count of instances is one."""
    return findings.select("id", F.struct("rule_id", "severity", "confidence", "path", F.coalesce("instance_count", F.lit(1)).alias("instance_count")).alias("summary"))


def unsupported_load(e: DataFrame) -> Column:
    """Whether a relationship is a load of a module that no literal names."""
    return (F.col("resolution") == "unsupported") & (F.col("specifier") == "<dynamic>") & ~F.col("type_only") & F.col("type").isin("require", "dynamic-import") & F.col("dst").isNull()


def clean(states: DataFrame, key: str, tracked: str, dirty: str) -> DataFrame:
    """``key``, clean: some record is tracked and none is dirty."""
    return states.groupBy(key).agg((F.bool_or(tracked) & ~F.bool_or(dirty)).alias("clean"))


def unexpected(imports: DataFrame, allowed: DataFrame) -> DataFrame:
    """Imports (specifier, path) without an entry (specifier, root) at or above their path (P16): prefixes make it an equi join."""
    each = imports.select("specifier", "path", F.explode(T.prefixes(F.col("path"))).alias("root")).join(allowed, ["specifier", "root"], "left_semi")
    return imports.join(each.select("specifier", "path").distinct(), ["specifier", "path"], "left_anti")


def holds_all(value: Column, query: str) -> Column:
    """Whether a text holds every token of the query."""
    low = F.lower(value)
    out = F.lit(True)
    for t in query.lower().split():
        out = out & F.contains(low, F.lit(t))
    return out


def changed_dispositions(dispositions: DataFrame, changed: DataFrame, code: str, states: list[str]) -> DataFrame:
    """id, paths of dispositions (id, path, code, state) of a code and some states with a changed anchor."""
    rows = dispositions.where((F.col("code") == code) & F.col("state").isin(*states))
    return rows.join(changed.select("path").distinct(), "path").groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def edge_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """id, status of edges that were added, removed or changed."""
    return delta(old, new, "id", columns).where("status <> 'same'")


def enum_mismatch(migration: DataFrame, storage: DataFrame) -> DataFrame:
    """table, column whose values differ between (table, column, signature) sides; a column that storage has twice says nothing."""
    once = storage.groupBy("table", "column").agg(F.count("*").alias("n"), F.first("signature").alias("other")).where("n = 1")
    return migration.join(once, ["table", "column"]).where("signature <> other").select("table", "column")


def reference_states(references: DataFrame, paths: DataFrame) -> DataFrame:
    """id, state: exact, case (only in other letters), directory (a path lies below) or missing, of references (id, target)."""
    known = paths.select("path").distinct()
    below = known.select(F.explode(F.slice(T.prefixes(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1)).alias("target")).distinct().withColumn("d", F.lit(True))
    exact = known.select(F.col("path").alias("target")).withColumn("e", F.lit(True))
    case = known.select(F.lower("path").alias("low")).distinct().withColumn("c", F.lit(True))
    rows = references.join(exact, "target", "left").join(below, "target", "left").withColumn("low", F.lower("target")).join(case, "low", "left")
    return rows.select("id", F.when(F.col("e"), "exact").when(F.col("d"), "directory").when(F.col("c"), "case").otherwise("missing").alias("state"))


def unbound_anchors(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Review anchors (id, path, sha256) that no file of the packet has."""
    return anchors.join(files.select("id", "path", "sha256"), ["id", "path", "sha256"], "left_anti")


def canonical_order(column: str) -> Column:
    """Sort key of a text: by code points after NFC (O1); Spark compares UTF-8 bytes, which have that order."""
    return T.nfc(F.col(column))


def triage_order(scope_ranks: Column) -> list[Column]:
    """Sort keys of the older triage report: severity, scope, rule, path, line, identity."""
    return [F.col("severity_rank"), scope_ranks, F.col("rule_id"), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.col("identity")]


def best_alias(aliases: DataFrame, specifiers: DataFrame) -> DataFrame:
    """specifier, pattern: the most specific alias (pattern, prefix, suffix, exact) of each: exact, longest prefix, longest suffix, pattern."""
    s, p = F.col("specifier"), F.col("prefix")
    fits = F.when(F.col("exact"), s == F.col("pattern")).otherwise(F.startswith(s, p) & F.endswith(s, F.col("suffix")) & (F.length(s) >= F.length(p) + F.length("suffix")))
    pairs = specifiers.join(F.broadcast(aliases), fits)  # aliases are a few rows of configuration
    order = F.struct(F.when(F.col("exact"), 0).otherwise(1), -F.length(p), -F.length("suffix"), F.col("pattern"))
    return pairs.groupBy("specifier").agg(F.min_by("pattern", order).alias("pattern"))


def capped(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df``, or an error if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise OverflowError(f"more than {most} {what}")
    return df


def changed_paths(*statuses: DataFrame) -> DataFrame:
    """Distinct paths of several lists (status, path), deletions left out (U4)."""
    rows = statuses[0].select("status", "path")
    for s in statuses[1:]:
        rows = rows.unionByName(s.select("status", "path"))
    return rows.where("status <> 'D'").select("path").distinct()


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: the keys that only one side has; none if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("first")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("second")))


def abstaining(query: str, k: int, files: DataFrame, status: DataFrame, covered: DataFrame) -> DataFrame:
    """id, score, freshness of the best files, and why there may be none (Q3): ``abstention`` is null, no-match or stale.

    ``status`` (path, status) says what changed since, ``covered`` (path) what was read at all.
    """
    found = lexical(query, k, files).join(files.select("id", "path"), "id").join(status, "path", "left").join(covered.select("path").withColumn("covered", F.lit(True)), "path", "left")
    fresh = found.withColumn("freshness", F.coalesce("status", F.lit("same"))).where("covered")
    state = fresh.agg(F.count("*").alias("n"), F.count_if(F.col("freshness") == "same").alias("ok"))
    why = F.when(F.col("n") == 0, "no-match").when(F.col("ok") == 0, "stale")
    return state.select(why.alias("abstention")).join(fresh.select("id", "score", "freshness"), F.col("abstention").isNull() | (F.col("abstention") == "stale"), "left")


def select_review(kind: str, values: DataFrame, files: DataFrame, edges: DataFrame, findings: DataFrame, changed: DataFrame, depth: int = 1) -> DataFrame:
    """The files (path) of a review selection: all, paths, symbols, findings, diff or neighborhood of ``values`` (value) (Q4).

    Selectors that name nothing are an error, except for all and diff.
    """
    paths = files.select("path").distinct()
    if kind == "all":
        return paths
    if kind == "diff":
        return paths.join(changed.select("path").distinct(), "path", "left_semi")
    if kind in ("paths", "neighborhood"):
        named = values.select(F.col("value").alias("path")).distinct()
        lost, hit = named.join(paths, "path", "left_anti"), paths.join(named, "path", "left_semi")
        if kind == "neighborhood":
            both = edges.select("src", "dst").unionByName(G.reverse(edges))
            hit = paths.join(G.k_hop(both, hit.select(F.col("path").alias("node")), depth).select(F.col("node").alias("path")), "path", "left_semi")
    elif kind == "symbols":
        each = files.select("path", F.explode("symbols").alias("value"))
        lost, hit = values.join(each, "value", "left_anti"), each.join(values, "value", "left_semi").select("path").distinct()
    elif kind == "findings":
        own = findings.select(F.col("id").alias("value"), "path")
        lost, hit = values.join(own, "value", "left_anti"), paths.join(own.join(values, "value", "left_semi"), "path", "left_semi")
    else:
        raise ValueError(f"unknown selection {kind}")
    if not lost.isEmpty():
        raise LookupError(f"selectors of kind {kind} match nothing")
    return hit
