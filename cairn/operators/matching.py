"""Semi, anti, prefix and theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def changed_scope(records: DataFrame, changed: DataFrame) -> DataFrame:
    """id and the sorted changed paths of each record (id, path) that has one."""
    return records.join(changed.select("path").distinct(), "path").groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges out of or into the nodes, with their direction."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def by_path_or_evidence(records: DataFrame, paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records whose path or evidence is asked for: two semi joins, as an OR would be a nested loop."""
    return records.join(paths, "path", "left_semi").unionByName(records.join(evidence, "evidence", "left_semi")).distinct()


def missing_and_unused(declared: DataFrame, consumed: DataFrame, key: list[str]) -> DataFrame:
    """The keys that one side lacks: role missing (consumed only) or unused (declared only)."""
    d, c = declared.select(*key).distinct(), consumed.select(*key).distinct()
    return c.join(d, key, "left_anti").withColumn("role", F.lit("missing")).unionByName(d.join(c, key, "left_anti").withColumn("role", F.lit("unused")))


def unused(declared: DataFrame, consumed: DataFrame, uncertain: DataFrame, key: str) -> DataFrame:
    """Declared, never consumed and not under doubt (J15, J19): two anti joins, the doubt last."""
    return declared.select(key).distinct().join(consumed.select(key).distinct(), key, "left_anti").join(uncertain.select(key).distinct(), key, "left_anti")


def name_prefix_pairs(a: DataFrame, b: DataFrame, least: int = 6) -> DataFrame:
    """(a_name, b_name) whose bare names are proper prefixes one of the other.

    Each name is exploded into its prefixes, so both directions are equi joins.
    """
    bare = lambda df, n: df.select(F.col("name").alias(f"{n}_name"), T.bare_name(F.col("name")).alias(f"{n}_bare")).where(F.length(f"{n}_bare") >= least)
    x, y = bare(a, "a"), bare(b, "b")

    def grown(df: DataFrame, n: str) -> DataFrame:
        size = F.length(f"{n}_bare")
        return df.withColumn("p", F.explode(F.when(size > least, F.transform(F.sequence(F.lit(least), size - 1), lambda i: F.left(F.col(f"{n}_bare"), i)))))

    one = grown(x, "a").join(y, F.col("p") == F.col("b_bare"))
    two = grown(y, "b").join(x, F.col("p") == F.col("a_bare"))
    return one.select("a_name", "b_name").unionByName(two.select("a_name", "b_name")).distinct()


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the longest of the roots at or above each path, null if none."""
    each = paths.select("path", F.explode(T.prefixes(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root")
    best = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left")


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """key, path: the first of each key's ordered candidates (array) that exists."""
    each = candidates.select("key", F.posexplode("candidates").alias("pos", "path"))
    return each.join(existing.select("path").distinct(), "path", "left_semi").groupBy("key").agg(F.min_by("path", "pos").alias("path"))


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges (src, dst) between layers (node, layer) that are not allowed pairs."""
    side = lambda n: layers.select(F.col("node").alias(n), F.col("layer").alias(f"{n}_layer"))
    seen = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_layer <> dst_layer")
    return seen.join(allowed, (seen["src_layer"] == allowed["from_layer"]) & (seen["dst_layer"] == allowed["to_layer"]), "left_anti")


def guard_bypass(calls: DataFrame) -> DataFrame:
    """Sinks (sink, guarded) that have both guarded and unguarded callers, with the count of the latter."""
    by = calls.groupBy("sink").agg(F.count_if("guarded").alias("guards"), F.count_if(~F.col("guarded")).alias("bypasses"))
    return by.where("guards > 0 and bypasses > 0").select("sink", "bypasses")


def dangling(edges: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Edges whose end does not exist."""
    return edges.join(nodes.select(F.col("node").alias(column)).distinct(), column, "left_anti")


def bind_unique(calls: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """Each call key with its number of contracts and whether it binds (J30, F23): none, one or ambiguous."""
    n = contracts.groupBy(key).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("ambiguous")
    return calls.select(key).distinct().join(n, key, "left").select(key, state.alias("state"))


def required_signals(cases: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """case_id, matched: whether a finding of the key has all required signals."""
    seen = cases.join(findings, key, "left").withColumn("ok", F.coalesce(F.size(F.array_except("required", "signals")) == 0, F.lit(False)))
    return seen.groupBy("case_id").agg(F.max("ok").alias("matched"))


def compare_columns(left: DataFrame, right: DataFrame, key: list[str], dimensions: list[str]) -> DataFrame:
    """key, dimension, kind: missing (no row on the right) or the dimensions that differ."""
    r = right.select(*key, F.lit(True).alias("__in"), *(F.col(d).alias(f"__{d}") for d in dimensions))
    seen = left.join(r, key, "left")
    differs = F.array_compact(F.array(*(F.when(~F.col(d).eqNullSafe(F.col(f"__{d}")), F.lit(d)) for d in dimensions)))
    kinds = F.when(F.col("__in").isNull(), F.array(F.lit("missing"))).otherwise(differs)
    return seen.select(*key, F.explode(kinds).alias("dimension"))


def lookup_mismatch(uses: DataFrame, dictionary: DataFrame, key: list[str]) -> DataFrame:
    """Uses whose name differs from the dictionary's, or whose key it lacks."""
    seen = uses.join(dictionary.select(*key, F.col("name").alias("known")), key, "left")
    state = F.when(F.col("known").isNull(), "absent").when(F.col("known") != F.col("name"), "mismatch")
    return seen.withColumn("state", state).where("state is not null").select(*key, "name", "state")


def prefer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, origin: of two sources the first that has the key."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("origin"))


def route_mismatches(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """client_id, state: missing (no route of the path) or method (path but not method).

    Rows have ``segments`` (array; a parameter starts with ``:``, an optional one
    ends with ``?``) and ``method``.  Optional parameters are expanded.  Both
    sides have literal segments up to their first parameter; of a pair that
    agrees, these agree as far as the shorter goes.  So a pair is found by the
    number of segments and those literals, in one of two equi joins.
    """
    short = F.filter("segments", lambda s: ~F.endswith(s, F.lit("?")))
    variants = routes.select(F.explode(F.array_distinct(F.array(F.col("segments"), short))).alias("r"), F.col("method").alias("rm")).distinct()
    parameter = lambda s: F.startswith(s, F.lit(":"))
    literal = lambda x: F.coalesce(F.nullif(F.array_position(F.transform(x, parameter), True), F.lit(0)) - 1, F.size(x).cast("bigint"))
    key = lambda x, m: F.concat_ws("/", F.size(x), F.array_join(F.slice(x, F.lit(1), m.cast("int")), "/"), m)
    upto = lambda x, last: F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda m: key(x, m))
    c, r = F.col("segments"), F.col("r")
    whole = variants.withColumn("key", key(r, literal(r)))
    one = clients.withColumn("key", F.explode(upto(c, literal(c)))).join(whole, "key")
    short_of = variants.where(literal(r) > 0).withColumn("key", F.explode(upto(r, literal(r) - 1)))
    two = clients.withColumn("key", key(c, literal(c))).join(short_of, "key")
    pairs = one.unionByName(two)
    alike = F.forall(F.zip_with("segments", "r", lambda c, s: parameter(c) | parameter(s) | (c == s)), lambda x: x)
    method = (F.col("rm") == "ANY") | (F.col("rm") == F.col("method")) | ((F.col("method") == "HEAD") & (F.col("rm") == "GET")) | (F.col("method") == "OPTIONS")
    hit = pairs.where(alike).groupBy("client_id").agg(F.max(method).alias("ok"))
    return clients.select("client_id").join(hit, "client_id", "left").where("ok is null or not ok").select("client_id", F.when(F.col("ok").isNull(), "missing").otherwise("method").alias("state"))


def apply_dispositions(findings: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """id, identity, state of each finding: kept, suppressed or stale.

    ``ledger`` has identity and anchors (array of path, sha256).  An entry is
    current only if every anchor's file has that digest; otherwise the finding
    stays and is marked.
    """
    anchors = ledger.select("identity", F.explode_outer("anchors").alias("a")).select("identity", "a.path", "a.sha256")
    now = files.select("path", F.col("sha256").alias("now"))
    state = anchors.join(now, "path", "left").groupBy("identity").agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("now"), F.lit(False))).alias("current"))
    seen = findings.select("id", "identity").join(state, "identity", "left")
    return seen.select("id", "identity", F.when(F.col("current").isNull(), "kept").when(F.col("current"), "suppressed").otherwise("stale").alias("state"))


def impact(findings: DataFrame, reach: DataFrame) -> DataFrame:
    """findings with reachability and scope (J11, A30): production wins, else a sole scope, else mixed."""
    scopes = reach.groupBy("path").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    seen = findings.join(scopes, "path", "left")
    scope = F.when(F.array_contains("scopes", "production"), "production").when(F.size("scopes") == 1, F.get("scopes", F.lit(0))).when(F.size("scopes") > 1, "mixed")
    return seen.withColumn("reachability", F.when(F.col("scopes").isNull(), "unreachable").otherwise("reachable")).withColumn("scope", F.coalesce(scope, F.lit("none"))).drop("scopes")


def occurrence_keys(rows: DataFrame, identity: str = "identity", order: str = "id") -> DataFrame:
    """review_id: the identity, with ``:occurrence:n`` where it has several rows."""
    w = Window.partitionBy(identity)
    n, rn = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return rows.withColumn("review_id", F.when(n > 1, F.concat_ws("", identity, F.lit(":occurrence:"), rn)).otherwise(F.col(identity)))


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that matches."""
    out = F
    for name, pattern in rules:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise(otherwise)
