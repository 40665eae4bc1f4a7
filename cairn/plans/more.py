"""Further queries, one per operator, each with its SQL; :mod:`.queries` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import matching as M
from ..operators import selection as S
from ..operators import verify as V
from ..schemas import SEVERITY, rank
from .inputs import Inputs, sql
from .queries import _RANKS, _query, _seeds

# --- predicates and projections ---------------------------------------------

_ODD = ["a//b/{0}.txt", "a\\\\b\\\\{0}", "/abs/{0}", "a/../{0}", "c:/x{0}", "dir/{0}/", "a/NUL.txt/{0}", "x/end./{0}", "plain{0}"]


def _odd(p: str) -> str:
    return "list_extract([" + ", ".join("concat('" + x.replace("\\\\", "\\").replace("{0}", f"', {p}, '") + "')" for x in _ODD) + f"], cast({p} % 9 + 1 as bigint))"


@_query("p05_normal_path", f"select p_partkey as id, case when p_partkey % 9 in (2, 3, 4, 6, 7) then null else rtrim(regexp_replace(replace({_odd('p_partkey')}, chr(92), '/'), '/+', '/', 'g'), '/') end as path from part")
def _(i: Inputs) -> DataFrame:
    raw = F.get(F.array(*(F.regexp_replace(F.lit(x.replace("\\\\", "\\")), "\\{0\\}", F.col("p_partkey").cast("string")) for x in _ODD)), (F.col("p_partkey") % 9).cast("int"))
    return i.part.select(F.col("p_partkey").alias("id"), T.normal_path(raw).alias("path"))


@_query("p06_one_file", sql("select id, path from files where id = 'file_7'", "files"))
def _(i: Inputs) -> DataFrame:
    return S.one_file(i.files, "file_7").select("id", "path")


@_query("p07_symbol", "select p_partkey as id from part where list_contains(string_split(p_name, ' '), 'red') or list_contains(string_split(p_type, ' '), 'STEEL')")
def _(i: Inputs) -> DataFrame:
    files = i.part.select(F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.split("p_type", " ")).alias("symbols"))
    return S.with_symbol(files, "red").select("id").unionByName(S.with_symbol(files, "STEEL").select("id")).distinct()


@_query("p08_source_paths", "select o_orderkey as id, array_to_string(list_sort(list_distinct(list_concat([concat('c', o_custkey)], ps))), ',') as paths from orders join (select l_orderkey, list(concat('p', l_partkey)) || list(concat('s', l_suppkey)) as ps from lineitem group by 1) on l_orderkey = o_orderkey")
def _(i: Inputs) -> DataFrame:
    rows = i.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("p"), "l_partkey").alias("path"))).alias("evidence"), F.collect_list(F.struct(F.concat(F.lit("s"), "l_suppkey").alias("path"))).alias("instances"))
    both = i.orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    none = F.lit(None).cast("array<string>")
    return both.select(F.col("o_orderkey").alias("id"), F.array_join(S.source_paths(F.concat(F.lit("c"), "o_custkey"), none, F.col("evidence"), F.col("instances")), ",").alias("paths"))


@_query("p09_evidence_ids", "select l_orderkey as id, array_to_string(list_sort(list_distinct(flatten(list([concat('p', l_partkey), concat('s', l_suppkey)])))), ',') as ids from lineitem group by 1")
def _(i: Inputs) -> DataFrame:
    ids = F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))
    rows = i.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(ids.alias("record_ids"))).alias("evidence"))
    return rows.select(F.col("l_orderkey").alias("id"), F.array_join(S.evidence_ids(F.col("evidence")), ",").alias("ids"))


@_query("p10_projection", sql('select id, rule_id as "ruleId", severity from findings', "findings"))
def _(i: Inputs) -> DataFrame:
    return S.projection(i.findings, ["path", "confidence", "instance_count", "pattern_key"], {"rule_id": "ruleId"})


@_query("p11_summary", "select event_id as id, event_type as rule_id, coalesce(case when event_id % 3 = 0 then null else user_id end, 1) as instance_count from events")
def _(i: Inputs) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = i.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("rule_id"), none.alias("severity"), none.alias("confidence"), none.alias("path"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("instance_count"))
    return S.summary(rows).select("id", "summary.rule_id", "summary.instance_count")


_LOADS = "loads as (select l_orderkey * 10 + l_linenumber as id, concat('o', l_orderkey) as loader, case when l_quantity > 25 then 'unsupported' else 'resolved' end as resolution, case when l_discount > 0.05 then '<dynamic>' else 'x' end as specifier, l_returnflag = 'A' as type_only, case l_linenumber when 1 then 'require' when 2 then 'import' else 'dynamic-import' end as type, case when l_tax < 0.01 then 'p' end as dst from lineitem)"


def _loads(i: Inputs) -> DataFrame:
    n = F.col("l_linenumber")
    return i.lineitem.select((F.col("l_orderkey") * 10 + n).alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("loader"), F.when(F.col("l_quantity") > 25, "unsupported").otherwise("resolved").alias("resolution"), F.when(F.col("l_discount") > 0.05, "<dynamic>").otherwise("x").alias("specifier"), (F.col("l_returnflag") == "A").alias("type_only"), F.when(n == 1, "require").when(n == 2, "import").otherwise("dynamic-import").alias("type"), F.when(F.col("l_tax") < 0.01, "p").alias("dst"))


@_query("p14_unsupported_load", f"with {_LOADS} select id from loads where resolution = 'unsupported' and specifier = '<dynamic>' and not type_only and type <> 'import' and dst is null")
def _(i: Inputs) -> DataFrame:
    rows = _loads(i)
    return rows.where(S.unsupported_load(rows)).select("id")


@_query("p15_clean", "select o_custkey as k, bool_or(o_orderstatus = 'F') and not bool_or(o_orderpriority like '1%') as clean from orders group by 1")
def _(i: Inputs) -> DataFrame:
    return S.clean(i.orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("t"), F.col("o_orderpriority").like("1%").alias("d")), "k", "t", "d")


@_query("p16_unexpected", sql("select path, kind as specifier from files where not (kind = 'test' and starts_with(path, 'src1/')) and not (kind = 'source' and starts_with(path, 'src5/en/'))", "files"))
def _(i: Inputs) -> DataFrame:
    allowed = i.spark.createDataFrame([("test", "src1"), ("source", "src5/en")], "specifier string, root string")
    return S.unexpected(i.files.select("path", F.col("kind").alias("specifier")), allowed).select("path", "specifier")


@_query("p17_all_tokens", sql("select id from files where contains(lower(path), 'src1') and contains(lower(path), '7') and contains(lower(path), 'en')", "files"))
def _(i: Inputs) -> DataFrame:
    return i.files.where(S.holds_all(F.col("path"), "SRC1 7 en")).select("id")


@_query("p18_forbidden", r"""select doc_id as id, pattern from documents, (values ('access-key', 'AKIA[0-9A-Z]{16}'), ('token', 'token\s*=\s*"[0-9a-f]{40}"'), ('private-key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('bearer', '(?i)bearer\s+[a-z0-9._~+/-]{20,}=*'), ('github', 'gh[pousr]_[A-Za-z0-9]{20,}'), ('slack', 'xox[abprs]-[A-Za-z0-9-]{10,}'), ('url-password', '[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@'), ('assignment', '(?i)(?:password|passwd|secret|api_?key)\s*[:=]\s*["'']?[A-Za-z0-9+/_-]{8,}'), ('home-path', '(?:/home/|/Users/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+')) v(pattern, re) where regexp_matches(text, re)""")
def _(i: Inputs) -> DataFrame:
    return S.forbidden(i.documents, "doc_id", "text")


@_query("p19_terminal_safe", r"select event_id as id, concat('a\u001B[', event_id, 'm\u202E', event_type, chr(10)) as shown from events")
def _(i: Inputs) -> DataFrame:
    raw = F.concat(F.lit("a\x1b["), F.col("event_id").cast("string"), F.lit("m\u202e"), "event_type", F.lit("\n"))
    return i.events.select(F.col("event_id").alias("id"), T.terminal_safe(raw).alias("shown"))


@_query("f_offsets", r"select doc_id, len(regexp_extract_all(text, '[A-Za-z]+@[a-z]+')) as n from documents")
def _(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", F.size(F.filter(T.matches(F.col("text"), "[A-Za-z]+@[a-z]+"), lambda m: F.substr("text", m["start"] + 1, m["end"] - m["start"]) == m["match"])).cast("bigint").alias("n"))


@_query("f_line_column", "select doc_id, cast(len(string_split(left(text, 100), chr(10))) as int) as line, cast(len(string_split(left(text, 100), chr(10))[-1]) + 1 as int) as col from documents where length(text) >= 100")
def _(i: Inputs) -> DataFrame:
    at = T.line_column(F.col("text"), F.lit(100))
    return i.documents.where(F.length("text") >= 100).select("doc_id", at["line"].alias("line"), at["column"].alias("col"))


@_query("f_guard_fragment", "select p_partkey as id, concat('where name = ? and k = ', p_size) as fragment from part")
def _(i: Inputs) -> DataFrame:
    raw = F.concat(F.lit("WHERE  name = 'it''s "), "p_name", F.lit("' -- why\n AND /* or\n not */ K = "), F.col("p_size").cast("string"), F.lit(" "))
    return i.part.select(F.col("p_partkey").alias("id"), T.guard_fragment(raw).alias("fragment"))


# --- joins --------------------------------------------------------------------


@_query("j03_edge_diff", sql("select key as id, case when o.val is null then 'added' when n.val is null then 'removed' else 'changed' end as status from old o full join new n using (key) where o.val is null or n.val is null or o.val <> n.val or o.identity <> n.identity", "old", "new"))
def _(i: Inputs) -> DataFrame:
    side = lambda df: df.withColumnRenamed("key", "id")
    return S.edge_diff(side(i.old), side(i.new), ["identity", "val"])


@_query("j08_changed_dispositions", sql("select rule_id as id, string_agg(distinct path, ',' order by path) as paths from findings where severity = 'high' and confidence in ('low', 'medium') and path in (select concat('u', c_custkey) from customer where c_acctbal < 0) group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    rows = i.findings.select(F.col("rule_id").alias("id"), "path", F.col("severity").alias("code"), F.col("confidence").alias("state"))
    changed = i.customer.where("c_acctbal < 0").select(F.concat(F.lit("u"), "c_custkey").alias("path"))
    return S.changed_dispositions(rows, changed, "high", ["low", "medium"]).withColumn("paths", F.array_join("paths", ","))


@_query("j21_enum_mismatch", "with m as (select p_brand as t, p_partkey as c, p_size % 3 as s from part), s as (select p_brand as t, p_partkey as c, case when p_partkey % 4 = 0 then p_size % 3 + 1 else p_size % 3 end as s from part union all select p_brand, p_partkey, 9 from part where p_partkey % 8 = 0) select m.t, m.c from m join (select t, c, min(s) as s from s group by 1, 2 having count(*) = 1) x on m.t = x.t and m.c = x.c where m.s <> x.s")
def _(i: Inputs) -> DataFrame:
    row = lambda s: [F.col("p_brand").alias("table"), F.col("p_partkey").alias("column"), s.alias("signature")]
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    storage = i.part.select(*row(F.when(k % 4 == 0, s + 1).otherwise(s))).unionByName(i.part.where("p_partkey % 8 = 0").select(*row(F.lit(9))))
    return S.enum_mismatch(i.part.select(*row(s)), storage).select(F.col("table").alias("t"), F.col("column").alias("c"))


@_query("j23_references", sql("select doc_id as id, case doc_id % 5 when 0 then 'exact' when 1 then 'case' when 2 then 'missing' when 3 then 'directory' else 'missing' end as state from documents", "files"))
def _(i: Inputs) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    k = F.col("doc_id") % 5
    target = F.when(k == 0, path).when(k == 1, F.upper(path)).when(k == 2, F.concat(path, F.lit(".bak"))).when(k == 3, F.concat("source", F.lit("/"), "lang")).otherwise("nowhere")
    return S.reference_states(i.documents.select(F.col("doc_id").alias("id"), target.alias("target")), i.files)


@_query("j33_unbound_anchors", sql("select id, path from files where language = 'de' or kind = 'test'", "files"))
def _(i: Inputs) -> DataFrame:
    anchors = i.files.select("id", F.when(F.col("language") == "de", F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), "sha256")
    packet = i.files.where("kind <> 'test'")
    return S.unbound_anchors(anchors, packet).select("id", F.regexp_replace("path", "x$", "").alias("path"))


# --- aggregations, windows and orders ------------------------------------------


@_query("a04_histogram", sql("select v.severity, count(f.id) as n from (values ('info'), ('low'), ('medium'), ('high')) v(severity) left join (select * from findings where rule_id = 'error' and severity <> 'low') f on f.severity = v.severity group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.histogram(i.findings.where("rule_id = 'error' and severity <> 'low'"), "severity", SEVERITY)


_CATALOG = [("signup", 0, 10), ("error", 1, 10**9), ("absent", 1, 5), ("click", 10**9, 10**10)]
_CATALOG_SQL = "catalog as (select * from (values " + ", ".join(map(str, _CATALOG)) + ") v(rule_id, least, most)), health as (select rule_id, coalesce(n, 0) as n, case when coalesce(n, 0) < least then 'missing' when coalesce(n, 0) > most then 'noisy' else 'ok' end as state from catalog left join (select rule_id, count(*) as n from findings group by 1) using (rule_id))"


def _catalog(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame(_CATALOG, "rule_id string, least bigint, most bigint")


@_query("a15_rule_health", sql("select * from health", "findings", ctes=_CATALOG_SQL))
def _(i: Inputs) -> DataFrame:
    return A.rule_health(_catalog(i), i.findings)


@_query("a21_suppressed", sql("select rule_id, cast(sum(instance_count) as bigint) as instances from findings where path in (select concat('u', c_custkey) from customer where c_acctbal >= 0) group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    hit = i.customer.where("c_acctbal >= 0").select(F.concat(F.lit("u"), "c_custkey").alias("path"), F.lit("suppressed").alias("state"))
    return A.suppressed_by_rule(i.findings, i.findings.join(hit, "path").select("id", "state"))


@_query("a22_codes", sql("select distinct pattern_key as code from findings where regexp_matches(pattern_key, '[13579]')", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.where(F.col("pattern_key").rlike("[13579]")).select(F.col("pattern_key").alias("code")).distinct()


@_query("a23_contexts", sql("select rule_id, severity, array_to_string(list_sort(list(distinct path))[1:5], ',') as contexts, greatest(count(distinct path) - 5, 0) as more from findings group by 1, 2", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.merged_contexts(i.findings, ["rule_id", "severity"], "path", 5)


@_query("a25_queue", sql(f"select rule_id, severity, count(*) as findings, cast(sum(instance_count) as bigint) as instances, count(distinct path) as anchors, arg_min(id, (-{_RANKS}, id)) as best from findings group by 1, 2", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.queue_groups(i.findings.withColumn("paths", F.array("path")), ["rule_id", "severity"])


@_query("a26_cluster_tail", sql("with k as (select left(node, 1) as c from (select src as node from edges union select dst from edges)), top as (select c from k group by 1 order by count(*) desc, c limit 3) select case when left(src, 1) in (select c from top) then left(src, 1) else 'other' end as src_cluster, case when left(dst, 1) in (select c from top) then left(dst, 1) else 'other' end as dst_cluster, type, count(*) as n from edges group by 1, 2, 3", "edges").replace(") with k as", "), k as"))
def _(i: Inputs) -> DataFrame:
    e, a = i.edges, i.arcs
    nodes = a.select("src").union(a.select("dst")).distinct().select(F.col("src").alias("node"), F.left("src", F.lit(1)).alias("cluster"))
    return A.clusters_with_tail(e, nodes, 3)


@_query("a28_subjects", "select p_brand as subject, array_to_string(list_sort(list(distinct d)), ',') as dimensions from (select p_brand, 'type' as d from part where p_size % 5 = 0 union all select p_brand, 'name' from part where p_size % 7 = 0) group by 1")
def _(i: Inputs) -> DataFrame:
    row = lambda c, d: i.part.where(c).select(F.col("p_brand").alias("subject"), F.lit(d).alias("d"))
    return A.subjects(row("p_size % 5 = 0", "type").unionByName(row("p_size % 7 = 0", "name")), ["subject"], "d")


@_query("a29_over_limit", sql("select cast(sum(bytes) as bigint) as total from files having sum(bytes) > 1000", "files"))
def _(i: Inputs) -> DataFrame:
    return A.over_limit(i.files, "bytes", 1000)


@_query("w02_omitted", sql("select id, review_id from (select id, severity, case when count(*) over (partition by path) > 1 then concat(path, ':occurrence:', row_number() over (partition by path order by id)) else path end as review_id from findings) where severity <> 'low'", "findings"))
def _(i: Inputs) -> DataFrame:
    side = lambda c: i.findings.where(c).select("id", F.col("path").alias("identity"))
    return A.occurrence_with_omitted(side("severity <> 'low'"), side("severity = 'low'")).select("id", "review_id")


@_query("w05_top_one", sql("select path, arg_min(id, (instance_count, id)) as id from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.groupBy("path").agg(F.min_by("id", F.struct("instance_count", "id")).alias("id"))


@_query("o01_canonical", sql("select path, row_number() over (order by path) as place from (select distinct path from files)", "files"))
def _(i: Inputs) -> DataFrame:
    return A.ranked(i.files.select("path").distinct().withColumn("key", S.canonical_order("path")), [F.col("key")], "place").select("path", "place")


@_query("o06_triage", sql(f"select id, row_number() over (order by 3 - {_RANKS}, case confidence when 'high' then 0 else 1 end, rule_id, path, instance_count, id) as place from findings", "findings"))
def _(i: Inputs) -> DataFrame:
    rows = i.findings.withColumns({"severity_rank": 3 - rank(F.col("severity"), SEVERITY), "line": F.col("instance_count"), "identity": F.col("id")})
    return A.ranked(rows, S.triage_order(F.when(F.col("confidence") == "high", 0).otherwise(1)), "place").select("id", "place")


@_query("o07_instances", sql("select id, row_number() over (partition by pattern_key order by path, instance_count, id) as place from findings", "findings"))
def _(i: Inputs) -> DataFrame:
    from pyspark.sql import Window

    return i.findings.select("id", F.row_number().over(Window.partitionBy("pattern_key").orderBy("path", "instance_count", "id")).cast("bigint").alias("place"))


@_query("o08_alias", sql("select path as specifier, case when path = 'src1/en/7.txt' then 'src1/en/7.txt' when starts_with(path, 'src1/en/') then 'src1/en/*' when starts_with(path, 'src1/') and ends_with(path, '7.txt') then 'src1/*7.txt' when starts_with(path, 'src1/') then 'src1/*' end as pattern from files where starts_with(path, 'src1/')", "files"))
def _(i: Inputs) -> DataFrame:
    aliases = [("src1/en/7.txt", "", "", True), ("src1/en/*", "src1/en/", "", False), ("src1/*7.txt", "src1/", "7.txt", False), ("src1/*", "src1/", "", False)]
    table = i.spark.createDataFrame(aliases, "pattern string, prefix string, suffix string, exact boolean")
    return S.best_alias(table, i.files.select(F.col("path").alias("specifier")))


@_query("o09_cap", sql("select count(*) as n from files", "files"))
def _(i: Inputs) -> DataFrame:
    return S.capped(i.files, 10**9, "files").agg(F.count("*").alias("n"))


@_query("u03_distinct", sql("select distinct language as v from files union select distinct kind from files", "files"))
def _(i: Inputs) -> DataFrame:
    return i.files.select(F.col("language").alias("v")).union(i.files.select("kind")).distinct().orderBy("v")


@_query("u04_changed_paths", "select distinct o_custkey as path from orders where o_orderstatus <> 'F' union select c_custkey from customer where c_acctbal < 0")
def _(i: Inputs) -> DataFrame:
    committed = i.orders.select(F.when(F.col("o_orderstatus") == "F", "D").otherwise("M").alias("status"), F.col("o_custkey").alias("path"))
    return S.changed_paths(committed, i.customer.where("c_acctbal < 0").select(F.lit("A").alias("status"), F.col("c_custkey").alias("path")))


@_query("u06_set_equality", "select k, case when a then 'first' else 'second' end as side from (select o_custkey as k, bool_or(o_orderstatus = 'F') as a, bool_or(o_orderstatus = 'O') as b from orders group by 1) where a <> b")
def _(i: Inputs) -> DataFrame:
    side = lambda s: i.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return S.same_set(side("F"), side("O"), "k")


# --- graph ---------------------------------------------------------------------


def _scopes(i: Inputs) -> DataFrame:
    return i.part.select(F.col("p_size").alias("scope"), F.concat(F.lit("p"), "p_partkey").alias("loader"), F.concat(F.lit("c"), "p_partkey").alias("target"), (F.col("p_size") % 2 == 0).alias("complete"))


_REACHED = "select distinct concat('p', l_partkey) as node from lineitem where l_quantity >= 45"


def _reached(i: Inputs) -> DataFrame:
    return i.lineitem.where("l_quantity >= 45").select(F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()


@_query("g03_scope_states", f"select p_partkey as k, case when concat('p', p_partkey) not in ({_REACHED}) then 'inactive' when p_size % 2 = 0 then 'complete' else 'incomplete' end as state from part")
def _(i: Inputs) -> DataFrame:
    return G.scope_states(_scopes(i), _reached(i)).select(F.substring("target", 2, 20).cast("bigint").alias("k"), "state")


@_query("g03_loaded_closure", sql("select node from r", "edges", recursive=True, ctes="x as (select src, dst from edges where type <> 'places' union all select concat('n', n_nationkey), concat('p', n_nationkey + 1) from nation where n_nationkey % 2 = 0), r as (select 's1' as node union select dst from r join x on src = node)"))
def _(i: Inputs) -> DataFrame:
    n = F.col("n_nationkey")
    scopes = i.nation.select(F.concat(F.lit("n"), n).alias("loader"), F.concat(F.lit("p"), n + 1).alias("target"), (n % 2 == 0).alias("complete"))
    return G.loaded_closure(i.arcs.where("type <> 'places'"), _seeds(i, "s1"), scopes)


@_query("g04_gated", f"select distinct concat('c', p_partkey) as node from part where p_size % 2 = 1 and concat('p', p_partkey) in ({_REACHED})")
def _(i: Inputs) -> DataFrame:
    return G.gated(_scopes(i), _reached(i))


@_query("g07_configured", sql("select rule, sum(n) as targets, bool_and(n > 0) as complete from (select 'a' as rule, count(*) as n from files where starts_with(path, 'src1/en/') union all select 'a', count(*) from files where starts_with(path, 'src2/') union all select 'b', count(*) from files where path like 'none/%') group by 1", "files").replace("sum(n)", "cast(sum(n) as bigint)"))
def _(i: Inputs) -> DataFrame:
    rules = i.spark.createDataFrame([("a", "src1/en"), ("a", "src2"), ("b", "none")], "rule string, pattern string")
    return G.configured_scopes(rules, i.files, T.at_or_below(F.col("path"), F.col("pattern")))


@_query("g09_uncovered", f"with {_LOADS} select loader, type as root, resolution as scope, type_only as bounded, count(*) as n, case when loader in (select concat('o', o_orderkey) from orders where o_orderstatus = 'F') then 'incomplete' else 'inactive' end as state from loads where specifier = '<dynamic>' and id % 3 <> 0 group by 1, 2, 3, 4")
def _(i: Inputs) -> DataFrame:
    loads = _loads(i).where("specifier = '<dynamic>'").select("id", "loader", F.col("type").alias("root"), F.col("resolution").alias("scope"), F.col("type_only").alias("bounded"))
    reached = i.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return G.uncovered_scopes(loads, _loads(i).where("id % 3 = 0"), reached)


@_query("g10_neighborhood", sql("select node, min(depth) as depth from r group by 1 order by depth, node limit 150", "edges", recursive=True, ctes="x as (select src, dst from edges union select dst, src from edges), r as (select 'c1' as node, 0::bigint as depth union select dst, depth + 1 from r join x on src = node where depth < 3)"))
def _(i: Inputs) -> DataFrame:
    return G.neighborhood(i.arcs, _seeds(i, "c1"), 3, "both", 150)[0]


@_query("g10_report", sql("select least(count(distinct node), 150) as n, count(distinct node) > 150 as truncated from r", "edges", recursive=True, ctes="r as (select 'n1' as node, 0 as depth union select src, depth + 1 from r join edges on dst = node where depth < 2)"))
def _(i: Inputs) -> DataFrame:
    return G.neighborhood(i.arcs, _seeds(i, "n1"), 2, "in", 150)[1]


@_query("g14_routes", "with recursive m as (select concat('r', r_regionkey) as src, concat('n', n_nationkey) as dst, concat('/', n_name) as base from nation join region on r_regionkey = n_regionkey union all select 'root', concat('r', r_regionkey), concat('/', r_name) from region union all select 'n1', 'root', '/loop'), c as (select 'root' as router, '' as base union all select m.dst, concat(c.base, m.base) from c join m on m.src = c.router where m.dst <> 'root') select distinct concat(base, '/', s_suppkey) as path from c join supplier on concat('n', s_nationkey) = router")
def _(i: Inputs) -> DataFrame:
    return _routes(i)[0]


@_query("g14_cycles", "select 'root' as router")
def _(i: Inputs) -> DataFrame:
    return _routes(i)[1]


def _routes(i: Inputs) -> tuple[DataFrame, DataFrame]:
    mount = lambda df, a, b, c: df.select(a.alias("src"), b.alias("dst"), F.concat(F.lit("/"), c).alias("base"))
    n, r = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "r_regionkey")
    mounts = mount(i.nation, F.concat(F.lit("r"), "n_regionkey"), n, "n_name").unionByName(mount(i.region, F.lit("root"), r, "r_name")).unionByName(i.spark.createDataFrame([("n1", "root", "/loop")], "src string, dst string, base string"))
    routes = i.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("router"), F.concat(F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"))
    return G.compose_routes(mounts, i.spark.createDataFrame([("root",)], "router string"), routes)


@_query("g19_nodes", sql("select id, path as label, 'file' as kind from files union all select distinct concat('dependency_sha256_', sha256(concat(l_shipmode, chr(0), l_returnflag))), l_returnflag, 'dependency' from lineitem", "files").replace("l_shipmode", "l_linestatus"))
def _(i: Inputs) -> DataFrame:
    edges = i.lineitem.select(F.lit(None).cast("string").alias("dst"), F.col("l_linestatus").alias("resolution"), F.col("l_returnflag").alias("specifier"))
    return G.with_synthetic_nodes(i.files, edges)


@_query("g20_mermaid", "with n as (select concat('n', n_nationkey) as id, n_name as label from nation union all select concat('r', r_regionkey), r_name from region), a as (select *, concat('n', row_number() over (order by id) - 1) as al from n) select '0' as ord, 'flowchart LR' as line union all select concat('1', id), concat('  ', al, '[\"', label, '\"]') from a union all select concat('2n', n_nationkey, ' r', n_regionkey, ' part_of'), concat('  ', x.al, ' -->|part_of| ', y.al) from nation join a x on x.id = concat('n', n_nationkey) join a y on y.id = concat('r', n_regionkey)")
def _(i: Inputs) -> DataFrame:
    nodes = i.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(i.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label")))
    return G.mermaid(nodes, i.edges.where("type = 'part_of'"))


# --- search --------------------------------------------------------------------


@_query("q3_abstention", sql("select case when count(*) filter (status = 'same') = 0 then 'stale' end as abstention, count(*) as n from (select 'changed' as status from files where language = 'en' order by id limit 50)", "files"))
def _(i: Inputs) -> DataFrame:
    files = i.files.select("id", "path", F.col("language").alias("label"))
    status = i.files.select("path", F.lit("changed").alias("status"))
    return S.abstaining("en", 50, files, status, i.files).groupBy("abstention").agg(F.count("*").alias("n"))


@_query("q4_review_selection", sql("select path, 'symbols' as kind from files where language = 'de' union all select path, 'diff' from files where kind = 'test' union all select path, 'findings' from files where id in ('file_3', 'file_5') union all select path, 'paths' from files where id = 'file_9'", "files"))
def _(i: Inputs) -> DataFrame:
    f = i.files.withColumn("symbols", F.array("language"))
    values = lambda *v: i.spark.createDataFrame([(x,) for x in v], "value string")
    nine = values(S.one_file(f, "file_9").first()["path"])
    pick = lambda kind, v: S.select_review(kind, v, f, i.edges, f, f.where("kind = 'test'")).withColumn("kind", F.lit(kind))
    return pick("symbols", values("de")).unionByName(pick("diff", values())).unionByName(pick("findings", values("file_3", "file_5"))).unionByName(pick("paths", nine))


# --- verification ----------------------------------------------------------------


@_query("v01_artifacts", "select name, side from (values ('notes.md', 'second'), ('run.json', 'first')) v(name, side)")
def _(i: Inputs) -> DataFrame:
    names = lambda *n: i.spark.createDataFrame([(x,) for x in n], "name string")
    return S.same_set(names("run.json", "files.jsonl", "edges.jsonl"), names("files.jsonl", "edges.jsonl", "notes.md"), "name")


@_query("v03_canonical", "select n_nationkey as key from nation where n_nationkey % 4 = 0")
def _(i: Inputs) -> DataFrame:
    good = T.canonical_json("n_nationkey", "n_name")
    rows = i.nation.withColumn("line", F.when(F.col("n_nationkey") % 4 == 0, F.concat(good, F.lit(" "))).otherwise(good))
    return V.not_canonical(rows, "n_nationkey", "line", ["n_nationkey", "n_name"]).withColumnRenamed("n_nationkey", "key")


@_query("v04_conformance", sql("select id, 'severity' as rule from findings where severity = 'info' union all select id, 'count' from findings where instance_count < 10", "findings"))
def _(i: Inputs) -> DataFrame:
    return V.nonconforming(i.findings, "id", {"severity": F.col("severity").isin("low", "medium", "high"), "count": F.col("instance_count") >= 10})


@_query("v05_identity", sql("select id from files where kind = 'test'", "files"))
def _(i: Inputs) -> DataFrame:
    own = T.content_id("file", F.col("path"), F.col("sha256"))
    rows = i.files.withColumn("stored", F.when(F.col("kind") == "test", "file:0").otherwise(own))
    return rows.join(V.wrong_id(rows, "file", "stored", "path", "sha256").distinct(), "stored", "left_semi").select("id")


@_query("v08_files", sql("select path, 'digest' as rule from files where kind = 'test' union all select path, 'path' from files where language = 'fr'", "files"))
def _(i: Inputs) -> DataFrame:
    rows = i.files.withColumn("sha256", F.when(F.col("kind") == "test", F.upper("sha256")).otherwise(F.col("sha256"))).withColumn("written", F.when(F.col("language") == "fr", F.concat(F.lit("./"), "path")).otherwise(F.col("path")))
    return V.nonconforming(rows, "path", {"digest": F.col("sha256").rlike("^[0-9a-f]{64}$"), "path": T.normal_path(F.col("written")) == F.col("written")})


@_query("v09_snapshot", sql("select path from files where language = 'es' or bytes % 5 = 0", "files"))
def _(i: Inputs) -> DataFrame:
    return V.digest_mismatch(i.files, i.files.where("language <> 'es'").withColumn("bytes", F.when(F.col("bytes") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))))


@_query("v10_edge_ids", sql("select distinct src, dst from edges where type = 'located_in'", "edges"))
def _(i: Inputs) -> DataFrame:
    own = T.content_id("edge", F.col("src"), F.col("dst"), F.col("type"))
    rows = i.edges.withColumn("id", F.when(F.col("type") == "located_in", F.concat(own, F.lit("0"))).otherwise(own))
    return rows.join(V.wrong_id(rows, "edge", "id", "src", "dst", "type"), "id", "left_semi").select("src", "dst").distinct()


@_query("v12_multiset", "select event_type as code, cast(count(*) filter (event_id % 2 = 0) - count(*) filter (event_id % 3 = 0) as bigint) as n from events group by 1 having count(*) filter (event_id % 2 = 0) <> count(*) filter (event_id % 3 = 0)")
def _(i: Inputs) -> DataFrame:
    side = lambda k: i.events.where(f"event_id % {k} = 0").select(F.col("event_type").alias("code"))
    return V.multiset_difference(side(2), side(3))


@_query("v13_instances", "select o_orderkey as id, cast(o_orderkey % 4 + 1 as bigint) as declared, coalesce(n, 0) as found from orders left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 10 group by 1) on l_orderkey = o_orderkey where case when n is null then o_orderkey % 4 + 1 <> 1 else n <> o_orderkey % 4 + 1 end")
def _(i: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    return V.wrong_instance_count(i.orders.select(k.alias("id"), (k % 4 + 1).cast("bigint").alias("instance_count")), i.lineitem.where("l_quantity > 10").select(F.col("l_orderkey").alias("finding")))


@_query("v14_metadata", sql("select id from (select id, severity, count(*) over (partition by path) as n from findings) where n > 1 and severity = 'high'", "findings"))
def _(i: Inputs) -> DataFrame:
    computed = M.occurrence_keys(i.findings.select("id", F.col("path").alias("identity"), "severity"))
    stored = computed.withColumn("review_id", F.when(F.col("severity") == "high", F.col("identity")).otherwise(F.col("review_id")))
    return V.wrong_metadata(stored, computed, "id", ["review_id"])


@_query("v15_counts", "select 'nation' as kind, cast(24 as bigint) as declared, count(*) as found from nation")
def _(i: Inputs) -> DataFrame:
    declared = i.spark.createDataFrame([("nation", 24), ("region", 5)], "kind string, n bigint")
    return V.wrong_counts(declared, {"nation": i.nation, "region": i.region})


@_query("v17_health", sql("select rule_id from health where state = 'noisy'", "findings", ctes=_CATALOG_SQL))
def _(i: Inputs) -> DataFrame:
    stored = A.rule_health(_catalog(i), i.findings).withColumn("state", F.when(F.col("state") == "noisy", "ok").otherwise(F.col("state")))
    return V.wrong_health(stored, i.findings, _catalog(i))


@_query("v19_rebuild_reasons", "select reason from (values ('ADAPTER_SET_CHANGED'), ('TOOL_CHANGED')) v(reason)")
def _(i: Inputs) -> DataFrame:
    run = lambda tool, adapters: i.spark.createDataFrame([("p", tool, adapters)], "profile string, tool string, adapters array<string>")
    return V.compatibility(run("1", ["a"]), run("2", ["a", "b"]), {"profile": "PROFILE_ID_CHANGED", "tool": "TOOL_CHANGED", "adapters": "ADAPTER_SET_CHANGED"})
