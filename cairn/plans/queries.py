"""One query per operator of SURVEY section 2 over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import deltas as D
from ..operators import graph as G
from ..operators import matching as M
from ..operators import replay as R
from ..operators import search as S
from ..operators import verify as V
from ..sources import records as IO
from .inputs import Inputs, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Row = Callable[[Inputs], DataFrame]


def _query(name: str, oracle: str | None = None) -> Callable[[Row], Row]:
    def add(f: Row) -> Row:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- deltas (J1-J6, U) ------------------------------------------------------

_STATUS = "case when o.key is null then 'added' when n.key is null then 'removed' when {0} then 'changed' else 'same' end"


@_query("j01_finding_diff", sql(
    "select identity, b_id, c_id, status, row_number() over (partition by identity order by case status when 'unchanged' then 0 when 'resolved' then 1 else 2 end, b_id nulls last, c_id nulls last) as occurrence from a", "old", "new",
    ctes="b as (select distinct identity, key as id from old), c as (select distinct identity, key as id from new), "
    "rb as (select *, row_number() over (partition by identity order by id) rn from b anti join c using (identity, id)), rc as (select *, row_number() over (partition by identity order by id) rn from c anti join b using (identity, id)), "
    "m as (select identity, id as b_id, id as c_id from b join c using (identity, id) union all select identity, rb.id, rc.id from rb full join rc using (identity, rn)), "
    "a as (select *, case when b_id is null then 'new' when c_id is null then 'resolved' else 'unchanged' end as status from m)"))  # fmt: skip
def _(i: Inputs) -> DataFrame:
    side = lambda df: df.select("identity", F.col("key").alias("id"))
    return D.pair_by_occurrence(side(i.old), side(i.new))


@_query("j02_path_diff", sql(f"select key, {_STATUS.format('(o.val, o.identity) <> (n.val, n.identity)')} as status from old o full join new n using (key)", "old", "new"))
def _(i: Inputs) -> DataFrame:
    return D.delta(i.old, i.new, "key", ["val", "identity"])


@_query("j04_record_delta", sql("select key from old o full join new n using (key) where o.val is null or n.val is null or o.val <> n.val", "old", "new"))
def _(i: Inputs) -> DataFrame:
    return D.delta_ids(i.old, i.new, "key", ["val"])


@_query("j05_freshness", sql("select status, count(*) as n from (select case when o.val is null then 'added' when n.val is null then 'removed' when o.val <> n.val then 'changed' else 'same' end as status from old o full join new n using (key)) group by 1", "old", "new"))
def _(i: Inputs) -> DataFrame:
    return A.counts_by(D.delta(i.old, i.new, "key", ["val"]), "status")


@_query("j06_instance_delta", "with o as (select distinct l_partkey as pattern, l_orderkey as instance from lineitem where l_linenumber <= 3), n as (select distinct l_partkey as pattern, l_orderkey as instance from lineitem where l_linenumber >= 2), s as (select pattern from o intersect select pattern from n) select pattern, instance, case when o.pattern is null then 'added' else 'removed' end as status from (select *, 1 as x from o semi join s using (pattern)) o full join (select *, 1 as y from n semi join s using (pattern)) n using (pattern, instance) where x is null or y is null".replace("o.pattern is null", "x is null"))
def _(i: Inputs) -> DataFrame:
    side = lambda c: i.lineitem.where(c).select(F.col("l_partkey").alias("pattern"), F.col("l_orderkey").alias("instance"))
    return D.instance_delta(side("l_linenumber <= 3"), side("l_linenumber >= 2"))


@_query("u05_cache_plan", sql("select key, case when key in (select key from hot) then 'miss' else 'hit' end as plan from new union all select key, 'evicted' from old where key not in (select key from new)", "old", "new", ctes="hot as (select o_orderkey as key from orders where o_orderpriority like '1%')"))
def _(i: Inputs) -> DataFrame:
    hot = i.orders.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("key"))
    return D.cache_plan(i.old, i.new, hot, "key")


@_query("u01_union_dedup", "select distinct o_custkey as id from orders union select c_custkey from customer")
def _(i: Inputs) -> DataFrame:
    return i.orders.select(F.col("o_custkey").alias("id")).union(i.customer.select("c_custkey")).distinct()


@_query("u06_set_difference", "select p_partkey as id from part except select l_partkey from lineitem where l_quantity >= 49")
def _(i: Inputs) -> DataFrame:
    return i.part.select(F.col("p_partkey").alias("id")).exceptAll(i.lineitem.where("l_quantity >= 49").select("l_partkey").distinct())


@_query("u07_conflicts", "select id, count(*) as n from (select distinct l_suppkey as id from lineitem where l_linenumber = 1 union all select distinct l_suppkey from lineitem where l_linenumber = 5) group by 1 having count(*) > 1")
def _(i: Inputs) -> DataFrame:
    side = lambda n: i.lineitem.where(f"l_linenumber = {n}").select(F.col("l_suppkey").alias("id")).distinct()
    return V.repeated(side(1).union(side(5)), "id")


# --- matching (J7-J34) ------------------------------------------------------


@_query("j07_changed_scope", sql("select id, list_aggregate(list_sort(list_distinct(list(path))), 'string_agg', ',') as paths from findings where path in (select concat('u', c_custkey) from customer where c_acctbal < 0) group by id", "findings"))
def _(i: Inputs) -> DataFrame:
    changed = i.customer.where("c_acctbal < 0").select(F.concat(F.lit("u"), "c_custkey").alias("path"))
    return M.changed_scope(i.findings.select("id", "path"), changed).withColumn("paths", F.array_join("paths", ","))


@_query("j09_file_inspection", sql("select src, dst, type, 'out' as direction from edges where src in ('p1', 'p2') union all select src, dst, type, 'in' from edges where dst in ('p1', 'p2')", "edges"))
def _(i: Inputs) -> DataFrame:
    nodes = i.part.where("p_partkey in (1, 2)").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return M.touching(i.edges, nodes)


@_query("j10_finding_inspection", sql("select distinct id from findings where path = 'u7' or rule_id = 'error'", "findings"))
def _(i: Inputs) -> DataFrame:
    rows = i.findings.select("id", "path", F.col("rule_id").alias("evidence"))
    return M.by_path_or_evidence(rows, rows.where("path = 'u7'").select("path").distinct(), rows.where("evidence = 'error'").select("evidence").distinct()).select("id")


@_query("j11_impact", sql("select id, coalesce(scope, 'none') as scope, case when scope is null then 'unreachable' else 'reachable' end as reachability from findings left join (select concat('u', o_custkey) as path, case when bool_or(o_orderstatus = 'O') then 'production' when count(distinct o_orderstatus) = 1 then lower(min(o_orderstatus)) else 'mixed' end as scope from orders group by 1) using (path)", "findings"))
def _(i: Inputs) -> DataFrame:
    scope = F.when(F.col("o_orderstatus") == "O", "production").otherwise(F.lower("o_orderstatus"))
    reach = i.orders.select(F.concat(F.lit("u"), "o_custkey").alias("path"), scope.alias("scope"))
    return M.impact(i.findings.select("id", "path"), reach).select("id", "scope", "reachability")


@_query("j12_absorbed", sql("select path, count(*) as absorbed from findings where rule_id = 'error' and path in (select path from findings where rule_id = 'signup') group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    f = i.findings
    return f.where("rule_id = 'error'").join(f.where("rule_id = 'signup'").select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count("*").alias("absorbed"))


@_query("j13_review_anchors", sql("select language, string_agg(concat(path, '=', sha256), ',' order by path) as anchors from files where kind = 'test' group by 1", "files"))
def _(i: Inputs) -> DataFrame:
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("="), x["sha256"]))
    return i.files.where("kind = 'test'").groupBy("language").agg(F.array_join(anchors, ",").alias("anchors"))


@_query("j14_dispositions", sql("select id, identity, case when current is null then 'kept' when current then 'suppressed' else 'stale' end as state from (select id, path as identity from findings) left join (select concat('u', c_custkey) as identity, coalesce(c_acctbal >= 0, false) as current from customer where c_mktsegment = 'BUILDING') using (identity)", "findings"))
def _(i: Inputs) -> DataFrame:
    c = i.customer.where("c_mktsegment = 'BUILDING'").withColumn("k", F.concat(F.lit("u"), "c_custkey"))
    ledger = c.select(F.col("k").alias("identity"), F.array(F.struct(F.col("k").alias("path"), F.lit("same").alias("sha256"))).alias("anchors"))
    files = c.select(F.col("k").alias("path"), F.when(F.col("c_acctbal") >= 0, "same").otherwise("other").alias("sha256"))
    return M.apply_dispositions(i.findings.select("id", F.col("path").alias("identity")), ledger, files)


@_query("j15_unused", "select p_partkey as name from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49) and p_size <> 7")
def _(i: Inputs) -> DataFrame:
    name = lambda df, c: df.select(F.col(c).alias("name"))
    return M.unused(name(i.part, "p_partkey"), name(i.lineitem.where("l_quantity >= 49"), "l_partkey"), name(i.part.where("p_size = 7"), "p_partkey"), "name")


@_query("j16_declarations", "with d as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), c as (select distinct c_custkey as k from customer where c_acctbal > 1000) select k, 'missing' as role from c where k not in (select k from d) union all select k, 'unused' from d where k not in (select k from c)")
def _(i: Inputs) -> DataFrame:
    return M.missing_and_unused(i.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), i.customer.where("c_acctbal > 1000").select(F.col("c_custkey").alias("k")), ["k"])


_BARE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@_query("j17_name_prefixes", f"with a as (select distinct p_name as n, {_BARE.format('p_name')} as b from part), c as (select distinct concat(p_name, '-', p_size) as n, {_BARE.format("concat(p_name, '-', p_size)")} as b from part) select distinct a.n as a_name, c.n as b_name from a join c on a.b <> c.b and length(a.b) >= 6 and length(c.b) >= 6 and (starts_with(a.b, c.b) or starts_with(c.b, a.b))")
def _(i: Inputs) -> DataFrame:
    small = i.part.select(F.concat("p_name", F.lit("-"), F.col("p_size").cast("string")).alias("name"))
    return M.name_prefix_pairs(i.part.select(F.col("p_name").alias("name")).distinct(), small.distinct())


_ROUTES = "r as (select concat('/', n_regionkey, '/', n_nationkey, '/:id') as route, case when n_nationkey % 2 = 0 then 'GET' else 'ANY' end as m from nation where n_nationkey % 3 <> 0 union all select '/:any/7/x', 'POST'), c as (select c_custkey as client_id, concat('/', n_regionkey, '/', n_nationkey, '/', case when c_custkey % 4 = 0 then 'x' else cast(c_custkey as varchar) end) as path, case when c_custkey % 5 = 0 then 'POST' else 'GET' end as m from customer join nation on n_nationkey = c_nationkey)"


@_query("j18_routes", f"with {_ROUTES} select client_id, case when ok is null then 'missing' else 'method' end as state from (select client_id, bool_or(r.m in ('ANY', c.m)) filter (r.route is not null) as ok from c left join r on regexp_matches(c.path, concat('^', regexp_replace(r.route, ':[a-z]+', '[^/]+', 'g'), '$')) group by 1) where ok is null or not ok")
def _(i: Inputs) -> DataFrame:
    text = lambda *parts: F.split(F.concat(*parts), "/")
    s = F.lit("/")
    routes = i.nation.where("n_nationkey % 3 <> 0").select(text(s, "n_regionkey", s, "n_nationkey", F.lit("/:id")).alias("segments"), F.when(F.col("n_nationkey") % 2 == 0, "GET").otherwise("ANY").alias("method"))
    routes = routes.unionByName(i.spark.range(1).select(text(F.lit("/:any/7/x")).alias("segments"), F.lit("POST").alias("method")))
    last = F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_custkey").cast("string"))
    clients = i.customer.join(i.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("client_id"), text(s, "n_regionkey", s, "n_nationkey", s, last).alias("segments"), F.when(F.col("c_custkey") % 5 == 0, "POST").otherwise("GET").alias("method"))
    return M.route_mismatches(clients, routes)


@_query("j20_column_compare", "with l as (select p_partkey as k, p_size as size, p_brand as brand from part), r as (select p_partkey as k, case when p_partkey % 11 = 0 then p_size + 1 else p_size end as size, case when p_partkey % 13 = 0 then 'none' else p_brand end as brand from part where p_partkey % 17 <> 0) select k, 'missing' as dimension from l where k not in (select k from r) union all select k, 'size' from l join r using (k) where l.size <> r.size union all select k, 'brand' from l join r using (k) where l.brand <> r.brand")
def _(i: Inputs) -> DataFrame:
    k = F.col("p_partkey")
    left = i.part.select(k.alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    right = i.part.where("p_partkey % 17 <> 0").select(k.alias("k"), F.when(k % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.when(k % 13 == 0, "none").otherwise(F.col("p_brand")).alias("brand"))
    return M.compare_columns(left, right, ["k"], ["size", "brand"])


@_query("j22_unmatched_edges", sql("select src, dst from edges where type = 'places' and dst not in (select concat('o', l_orderkey) from lineitem where l_quantity >= 45)", "edges"))
def _(i: Inputs) -> DataFrame:
    used = i.lineitem.where("l_quantity >= 45").select(F.concat(F.lit("o"), "l_orderkey").alias("dst")).distinct()
    return i.edges.where("type = 'places'").join(used, "dst", "left_anti").select("src", "dst")


@_query("j24_longest_prefix", sql("select path, coalesce((select arg_max(root, length(root)) from (values ('src1'), ('src1/en'), ('src2'), ('src3/fr'), ('src3')) v(root) where path = root or starts_with(path, concat(root, '/'))), '') as root from files", "files"))
def _(i: Inputs) -> DataFrame:
    roots = i.spark.createDataFrame([("src1",), ("src1/en",), ("src2",), ("src3/fr",), ("src3",)], "root string")
    return M.longest_prefix(i.files, roots).withColumn("root", F.coalesce("root", F.lit("")))


@_query("j25_layer_policy", sql("select src, dst, s.n_regionkey as from_layer, d.n_regionkey as to_layer from (select distinct s_nationkey as src, c_nationkey as dst from supplier, customer where s_suppkey = c_custkey) join nation s on src = s.n_nationkey join nation d on dst = d.n_nationkey where s.n_regionkey <> d.n_regionkey and not (s.n_regionkey = 0 and d.n_regionkey = 1)"))
def _(i: Inputs) -> DataFrame:
    edges = i.supplier.join(i.customer, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    layers = i.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("layer"))
    allowed = i.spark.createDataFrame([(0, 1)], "from_layer int, to_layer int")
    return M.layer_violations(edges, layers, allowed).select("src", "dst", F.col("src_layer").alias("from_layer"), F.col("dst_layer").alias("to_layer"))


@_query("j26_first_existing", "select * from (select o_orderkey as key, case when o_custkey % 2 = 0 and o_custkey in (select s_suppkey from supplier) then o_custkey else o_custkey % 50 + 1 end as path from orders) where path in (select s_suppkey from supplier)")
def _(i: Inputs) -> DataFrame:
    c = F.col("o_custkey")
    candidates = i.orders.select(F.col("o_orderkey").alias("key"), F.array(F.when(c % 2 == 0, c), c % 50 + 1).alias("candidates"))
    return M.first_existing(candidates, i.supplier.select(F.col("s_suppkey").alias("path")))


@_query("j27_nearest_ancestor", sql("select path, case when starts_with(path, 'src4/de/') then 'src4/de' when starts_with(path, 'src4/') then 'src4' end as root from files where starts_with(path, 'src4/')", "files"))
def _(i: Inputs) -> DataFrame:
    roots = i.spark.createDataFrame([("src4",), ("src4/de",)], "root string")
    return M.longest_prefix(i.files.where(T.at_or_below(F.col("path"), F.lit("src4"))), roots)


@_query("j28_guard_bypass", "select l_partkey as sink, count(*) filter (l_discount < 0.02) as bypasses from lineitem group by 1 having count(*) filter (l_discount >= 0.02) > 0 and count(*) filter (l_discount < 0.02) > 0")
def _(i: Inputs) -> DataFrame:
    return M.guard_bypass(i.lineitem.select(F.col("l_partkey").alias("sink"), (F.col("l_discount") >= 0.02).alias("guarded")))


@_query("j29_dangling", sql("select src, dst, type from edges where type = 'contains' and dst not in (select concat('p', p_partkey) from part where p_size > 5)", "edges"))
def _(i: Inputs) -> DataFrame:
    return M.dangling(i.edges.where("type = 'contains'"), "dst", i.part.where("p_size > 5").select(F.concat(F.lit("p"), "p_partkey").alias("node"))).select("src", "dst", "type")


@_query("j30_bind_unique", "select p_brand as key, case n when 0 then 'none' when 1 then 'one' else 'ambiguous' end as state from (select b.p_brand, count(p.p_partkey) as n from (select distinct p_brand from part) b left join part p on p.p_brand = b.p_brand and p.p_size = 1 group by 1)")
def _(i: Inputs) -> DataFrame:
    brand = F.col("p_brand").alias("key")
    return M.bind_unique(i.part.select(brand), i.part.where("p_size = 1").select(brand), "key")


@_query("j31_required_signals", sql("select concat('u', c_custkey) as case_id, coalesce(bool_or(severity = 'high' and rule_id = 'error'), false) as matched from customer left join findings on path = concat('u', c_custkey) group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    u = F.concat(F.lit("u"), "c_custkey")
    cases = i.customer.select(u.alias("case_id"), u.alias("path"), F.array(F.lit("high"), F.lit("error")).alias("required"))
    return M.required_signals(cases, i.findings.select("path", F.array("severity", "rule_id").alias("signals")), "path")


@_query("j32_dictionary", "select k, name, case when known is null then 'absent' else 'mismatch' end as state from (select l_suppkey as k, l_returnflag as name, s_name as known from (select distinct l_suppkey, l_returnflag from lineitem) left join (select s_suppkey, case when s_nationkey < 12 then 'A' else 'N' end as s_name from supplier where s_suppkey % 9 <> 0) on s_suppkey = l_suppkey) where known is null or known <> name")
def _(i: Inputs) -> DataFrame:
    uses = i.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("name")).distinct()
    known = i.supplier.where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_nationkey") < 12, "A").otherwise("N").alias("name"))
    return M.lookup_mismatch(uses, known, ["k"])


@_query("j34_prefer", "select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v, case when a.v is not null then 'first' else 'second' end as origin from (select n_nationkey as k, n_name as v from nation where n_regionkey < 3) a full join (select r_regionkey + 5 as k, r_name as v from region) b on a.k = b.k")
def _(i: Inputs) -> DataFrame:
    a = i.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return M.prefer(a, i.region.select((F.col("r_regionkey") + 5).alias("k"), F.col("r_name").alias("v")), "k", "v")


# --- predicates and sources (P, S) ------------------------------------------


@_query("p01_glob", sql("select id, path from files where regexp_matches(path, '^src1[^/]*/(en|de)/[^/]*[.]txt$')", "files"))
def _(i: Inputs) -> DataFrame:
    return i.files.where(T.matches_any(F.col("path"), ["src1*/en/**", "src1*/de/*.txt"])).select("id", "path")


@_query("p03_prefix", sql("select path from files where starts_with(path, 'src2/en/')", "files"))
def _(i: Inputs) -> DataFrame:
    return i.files.where(T.at_or_below(F.col("path"), F.lit("src2/en"))).select("path")


@_query("p04_exclusion", sql("select path from files where not (list_has_any(string_split(path, '/'), ['fr', 'es']) or regexp_matches(path, '^src3/'))", "files"))
def _(i: Inputs) -> DataFrame:
    skip = F.arrays_overlap(F.split("path", "/"), F.array(F.lit("fr"), F.lit("es"))) | T.matches_any(F.col("path"), ["src3/**"])
    return i.files.where(~skip).select("path")


@_query("p12_threshold", sql("select id from findings where severity in ('medium', 'high')", "findings"))
def _(i: Inputs) -> DataFrame:
    from ..schemas import SEVERITY, rank

    return i.findings.where(rank(F.col("severity"), SEVERITY) >= 2).select("id")


@_query("p18_secrets", "select doc_id from documents where regexp_matches(text, 'AKIA[0-9A-Z]{16}|token = \"[0-9a-f]{40}\"')")
def _(i: Inputs) -> DataFrame:
    return V.portable(i.documents, "text", ["AKIA[0-9A-Z]{16}", 'token = "[0-9a-f]{40}"']).select("doc_id")


_NAMES = ["src/a.ts", "src/b.tsx", "lib/c.test.js", "docs/d.md", "tests/e.py", "f.sql", "g.YAML", "package.json", "h.rs", "bin/i", ".env.example", "web/j.scss"]


@_query("s04_language", "with f as (select concat(p_partkey, '/', list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + "], cast(p_partkey % 12 + 1 as bigint))) as path, p_partkey % 12 as k from part) select path, list_extract(['typescript', 'typescript-tsx', 'javascript', 'markdown', 'python', 'sql', 'yaml', 'json', 'rs', 'unknown', 'dotenv-template', 'stylesheet'], k + 1) as language, list_extract(['source', 'source', 'test', 'documentation', 'test', 'other', 'configuration', 'configuration', 'other', 'other', 'configuration', 'other'], k + 1) as kind from f")
def _(i: Inputs) -> DataFrame:
    path = F.concat(F.col("p_partkey"), F.lit("/"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 12).cast("int")))
    return i.part.select(path.alias("path")).select("path", IO.language(F.col("path")).alias("language"), IO.kind(F.col("path")).alias("kind"))


@_query("s17_links", "select page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from pages")
def _(i: Inputs) -> DataFrame:
    return IO.links(i.pages)


# --- aggregations (A) -------------------------------------------------------


@_query("a01_counts", sql("select rule_id, severity, count(*) as n from findings group by 1, 2", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.counts_by(i.findings, "rule_id", "severity")


@_query("a03_severity_counts", sql("select rule_id, count(*) as n, count(*) filter (severity = 'info') as n_info, count(*) filter (severity = 'low') as n_low, count(*) filter (severity = 'medium') as n_medium, count(*) filter (severity = 'high') as n_high from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.counts_by_severity(i.findings, "rule_id")


@_query("a05_label_counts", sql("select case when rule_id in ('error', 'signup') then 'coverage' else 'activity' end as label, count(*) as n from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    labels = i.spark.createDataFrame([("error", "coverage"), ("signup", "coverage")], "rule_id string, label string")
    return A.counts_by(i.findings.join(F.broadcast(labels), "rule_id", "left").withColumn("label", F.coalesce("label", F.lit("activity"))), "label")


@_query("a06_instances", sql("select rule_id, cast(sum(coalesce(instance_count, 1)) as bigint) as instances from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.groupBy("rule_id").agg(F.sum(F.coalesce("instance_count", F.lit(1))).alias("instances"))


_RANKS = "case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 else 3 end"
_CONF = "case confidence when 'low' then 1 when 'medium' then 2 else 3 end"


@_query("a07_pattern_groups", sql(f"select rule_id, pattern_key, instance_count, severity, confidence, path, case when instance_count = 1 then first else concat('finding:', left(sha256(concat(rule_id, chr(0), pattern_key, chr(0), ids)), 24)) end as id from (select rule_id, pattern_key, count(*) as instance_count, arg_max(severity, {_RANKS}) as severity, arg_min(confidence, {_CONF}) as confidence, min(path) as path, first(id order by path, id) as first, string_agg(id, ',' order by path, id) as ids from findings group by 1, 2)", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.pattern_groups(i.findings)


@_query("a09_sole_value", sql("select path, case when min(rule_id) = max(rule_id) then min(rule_id) else 'mixed' end as rule from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.groupBy("path").agg(A.sole_or("rule_id").alias("rule"))


@_query("a10_calibration", sql("select id, case when cap = 'low' and severity in ('medium', 'high') then 'low' when cap = 'medium' and severity = 'high' then 'medium' else severity end as severity from (select id, severity, case when rule_id = 'error' or confidence = 'low' then 'low' when confidence = 'high' then 'high' else 'medium' end as cap from findings)", "findings"))
def _(i: Inputs) -> DataFrame:
    reach = F.when(F.col("confidence") == "low", "unreachable").otherwise("reachable")
    scope = F.when(F.col("rule_id") == "error", "test").when(F.col("confidence") == "high", "production").otherwise("cli")
    cap = A.ceiling(F.lit("active"), reach, scope, F.lit("not-observed"))
    return i.findings.select("id", A.capped_severity(F.col("severity"), cap).alias("severity"))


@_query("a11_duplicate_groups", sql("select bytes, sha256, count(*) as n, string_agg(path, ',' order by path) as paths, count(distinct language) as languages from files group by 1, 2 having count(*) >= 2", "files"))
def _(i: Inputs) -> DataFrame:
    return A.duplicate_groups(i.files)


@_query("a12_fragments", sql("select pattern_key, count(*) as n, count(distinct path) as paths from findings group by 1 having count(*) >= 2 and count(distinct path) >= 2", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.repeated_over_paths(i.findings, "pattern_key")


@_query("a13_vocabulary_drift", sql("select path, count(*) as n, count(distinct severity) as signatures from findings group by 1 having count(*) >= 2 and count(distinct severity) >= 2", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.drifting(i.findings, "path", "severity")


@_query("a14_set_signature", sql("select path, sha256(string_agg(distinct severity, ',' order by severity)) as signature from findings group by 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.groupBy("path").agg(A.set_signature("severity").alias("signature"))


@_query("a16_recall", "select source, count(*) filter (quality = 1) as hits, count(*) as total from documents join labels using (doc_id) group by 1")
def _(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", "source").join(i.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count("*").alias("total"))


@_query("a17_expectations", sql("select rule_id, coalesce(n, 0) as n from (values ('signup', 2000), ('error', 100000), ('absent', 1)) v(rule_id, least) left join (select rule_id, count(*) as n from findings group by 1) using (rule_id) where coalesce(n, 0) < least", "findings"))
def _(i: Inputs) -> DataFrame:
    bounds = i.spark.createDataFrame([("signup", 2000), ("error", 100000), ("absent", 1)], "rule_id string, least bigint")
    return bounds.join(A.counts_by(i.findings, "rule_id"), "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least").select("rule_id", "n")


@_query("a18_pattern_samples", sql("select language, array_to_string(p[1:32], ',') as sample, cast(greatest(len(p) - 32, 0) as bigint) as more from (select language, list_sort(list(path)) as p from files group by 1)", "files"))
def _(i: Inputs) -> DataFrame:
    return A.first_values(i.files, "language", "path", 32, "sample")


@_query("a19_packets", sql("select (rn - 1) // 25 as packet_no, count(*) as files, cast(ceil(sum(bytes) / 4.0) as bigint) as tokens from (select *, row_number() over (order by path) as rn from files) group by 1", "files"))
def _(i: Inputs) -> DataFrame:
    return A.packets(i.files, 25)


@_query("a20_budget", "select o_orderstatus as state, cast(count(*) as bigint) as n, cast(sum(o_custkey) as bigint) as spent from orders group by 1")
def _(i: Inputs) -> DataFrame:
    return i.orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("spent"))


@_query("a24_adjacency", sql("select node, direction, part, string_agg(other, ',' order by other) as neighbours from (select *, (row_number() over (partition by node, direction order by other) - 1) // 100 as part from (select distinct src as node, 'out' as direction, dst as other from edges union select distinct dst, 'in', src from edges)) group by 1, 2, 3", "edges"))
def _(i: Inputs) -> DataFrame:
    return G.adjacency(i.arcs, 100).withColumn("neighbours", F.array_join("neighbours", ","))


@_query("a26_clusters", sql("select left(src, 1) as src_cluster, left(dst, 1) as dst_cluster, type, count(*) as n from edges group by 1, 2, 3", "edges"))
def _(i: Inputs) -> DataFrame:
    e, a = i.edges, i.arcs
    nodes = a.select("src").union(a.select("dst")).distinct().select(F.col("src").alias("node"), F.left("src", F.lit(1)).alias("cluster"))
    return A.cluster_edges(e, nodes)


@_query("a27_mode", sql("select path, n as top, rule_id from (select path, rule_id, count(*) as n, row_number() over (partition by path order by count(*) desc, rule_id) as rn from findings group by 1, 2) where rn = 1", "findings"))
def _(i: Inputs) -> DataFrame:
    return A.mode("path", "rule_id", i.findings)


# --- windows and orders (W, O) ----------------------------------------------


@_query("w01_occurrence", sql("select id, case when count(*) over (partition by path) > 1 then concat(path, ':occurrence:', row_number() over (partition by path order by id)) else path end as review_id from findings", "findings"))
def _(i: Inputs) -> DataFrame:
    return M.occurrence_keys(i.findings.select("id", F.col("path").alias("identity"))).select("id", "review_id")


@_query("w06_first_n", "select o_custkey as k, array_to_string(x[1:8], ',') as first, cast(greatest(len(x) - 8, 0) as bigint) as more from (select o_custkey, list_sort(list(distinct o_orderkey)) as x from orders group by 1)")
def _(i: Inputs) -> DataFrame:
    return A.first_values(i.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey", 8, "first")


@_query("w08_attempt_chain", "select o_orderkey as id, before from (select o_orderkey, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as before from orders) where before is not null and before <> 'F'")
def _(i: Inputs) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "failed").otherwise(F.col("o_orderstatus"))
    return A.broken_chain(i.orders.withColumn("s", state), "o_custkey", "o_orderkey", "s").select(F.col("o_orderkey").alias("id"), "before")


@_query("w09_ambiguous_order", "select l_orderkey as k from lineitem group by 1 having count(distinct l_suppkey) <> count(*)")
def _(i: Inputs) -> DataFrame:
    return i.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_suppkey").alias("a"), F.count("*").alias("b")).where("a <> b").select("k")


@_query("w10_running_flag", "select conv_id, turn, max(cast(contains(text, 'the') as int)) over (partition by conv_id order by turn) = 1 as running from conversations")
def _(i: Inputs) -> DataFrame:
    return A.running_flag(i.conversations.withColumn("f", F.contains("text", F.lit("the"))), "conv_id", "turn", "f").select("conv_id", "turn", "running")


@_query("o02_review_order", sql(f"select id, row_number() over (order by 3 - {_RANKS}, case confidence when 'high' then 0 when 'medium' then 1 else 2 end, case confidence when 'high' then 0 when 'medium' then 1 else 2 end, instance_count desc, path, id) as place from findings", "findings"))
def _(i: Inputs) -> DataFrame:
    from ..schemas import SEVERITY, rank

    c = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    rows = i.findings.select("id", F.col("path").alias("identity"), "instance_count", (3 - rank(F.col("severity"), SEVERITY)).alias("severity_rank"), c.alias("impact_rank"), c.alias("confidence_rank"))
    return A.review_order(rows).select("id", "place")


@_query("o04_top_k", sql("select id, instance_count from findings order by instance_count desc, id limit 21", "findings"))
def _(i: Inputs) -> DataFrame:
    return i.findings.select("id", "instance_count").orderBy(F.desc("instance_count"), "id").limit(21)


# --- graph (G) --------------------------------------------------------------


def _seeds(i: Inputs, *nodes: str) -> DataFrame:
    return i.spark.createDataFrame([(n,) for n in nodes], "node string")


@_query("g02_closure", sql("select node from r", "edges", recursive=True, ctes="r as (select 'p1' as node union select dst from r join edges on src = node)"))
def _(i: Inputs) -> DataFrame:
    return G.k_hop(i.arcs, _seeds(i, "p1")).select("node")


@_query("g05_contexts", sql("select node, count(distinct origin) as origins, string_agg(distinct scope, ',' order by scope) as scopes from r join (select concat('p', p_partkey) as origin, case when p_size % 2 = 0 then 'test' else 'production' end as scope from part) using (origin) group by 1", "edges", recursive=True, ctes="r as (select concat('p', p_partkey) as node, concat('p', p_partkey) as origin from part union select dst, origin from r join edges on src = node)"))
def _(i: Inputs) -> DataFrame:
    entry = i.part.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.when(F.col("p_size") % 2 == 0, "test").otherwise("production").alias("scope"))
    return G.contexts_by_scope(i.arcs, entry)


@_query("g10_k_hop", sql("select node, min(depth) as depth from r group by 1", "edges", recursive=True, ctes="r as (select 'c1' as node, 0::bigint as depth union select dst, depth + 1 from r join edges on src = node where depth < 2)"))
def _(i: Inputs) -> DataFrame:
    return G.k_hop(i.arcs, _seeds(i, "c1"), 2)


@_query("g12_impact", sql("select node from r", "edges", recursive=True, ctes="r as (select 'n3' as node union select src from r join edges on dst = node)"))
def _(i: Inputs) -> DataFrame:
    e = i.arcs
    return G.impact_closure(e.where("type <> 'places'"), e.where("type <> 'contains'"), _seeds(i, "n3")).select("node")


@_query("g13_affected", sql("select id from findings where concat('c', substr(path, 2)) in (select node from r)", "edges", "findings", recursive=True, ctes="r as (select 's7' as node union select src from r join edges on dst = node)"))
def _(i: Inputs) -> DataFrame:
    near = G.k_hop(G.reverse(i.arcs), _seeds(i, "s7")).select("node")
    return i.findings.withColumn("node", F.concat(F.lit("c"), F.expr("substring(path, 2)"))).join(near, "node", "left_semi").select("id")


@_query("g17_layers", sql("select node, max(rank) as rank from r group by 1", "edges", recursive=True, ctes="e as (select distinct src, dst from edges where type <> 'places'), r as (select distinct src as node, 0::bigint as rank from e union select distinct dst, 0 from e union select dst, rank + 1 from r join e on src = node where rank < 5)"))
def _(i: Inputs) -> DataFrame:
    return G.layers(i.arcs.where("type <> 'places'"))


# --- search (Q) -------------------------------------------------------------

_SCORE = "(case when lower({0}) = 'src1' then 100 when contains(lower({0}), 'src1') then 20 else 0 end + case when lower({0}) = 'high' then 100 when contains(lower({0}), 'high') then 20 else 0 end + case when lower({0}) = 'signup' then 100 when contains(lower({0}), 'signup') then 20 else 0 end)"


@_query("q1_lexical_search", sql("select kind, id, label, score from a where score > 0 order by score desc, id limit 200", "files", "findings", ctes=f"a as (select 'file' as kind, id, label, {_SCORE.format('label')} as score from (select id, concat_ws(' ', path, kind, language) as label from files) union all select 'finding', id, label, case when s > 0 then s + 10 else 0 end from (select *, {_SCORE.format('label')} as s from (select id, concat_ws(' ', rule_id, severity, path) as label from findings)))"))
def _(i: Inputs) -> DataFrame:
    files = i.files.select("id", "path", F.concat_ws(" ", "path", "kind", "language").alias("label"))
    findings = i.findings.select("id", F.concat_ws(" ", "rule_id", "severity", "path").alias("label"))
    return S.lexical("src1 HIGH signup", 200, files, findings=findings)


@_query("q2_weighted_search", "select id, cast(sum(s) as bigint) as score from (select id, field, max(s) as s from (select doc_id as id, 'lang' as field, case when lower(lang) = 'en' then 5 when contains(lower(lang), 'en') then 1 else 0 end * 16 as s from documents union all select doc_id, 'source', (case when lower(source) = 'en' then 5 when contains(lower(source), 'en') then 1 else 0 end + case when contains(lower(source), 'rc1') then 1 else 0 end) * 24 from documents union all select doc_id, 'lang', case when contains(lower(lang), 'rc1') then 16 else 0 end from documents) where s > 0 group by 1, 2) group by 1 order by score desc, id limit 100")
def _(i: Inputs) -> DataFrame:
    fields = i.documents.select(F.col("doc_id").alias("id"), F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("field", "value"))
    return S.weighted("en rc1", fields, {"lang": 16, "source": 24}, 100).withColumn("score", F.col("score").cast("bigint"))


# --- verification and replay (V, T) -----------------------------------------


@_query("v02_digests", sql("select path from files where language = 'fr' and bytes % 3 = 0 union all select path from files where kind = 'test'", "files").replace("language = 'fr'", "kind <> 'test' and language = 'fr'"))
def _(i: Inputs) -> DataFrame:
    f = i.files
    other = f.where("kind <> 'test'").withColumn("sha256", F.when((F.col("language") == "fr") & (F.col("bytes") % 3 == 0), "x").otherwise(F.col("sha256")))
    return V.digest_mismatch(f, other)


@_query("v06_repeated", "select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) > 1")
def _(i: Inputs) -> DataFrame:
    return V.repeated(i.orders, "o_custkey", "o_orderstatus")


@_query("v07_sortedness", "select event_id, user_id from (select event_id, user_id, lag(user_id) over (order by event_id) as before from events) where user_id < before")
def _(i: Inputs) -> DataFrame:
    return V.unsorted(i.events, "event_id", "user_id")


@_query("v11_evidence", "select l_orderkey, l_linenumber from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey <> 3)")
def _(i: Inputs) -> DataFrame:
    return M.dangling(i.lineitem, "l_suppkey", i.supplier.where("s_nationkey <> 3").select(F.col("s_suppkey").alias("node"))).select("l_orderkey", "l_linenumber")


@_query("t01_replay", "select tab, col, value from (select user_id as tab, event_type as col, value, row_number() over (partition by user_id, event_type order by event_id desc) as rn, event_id % 4 as kind from events) where rn = 1 and kind <> 3")
def _(i: Inputs) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 3, "remove").otherwise("change")
    ops = i.events.select(F.col("user_id").alias("table"), F.col("event_type").alias("column"), "value", F.col("event_id").alias("ord"), kind.alias("kind"))
    return R.replay_columns(ops).select(F.col("table").alias("tab"), F.col("column").alias("col"), "value")


@_query("t01_replay_renames")
def _(i: Inputs) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 3, "remove").when(F.col("event_id") % 5 == 4, "rename").when(F.col("event_id") % 5 == 0, "add").otherwise("change")
    ops = i.events.select(F.col("user_id").cast("string").alias("table"), F.col("event_id").alias("ord"), kind.alias("kind"), F.col("event_type").alias("column"), F.concat("event_type", F.lit("2")).alias("replacement"), F.col("props").alias("value"))
    return R.replay_with_renames(ops)


@_query("t02_ledger", "select user_id as execution, arg_max(event_type, event_id) as state, count(*) as revision from events group by 1")
def _(i: Inputs) -> DataFrame:
    return R.ledger_state(i.events.select(F.col("user_id").alias("execution"), F.col("event_type").alias("state"), F.col("event_id").alias("ord")))


from . import more  # noqa: E402, F401  # registers its queries here
