"""Operators on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import aggregates as A
from cairn.operators import deltas as D
from cairn.operators import graph as G
from cairn.operators import matching as M
from cairn.operators import replay as R
from cairn.operators import search as S
from cairn.operators import verify as V
from cairn.sources import records as IO


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_pairing_counts_multiplicity(spark):
    b = table(spark, "identity string, id string", ("x", "a"), ("x", "b"))
    c = table(spark, "identity string, id string", ("x", "c"))
    got = sorted((r.status, r.occurrence) for r in D.pair_by_occurrence(b, c).collect())
    assert got == [("resolved", 2), ("unchanged", 1)]


@pytest.mark.parametrize("turned", [False, True])
def test_pairing_prefers_equal_ids(spark, turned):
    rows = [("x", "a"), ("x", "b"), ("y", "z")]
    b = table(spark, "identity string, id string", *(rows[::-1] if turned else rows))
    c = table(spark, "identity string, id string", ("x", "b"), ("y", "q"))
    got = {(r.identity, r.b_id, r.c_id, r.status) for r in D.pair_by_occurrence(b, c).collect()}
    assert got == {("x", "b", "b", "unchanged"), ("x", "a", None, "resolved"), ("y", "z", "q", "unchanged")}


@pytest.mark.parametrize("depth, expected", [(0, {"i": 0}), (1, {"i": 0, "m": 1}), (2, {"i": 0, "m": 1, "l": 2}), (None, {"i": 0, "m": 1, "l": 2})])
def test_k_hop_on_a_cycle(spark, depth, expected):
    e = table(spark, "src string, dst string", ("i", "m"), ("m", "l"), ("l", "i"))
    assert {r.node: r.depth for r in G.k_hop(e, table(spark, "node string", ("i",)), depth).collect()} == expected


def test_loaded_closure_needs_complete_scopes(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("t", "u"))
    scopes = table(spark, "loader string, target string, complete boolean", ("b", "t", True), ("b", "v", False))
    assert {r.node for r in G.loaded_closure(e, table(spark, "node string", ("a",)), scopes).collect()} == {"a", "b", "t", "u"}


def test_removal_propagates_over_both_generations(spark):
    old = table(spark, "src string, dst string", ("a", "b"))
    new = table(spark, "src string, dst string", ("c", "a"))
    assert {r.node for r in G.impact_closure(old, new, table(spark, "node string", ("b",))).collect()} == {"a", "b", "c"}


def test_stale_anchor_keeps_the_finding(spark):
    f = table(spark, "id string, identity string", ("1", "x"), ("2", "y"), ("3", "z"))
    ledger = table(spark, "identity string, anchors array<struct<path:string,sha256:string>>", ("x", [("p", "s")]), ("y", [("p", "s"), ("gone", "s")]))
    files = table(spark, "path string, sha256 string", ("p", "s"))
    assert {r.id: r.state for r in M.apply_dispositions(f, ledger, files).collect()} == {"1": "suppressed", "2": "stale", "3": "kept"}


def test_severity_is_never_upgraded(spark):
    got = table(spark, "s string, c string", ("low", "high"), ("high", "medium"), ("info", "low")).select(A.capped_severity(F.col("s"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["low", "medium", "info"]


@pytest.mark.parametrize("glob, path, hit", [("**/a.ts", "a.ts", True), ("**/a.ts", "x/y/a.ts", True), ("src/**", "src", True), ("src/**", "srcs/x", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("*.md", "x/a.md", False), ("?.md", "a.md", True), ("**", "any/thing", True)])
def test_globs(glob, path, hit):
    assert bool(re.search(T.glob_regex(glob), path)) is hit


def test_routes(spark):
    routes = table(spark, "segments array<string>, method string", (["a", ":id"], "GET"), (["b", ":x?"], "ANY"))
    clients = table(spark, "client_id int, segments array<string>, method string", (1, ["a", "7"], "GET"), (2, ["a", "7"], "POST"), (3, ["b"], "PUT"), (4, ["c"], "GET"), (5, ["a", "7"], "HEAD"))
    assert {r.client_id: r.state for r in M.route_mismatches(clients, routes).collect()} == {2: "method", 4: "missing"}
    import itertools

    segments = [list(x) for x in itertools.product(["a", "b", ":p"], repeat=3)]
    routes = [(x, "GET") for x in segments[::4]]
    clients = [(k, x, "GET") for k, x in enumerate(segments)]
    hit = lambda c: any(all(a == b or ":" in a[:1] or ":" in b[:1] for a, b in zip(c, r)) for r, _ in routes)
    got = {r.client_id for r in M.route_mismatches(table(spark, "client_id int, segments array<string>, method string", *clients), table(spark, "segments array<string>, method string", *routes)).collect()}
    assert got == {k for k, c, _ in clients if not hit(c)}


def test_delta_sees_nulls(spark):
    old = table(spark, "k int, a string, b string", (1, None, "x"), (2, None, None), (3, "x", None))
    new = table(spark, "k int, a string, b string", (1, "x", None), (2, None, None), (3, "x", None))
    from cairn.operators import deltas as D

    assert {r.k: r.status for r in D.delta(old, new, "k", ["a", "b"]).collect()} == {1: "changed", 2: "same", 3: "same"}


def test_unsorted_over_gaps(spark):
    from cairn.operators import verify as V

    rows = [(0, 5), (5000, 1), (5001, 2), (3_000_000, 1), (9_000_000, 7), (9_000_001, 7)]
    assert sorted(r.o for r in V.unsorted(table(spark, "o long, k int", *rows), "o", "k").collect()) == [5000, 3_000_000]


def test_ranked_is_one_total_order(spark):
    from cairn.operators import aggregates as A

    df = spark.range(5000).selectExpr("id", "id * 7919 % 5003 as k").repartition(7)
    assert all(r.place == e for e, r in enumerate(sorted(A.ranked(df, [F.col("k"), F.col("id")], "place").collect(), key=lambda r: (r.k, r.id)), 1))


def test_replay_with_renames(spark):
    ops = table(spark, "table string, ord int, kind string, column string, replacement string, value string", ("t", 1, "add", "a", None, "1"), ("t", 2, "rename", "a", "b", None), ("t", 3, "add", "b", None, "2"), ("t", 4, "rename", "q", "r", None))
    assert {(r.column, r.value, r.uncertain) for r in R.replay_with_renames(ops).collect()} == {("b", "1", True), ("r", None, True)}


def test_search_scores_whole_label_and_path(spark):
    files = table(spark, "id string, path string, label string", ("1", "a/b.ts", "a/b.ts"), ("2", "c", "see a/b.ts here"), ("3", "d", "none"))
    got = [(r.id, r.score) for r in S.lexical("a/b.ts", 10, files).collect()]
    assert got == [("1", 300), ("2", 20)]


def test_unsorted_over_block_bounds(spark):
    rows = [(i, i if i != 1024 else 5) for i in range(1100)]
    assert [r.o for r in V.unsorted(table(spark, "o int, k int", *rows), "o", "k").collect()] == [1024]


def test_names_and_nfc(spark):
    row = table(spark, "a string, b string", ("fooBarIds", "é")).select(T.name_tokens(F.col("a")).alias("t"), T.nfc("b").alias("n")).first()
    assert row.t == ["foo", "bar", "id"] and row.n == "é"


def test_jsonl_round_trip_and_census(spark, tmp_path):
    out = str(tmp_path / "t.jsonl")
    IO.write_jsonl(table(spark, "b string, a int", ("x", 2), ("y", 1)), out, "a")
    assert [(r.a, r.b) for r in IO.read_jsonl(spark, out, "a int, b string").orderBy("a").collect()] == [(1, "y"), (2, "x")]
    with pytest.raises(FileExistsError):
        IO.write_jsonl(table(spark, "a int", (1,)), out, "a")
    root = tmp_path / "src"
    (root / "tests").mkdir(parents=True)
    (root / "a.ts").write_text("x")
    (root / "tests" / "b.json").write_bytes(b"\x00")
    got = {r.path: (r.language, r.kind, r.binary) for r in IO.census(spark, str(root)).collect()}
    assert got == {"a.ts": ("typescript", "source", False), "tests/b.json": ("json", "test", True)}


def test_index_records(spark):
    got = IO.index_records(table(spark, "value string", ("100644 " + "a" * 40 + " 0\tx y.ts",), ("bad",))).collect()
    assert [(r.mode, r.stage, r.path) for r in got] == [("100644", 0, "x y.ts")]


def test_renames_against_a_column_at_a_time(spark):
    """The fold against one that asks for each name at the end what the last operations made of it."""
    import random

    from cairn.operators import replay as R

    rng = random.Random(5)
    ops = [(f"t{rng.randrange(6)}", k, rng.choice(["add", "change", "remove", "rename"]), rng.choice("abc"), rng.choice("abcd"), f"v{k}") for k in range(300)]
    got = {(r.table, r.column): (r.value, r.uncertain) for r in R.replay_with_renames(table(spark, "table string, ord int, kind string, column string, replacement string, value string", *ops)).collect()}

    def held(tab, name, upto):
        """(value or None, doubt) of a name after the first ``upto`` operations, by looking backwards."""
        for at in range(upto - 1, -1, -1):
            t, _, kind, column, target, v = ops[at]
            if t != tab or name not in ((column, target) if kind == "rename" else (column,)):
                continue
            if kind == "change":
                return v, False
            if kind == "remove":
                return None, False
            before = held(tab, name, at)
            if kind == "add":
                return (before[0], True) if before[0] is not None else (v, False)
            source = held(tab, column, at)[0]
            if name == target:
                there = before if name != column else (None, False)
                if there[0] is not None or source is None:
                    return there[0], True
                return source, there[1]
            return None, False
        return None, False

    expected = {(t, n): x for t in {o[0] for o in ops} for n in "abcd" if (x := held(t, n, len(ops))) != (None, False)}
    assert got == expected

@pytest.fixture
def cuts(monkeypatch):
    """The numbers of rows that graph loops checkpoint."""
    rows, cut = [], G.cut

    def counted(df):
        done = cut(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(G, "cut", counted)
    return rows


def _fan(spark, n=300):
    """a leads to n leaves, each of them to b; the edges are given twice."""
    leaves = spark.range(n).select(F.concat(F.lit("x"), "id").alias("x"))
    once = leaves.select(F.lit("a").alias("src"), F.col("x").alias("dst")).union(leaves.select("x", F.lit("b")))
    return once.union(once)


@pytest.mark.parametrize("few", [0, 10_000])
def test_layers_do_not_store_the_edges(spark, monkeypatch, cuts, few):
    monkeypatch.setattr(G, "FEW", few, raising=False)
    e = _fan(spark)
    ranks = {r.node: r["rank"] for r in G.layers(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).collect()}
    assert ranks == {"a": 0, "b": 2} | {f"x{i}": 1 for i in range(300)}
    assert max(cuts) <= 302


def test_layers_within_nodes_and_on_cycles(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "a"))
    whole = {r.node: r["rank"] for r in G.layers(e, most=3).collect()}
    assert whole == {"x": 0, "a": 1, "b": 3, "c": 3, "d": 3}
    part = {r.node: r["rank"] for r in G.layers(e, table(spark, "node string", ("a",), ("b",), ("d",), ("y",)), 3).collect()}
    assert part == {"a": 0, "b": 1, "d": 0, "y": 0}


@pytest.mark.parametrize("few", [0, 10_000])
def test_k_hop_does_not_store_the_edges(spark, monkeypatch, cuts, few):
    monkeypatch.setattr(G, "FEW", few, raising=False)
    found = {r.node: r.depth for r in G.k_hop(_fan(spark), table(spark, "node string", ("a",))).collect()}
    assert found == {"a": 0, "b": 2} | {f"x{i}": 1 for i in range(300)}
    assert max(cuts) <= 300


def test_k_hop_beyond_the_rounds_that_read_edges(spark):
    chain = spark.range(12).select(F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst"))
    assert {r.node: r.depth for r in G.k_hop(chain, table(spark, "node string", ("v0",))).collect()} == {f"v{i}": i for i in range(13)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_contexts_do_not_store_the_edges(spark, monkeypatch, cuts, few):
    monkeypatch.setattr(G, "FEW", few, raising=False)
    entry = table(spark, "node string, scope string", ("a", "test"), ("x1", "production"), ("x1", "test"), ("x2", None))
    got = {r.node: (r.origins, r.scopes) for r in G.contexts_by_scope(_fan(spark), entry).collect()}
    assert got == {"a": (1, "test"), "b": (3, "production,test"), "x1": (2, "production,test"), "x2": (2, "test")} | {f"x{i}": (1, "test") for i in range(300) if i not in (1, 2)}
    assert max(cuts) < 600


def test_loaded_closure_takes_one_closure(spark, cuts):
    e = table(spark, "src string, dst string", ("a", "b"), ("t", "u"), ("u", "a"))
    scopes = table(spark, "loader string, target string, complete boolean", ("b", "t", True), ("u", "w", True), ("u", "v", False))
    assert {r.node for r in G.loaded_closure(e, table(spark, "node string", ("a",)), scopes).collect()} == {"a", "b", "t", "u", "w"}
    assert len(cuts) <= 6


def test_clusters_count_before_the_targets_are_looked_up(spark):
    e = table(spark, "src string, dst string, type string", ("a1", "b1", "t"), ("a2", "b1", "t"), ("a1", "b2", "t"), ("b1", "a1", "u"))
    nodes = table(spark, "node string, cluster string", ("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b"))
    got = A.cluster_edges(e, nodes)
    assert sorted((r.src_cluster, r.dst_cluster, r.type, r.n) for r in got.collect()) == [("a", "b", "t", 3), ("b", "a", "u", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("Exchange hashpartitioning")


def test_adjacency_shuffles_once(spark):
    e = table(spark, "src string, dst string", ("a", "c"), ("a", "b"), ("a", "b"), ("a", "d"), ("b", "d"))
    got = G.adjacency(e, 2)
    assert sorted((r.node, r.direction, r.part, r.neighbours) for r in got.collect()) == [
        ("a", "out", 0, ["b", "c"]), ("a", "out", 1, ["d"]), ("b", "in", 0, ["a"]), ("b", "out", 0, ["d"]), ("c", "in", 0, ["a"]), ("d", "in", 0, ["a", "b"])]
    assert _exchanges(got) == 1


def test_instance_delta_shuffles_once(spark):
    old = table(spark, "pattern int, instance int", (1, 1), (1, 2), (1, 2), (2, 1), (None, 1), (4, None))
    new = table(spark, "pattern int, instance int", (1, 2), (1, 3), (1, 3), (3, 1), (None, 2), (4, None))
    got = D.instance_delta(old, new)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, "removed"), (1, 3, "added"), (4, None, "removed"), (4, None, "added")], key=repr)
    assert _exchanges(got) == 1
