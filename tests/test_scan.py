"""Ordered scans, hot-key joins and components with tiny buckets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from flatcel.operators import scan as SC
from flatcel.operators import graph
from flatcel.operators.graph import components
from flatcel.operators.skew import hot_limit, join_lookup, join_unique, largest_keys, with_group_facts


def test_scan_carries_over_buckets(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in "ab" for i in rng.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    fine = [{"i": F.floor(F.col("i") / 4)}, {"c": F.floor(F.col("__b_i") / 3)}]
    out = SC.scan(
        df, ["k"], ["i"], fine,
        total=SC.running_sum(F.coalesce("v", F.lit(0))),
        before=SC.running_sum(F.coalesce("v", F.lit(0)), inclusive=False),
        seen=SC.last_value(F.col("v")),
        ahead=SC.next_value(F.col("v"), inclusive=False),
        top=SC.running_max(F.col("v")),
        prev=SC.previous_row("i", "v"),
        pos=SC.running_count(inclusive=False),
    ).collect()
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in "ab"}
    assert len(out) == len(rows)
    for r in out:
        group = by_key[r.k]
        at = next(n for n, g in enumerate(group) if g[1] == r.i)
        vals = [g[2] for g in group]
        known = [x for x in vals[: at + 1] if x is not None]
        later = [x for x in vals[at + 1 :] if x is not None]
        assert r.total == sum(known)
        assert r.before == sum(x for x in vals[:at] if x is not None)
        assert r.seen == (known[-1] if known else None)
        assert r.ahead == (later[0] if later else None)
        assert r.top == (max(known) if known else None)
        assert r.prev == ((group[at - 1][1], group[at - 1][2]) if at else None)
        assert r.pos == at


def test_group_facts_with_hot_and_null_keys(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((None, 5), ("hot", 50), ("c", 2)) for i in range(n)], "k string, i int")
    out = with_group_facts(df, ["k"], {"low": F.min("i"), "n": F.count("*")})
    assert sorted((str(r.k), r.n) for r in out.select("k", "n").distinct().collect()) == [("None", 5), ("c", 2), ("hot", 50)]
    assert out.count() == 57


def test_components_equal_union_find(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(0, i) for i in range(200, 230)] + [(i, i + 1) for i in range(300, 340)]
    parent: dict[int, int] = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in list(parent)}
    df = spark.createDataFrame(edges, "src long, dst long")
    # All links in one task, then a few links a task and rounds between tasks; plain nodes and structs.
    for links in (1 << 20, 7):
        monkeypatch.setattr(graph, "CHUNK_LINKS", links)
        assert {r.node: r.component for r in components(df.repartition(5)).collect()} == want
        structs = df.selectExpr("struct('i' as image, src as y) as src", "struct('i' as image, dst as y) as dst")
        assert {r.node.y: r.component.y for r in components(structs).collect()} == want


def test_left_join_keeps_unmatched_rows_and_hot_keys(spark):
    """One key holds a third of the rows; more keys than are served by broadcast hold the rest."""
    keys = ["hot"] * 60 + [f"k{i}" for i in range(120)] + [None, None]
    left = spark.createDataFrame(list(zip(keys, range(len(keys)))), "k string, i int")
    known = {"hot": "H"} | {f"k{i}": f"v{i}" for i in range(0, 120, 2)}
    table = spark.createDataFrame([(k, 60 if k == "hot" else 1, v) for k, v in known.items()] + [(None, 2, "N")], "k string, n int, v string")
    want = sorted((i, k, known.get(k, "N" if k is None else None)) for i, k in enumerate(keys))
    assert hot_limit(left) < 60
    assert sorted((r.i, r.k, r.v) for r in join_unique(left, table, ["k"], "n", "left").collect()) == want
    plain = table.drop("n")
    assert sorted((r.i, r.k, r.v) for r in join_lookup(left, plain, ["k"], null_safe=True).collect()) == want
    matched = [w for w in want if w[2] is not None]
    assert sorted((r.i, r.k, r.v) for r in join_unique(left, table, ["k"], "n").collect()) == matched
    no_null = [(i, k, v if k else None) for i, k, v in want]
    assert sorted((r.i, r.k, r.v) for r in join_lookup(left, plain, ["k"]).collect()) == no_null
    inner = join_lookup(left, plain, ["k"], "inner")
    assert inner.columns == ["k", "i", "v"]
    assert sorted((r.i, r.k, r.v) for r in inner.collect()) == [w for w in no_null if w[2]]


def test_hot_keys_are_few(spark):
    """However many keys there are, a constant number of them is broadcast, the largest first."""
    stats = spark.range(10_000).selectExpr("id as k", "if(id = 7, 5000000, 1000001) as n")
    few = [r.k for r in largest_keys(stats, ["k"], "n").collect()]
    assert few[0] == 7 and len(few) == hot_limit(stats)


def test_rounds_leave_no_files(spark, monkeypatch):
    from flatcel import session

    before = set(session._FOLDERS)
    monkeypatch.setattr(graph, "CHUNK_LINKS", 20)
    edges = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    out = components(edges)
    assert out.where("component <> 0").count() == 0
    assert len(set(session._FOLDERS) - before) == 1


def test_summaries_of_buckets_are_not_broadcast(spark):
    rows = spark.range(1000).selectExpr("id as k", "cast(0 as int) as y")
    out = SC.scan(rows, ["k"], ["y"], SC.by_number("y"), n=SC.running_count())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert out.agg(F.sum("n")).first()[0] == 1000
