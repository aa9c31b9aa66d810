"""Classifiers by held-out accuracy, mixing by its targets, the pipeline by its stages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flatcel.llm import exact_dedup, mixing, quality, queries, toxicity
from flatcel.llm.common import table

SF = "/root/testdata/sf0.1"
EDGES = [(1, None), (2, ""), (3, "\n\n\n"), (4, "word"), (None, "word"), (5, "a\n" * 5000), (5, "a\n" * 5000), (6, "x" * 200_000)]


def edges(spark):
    return spark.createDataFrame(
        [(i, t, 1, "x", 2.0, [1.0]) for i, t in EDGES], "doc_id long, text string, label int, id string, score double, x array<double>"
    )


def auc(rows):
    rows = sorted(rows)
    rank, n1 = 0.0, sum(y for _, y in rows)
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        rank += sum(y for _, y in rows[i:j]) * (i + j + 1) / 2
        i = j
    return (rank - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))


@pytest.mark.parametrize("name,label,bar", [("op7_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.97)])
def test_held_out(spark, name, label, bar):
    got = queries.QUERIES[name](spark, SF)
    labels = table(spark, SF, "labels").select("doc_id", label)
    rows = got.where("held_out").join(labels, "doc_id").select("score", label, "predicted").collect()
    assert len(rows) > 300
    assert auc([(r[0], r[1]) for r in rows]) >= bar
    assert np.mean([r[1] == r[2] for r in rows]) >= 0.97
    assert all(0 <= r[0] <= 1 for r in rows)


def brute_marginals(unary, pair):
    """Sum over all labellings."""
    n = len(unary)
    good, total = np.zeros(n), 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(u for u, b in zip(unary, y) if b) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(0)
    pair, lengths = rng.normal(size=(2, 2)), np.array([5, 3, 1])
    unary = rng.normal(size=(3, 5)) * 2
    for i, n in enumerate(lengths):
        unary[i, n:] = 0
    good, moves = quality._marginals(unary, lengths, pair)
    for i, n in enumerate(lengths):
        assert np.allclose(good[i, :n], brute_marginals(unary[i, :n], pair))
        assert np.isclose(moves[i].sum(), n - 1)


def test_edge_texts(spark):
    docs = edges(spark)
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.WIDTH + 6)
    scores = quality.score(docs, weights).collect()
    assert len(scores) == len(EDGES) and all(0 <= r.score <= 1 for r in scores)
    kept = quality.drop_low_quality(docs, weights).collect()
    assert len(kept) == sum(r.score >= 0.5 for r in scores)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, none)
    assert [r.score for r in model.score(docs).collect()] == [0.0] * len(EDGES)
    assert not quality.train(docs, none).any()
    assert all(len(toxicity.Featurizer({})(t)) == toxicity.FEATURES for _, t in EDGES)
    empty = docs.limit(0)
    assert quality.score(empty, weights).collect() == [] == model.score(empty).collect() == mixing_rows(spark, [])


def test_quality_weights_do_not_follow_the_order_of_rows(spark):
    """Ids with several texts: the same one is learned from, however rows are dealt."""
    rows = [(i, f"{'a good long sentence about rivers.' if i % 2 else '$$ buy !!'} {i} {k}\nline {k}") for i in range(60) for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    weights = []
    for parts in (1, 7):
        rows.reverse()
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        weights.append(quality.train(docs, labels))
    assert np.allclose(weights[0], weights[1], rtol=0, atol=1e-9) and np.abs(weights[0]).max() > 0.1


def test_toxic_words_and_clean_texts(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    clean = labels.where("toxic = 0").select("doc_id")
    wrong = model.score(docs.join(clean, "doc_id")).where(F.col("score") >= toxicity.THRESHOLD).count()
    assert wrong <= 0.01 * clean.count()


MIX = "doc_id long, text string, source string, lang string, weight int, tokens int, copies int"


def mixing_rows(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, s, g, 1, 2, 3) for i, t, s, g in rows], MIX)
    return mixing.mix_sources(df, **kw).collect()


def rake_by_hand(cells, goals, rounds=200):
    w = dict(cells)
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            for v in {k[axis] for k in w}:
                total = sum(x for k, x in w.items() if k[axis] == v)
                for k in w:
                    if k[axis] == v:
                        w[k] *= goal[v] / total
    return w


def test_raking(spark):
    rows = []
    for i in range(300):
        rows.append((i, f"{'abc'[i % 3] * (4 + i % 5)} " * (1 + i % 7), f"s{i % 2}", ["en", "de", None][i % 3] if i % 5 else "en"))
    rows += [(900, None, "s0", "en"), (901, "", None, None)]
    got = {r.doc_id: r for r in mixing_rows(spark, rows)}
    assert len(got) == len(rows)
    assert got[900].weight == got[901].weight == 1.0 and got[900].tokens == 0
    cells = {}
    for r in got.values():
        if r.tokens:
            key = (r.source, r.lang, r.topic)
            cells[key] = cells.get(key, 0) + r.tokens
    total = sum(cells.values())
    goals = []
    for axis in range(3):
        share = {}
        for k, n in cells.items():
            share[k[axis]] = share.get(k[axis], 0) + n
        power = {v: n**mixing.SMOOTHING for v, n in share.items()}
        goals.append({v: p / sum(power.values()) * total for v, p in power.items()})
    want = rake_by_hand(cells, goals)
    for r in got.values():
        if r.tokens:
            key = (r.source, r.lang, r.topic)
            assert abs(r.weight - want[key] / cells[key]) < 0.02 * max(1, r.weight)
            assert int(r.weight) <= r.copies <= int(r.weight) + 1


def test_given_targets(spark):
    rows = [(i, "hello world again", f"s{i % 4}", "en") for i in range(4000)]
    shares = spark.createDataFrame([("s0", 0.7), ("s1", 0.1), ("s2", 0.1), ("s3", 0.1)], "source string, share double")
    got = mixing_rows(spark, rows, targets={"source": shares}, budget=0.5)
    tokens = sum(r.tokens * r.copies for r in got)
    first = sum(r.tokens * r.copies for r in got if r.source == "s0")
    assert abs(tokens / 12000 - 0.5) < 0.03 and abs(first / tokens - 0.7) < 0.03


def test_pipeline(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, "/root/testdata/sf0.01").cache()
        sizes.append(now.count())
        if name != "mixing":
            assert now.columns == docs.columns
            assert now.exceptAll(before).count() == 0
        if name == "exact_dedup":
            assert exact_dedup.exact_dedup(now).where("not kept").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.3 * sizes[0]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").count() == sizes[-1]
