"""Lexical search, whitening and license scans against plain versions on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flatcel.llm import lexical_search as S
from flatcel.llm import license_scan as LS
from flatcel.llm import whitening as W

# Columns besides id and text carry names the operators use inside.
DOCS = "doc_id long, text string, id string, t string, pos int, term int, chunk int, spans string"
ITEMS = "item_id string, text string, query int, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, 2, 3, "c") for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], ITEMS)


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked_by_hand(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 25 + (75 * n * n_docs) // length if length else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item or "", r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df):
    return sorted((r.item_id or "", r["rank"], r.doc_id or 0, r.score) for r in df.collect())


def corpus(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "日本"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n))
    items = [(f"i{k}", draw(rng.randrange(3, 30))) for k in range(n_items)]
    docs = [(k, draw(rng.randrange(1, 120))) for k in range(n_docs)]
    # Passages of items, copies, copies of copies.
    docs += [(n_docs + k, docs[k][1] + ". " + items[k % n_items][1].upper()) for k in range(40)]
    docs += [(n_docs + 100 + k, docs[n_docs][1]) for k in range(60)]
    return docs, items


def test_search_equals_scoring_everything(spark, monkeypatch):
    docs, items = corpus(1, 400, 12)
    # Small chunks and slices, so that every query crosses several of them.
    monkeypatch.setattr(S, "CHUNK_CELLS", 2000)
    monkeypatch.setattr(S, "SLICE_TERMS", 60)
    assert found(S.search(docs_of(spark, docs), items_of(spark, items))) == ranked_by_hand(docs, items)


def test_search_skips_only_blocks_below_the_limit(spark):
    docs, items = corpus(2, 600, 6)
    items = [(i, t + " " + t) for i, t in items]
    (queries,) = S._slices(items_of(spark, items), "item_id", "text")
    ready = S.prepare(docs_of(spark, docs), queries, 3, "doc_id", "text")
    blocks = ready.index.count()
    seen = S.visits(ready.index, queries, ready.entries, ready.limits).collect()
    assert 0 < len(seen) < blocks
    want = ranked_by_hand(docs, items, 3)
    ids = {(r.chunk, r.pos): r.id for r in ready.chunks.select("chunk", "pos", "id").collect()}
    visited = {(queries.ids[q], ids[r["at"], d]) for r in seen for q in r.queries for d in r.docs}
    assert {(i, d) for i, _, d, _ in want} <= visited
    assert all(ready.limits[queries.ids.index(i)] <= s for i, r, _, s in want)


def test_search_summaries_are_greatest_impacts(spark):
    docs, items = corpus(3, 150, 4)
    (queries,) = S._slices(items_of(spark, items), "item_id", "text")
    ready = S.prepare(docs_of(spark, docs), queries, 10, "doc_id", "text")
    cells = {(r.chunk, r.pos): dict(zip(r.terms, r.impacts)) for r in ready.chunks.collect()}
    posted = {t: set() for t in ready.entries}
    for b in ready.index.collect():
        columns = set(queries.columns(ready.entries[b.term]).tolist())
        most = {}
        for d in b.docs:
            posted[b.term].add((b.chunk, d))
            for t, v in cells[b.chunk, d].items():
                if t in columns:
                    most[t] = max(v, most.get(t, 0))
        assert dict(zip(b.coords, b.most)) == most
    for t, members in posted.items():
        assert members == {at for at, c in cells.items() if t in c}


def test_search_nulls_ties_repeats_and_long_texts(spark):
    docs = [(5, "red fox"), (3, "red fox"), (3, "red fox"), (None, "red fox"), (7, None), (8, ""), (9, "..."), (10, "blue " * 60_000 + "fox")]
    items = [("a", "Red, red fox!"), ("a", "Red, red fox!"), ("b", None), (None, "blue"), ("c", ""), ("d", "nowhere")]
    got = found(S.search(docs_of(spark, docs), items_of(spark, items)))
    want = ranked_by_hand(docs, items)
    assert got == sorted((i, r, d or 0, s) for i, r, d, s in want)
    # Both rows of item a rank alike: equal scores by id, the null id (here 0) last.
    assert [d for i, _, d, _ in got if i == "a"] == [3, 3, 3, 3, 5, 5, 0, 0, 10, 10]


def test_search_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, [(1, "x"), (2, "x y")])
    assert S.search(none, items_of(spark, [("a", "x")])).count() == 0
    assert S.search(some, items_of(spark, [])).count() == 0
    out = S.search(some, items_of(spark, [("a", "z")]))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


# --- whitening -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, h string, x int, w double, z int, copies int, n long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2.0, 3, 4, 5) for i, v in rows], VECTORS)


def whitened_by_hand(x, k):
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return centred @ axes / np.sqrt(values), values / (centred**2).sum() * n, ((n * x - sums) ** 2).sum(axis=1)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(60, 12)) * np.linspace(1, 3, 12)).astype("float32")
    data = np.concatenate([base, np.repeat(base[:1], 40, axis=0), base[5:9]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0])]
    got = W.whiten(vectors_of(spark, rows + bad)).toPandas()
    x = np.floor(1024 * data.astype(float)).astype("int64") + 100_000
    z, share, far = whitened_by_hand(x, 8)
    assert sorted(got.vec_id.unique()) == list(range(len(data))) and set(got.n) == {len(data)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(wide) - np.abs(z)).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == far).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    cov = wide.T @ wide / len(wide)
    assert np.abs(cov - np.eye(8)).max() < 1e-9


def test_whiten_counts_distinct_vectors_once(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 4)).astype("float32")
    data = np.concatenate([base, np.repeat(base[:1], 50, axis=0)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    got = W.whiten(vectors_of(spark, rows), components=4, weights="one").toPandas()
    z, share, _ = whitened_by_hand(np.floor(1024 * base.astype(float)).astype("int64") + 100_000, 4)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert set(got.n) == {30} and np.abs(np.abs(wide[:30]) - np.abs(z)).max() < 1e-9
    assert np.allclose(wide[30:], wide[0]) and np.allclose(got.groupby("component").explained.first(), share)
    with pytest.raises(ValueError):
        W.whiten(vectors_of(spark, rows), weights="all")


def test_whiten_without_variance_and_odd_tables(spark):
    assert W.whiten(vectors_of(spark, [])).count() == 0
    assert W.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    # One direction of variance in three dimensions; repeated and null ids; entries too large for 64 bits.
    rows = [(1, [0.0, 0.0, 5.0]), (1, [2.0, 2.0, 5.0]), (None, [2.0, 2.0, 5.0]), (2, [4.0, 4.0, 5.0])]
    got = W.whiten(vectors_of(spark, rows)).toPandas()
    assert len(got) == 4 and set(got.component) == {1} and abs(got.explained.iloc[0] - 1) < 1e-12
    far = W.whiten(vectors_of(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])])).toPandas()
    assert len(far) and far.deviation.isna().any() and far.identity_error.iloc[0] < 1e-4


# --- licenses ------------------------------------------------------------------------


def pattern_of(template):
    out = []
    for part in re.findall(r"<<.*?>>|[^<\s]+", template):
        mark = part.strip("<>").split()
        out.append(
            "(?:" if part == "<<opt>>" else ")?" if part == "<</opt>>"
            else rf"(?: [^ ]+){{{mark[1]},{mark[2]}}}" if part.startswith("<<var")
            else " (?:" + "|".join(mark[2:]) + ")" if part.startswith("<<one") else " " + part
        )
    return re.compile("".join(out) + "(?= )")


def licensed_by_hand(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    line = " " + " ".join(words) + " "
    labels = {n for n, t in (LS.BASE | LS.TEMPLATES).items() if pattern_of(t).search(line)}
    places = [i for n, p in LS.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = labels & set(LS.BASE)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


MIT = re.sub("<<.*?>>", " ", LS.TEMPLATES["mit-text"].replace("<<var 1 12>>", "the Authors or Copyright Holders"))
TEXTS = [
    (1, "Released UNDER the MIT-License, under the mit license."),
    (2, "Licensed under the Apache License, Version 2.0; cc by-nc 4.0 and CC BY 4.0."),
    (3, "/* " + MIT.upper() + " */"),
    (4, MIT.replace("merge", "fuse")),
    (5, MIT.replace("shall be  included", "X included").replace("copyright notice", "copyright  notice")),
    (6, "GNU Lesser General Public License, version 2; gnu general public license as published by version 3"),
    (7, None),
    (8, ""),
    (9, "..."),
    (None, "all rights reserved"),
    (1, "Released UNDER the MIT-License, under the mit license."),
    (10, "under " * 50_000 + "the mit license " + "ä😀 " * 20_000 + "cc by nc"),
    (11, "under the mit licenses; xunder the mit license; under the mit license0"),
    (12, "Creative Commons Attribution-NonCommercial-ShareAlike 4.0; SPDX-License-Identifier: MIT"),
]


def test_licenses(spark):
    got = LS.license_report(docs_of(spark, TEXTS)).collect()
    digest = lambda r: (r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
    key = lambda row: [-1 if v is None else v for v in row]
    assert sorted(map(digest, got), key=key) == sorted([(i or 0, *licensed_by_hand(t)) for i, t in TEXTS], key=key)
    by_id = {r.doc_id: r for r in got}
    assert "mit-text" in by_id[3].labels and "mit-text" not in by_id[4].labels
    assert by_id[8].score == 0 < by_id[None].score < by_id[3].score <= 1
    assert LS.license_report(docs_of(spark, [])).count() == 0


def test_template_markup():
    a = LS.compile_template("x", "a <<opt>>b <<opt>>c<</opt>><</opt>> <<var 0 2>> <<one of d e>> f")
    accepts = lambda text: a.longest([w.encode() for w in text.split()], 0) == len(text.split())
    for good in ("a d f", "a b e f", "a b c d f", "a q r e f", "a b c q r d f", "a c d f"):
        assert accepts(good), good
    for bad in ("a f", "a q r s d f", "a b c q r s d f", "b d f", "a d g"):
        assert not accepts(bad), bad
    assert a.mandatory == 3
    for wrong in ("<<opt>>a<</opt>>", "<<var 0 2>> a", "a <<opt>> b", "a <</opt>>", "a <<any>> b", "a <<var 3 1>> b"):
        with pytest.raises(ValueError):
            LS.compile_template("x", wrong)


def test_spans_are_longest_runs(spark):
    rows = [(1, "x gnu general public license as published by the free software foundation either version 3 y gnu general public license version 2")]
    (row,) = LS.license_spans(docs_of(spark, rows), {"gpl": LS.TEMPLATES["gpl"]}).collect()
    assert [(s["label"], s["first"], s["end"]) for s in row.spans] == [("gpl", 1, 15), ("gpl", 16, 22)]
