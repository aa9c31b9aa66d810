"""Exact, near and substring dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from flatcel.llm import exact_dedup as X
from flatcel.llm import simhash as S
from flatcel.llm import suffix_dedup as U
from flatcel.llm.components import linked_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, k int, bucket string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 3, "z") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'äéß'[rng.randrange(3)]}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, words(rng, rng.randrange(1, 200))) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(20)]  # exact copies
    out += [(200 + i, " " + out[i][1].replace(" ", "\n\t")) for i in range(10)]  # longer or equal originals
    out += [(300 + i, out[5][1] + f" tail{i}") for i in range(30)]  # near copies
    passage = words(rng, 60)
    out += [(400 + i, words(rng, 20) + " " + passage + " " + words(rng, 9)) for i in range(12)]
    out += [(500, None), (501, ""), (502, "  \n"), (503, "a" * 700), (504, "ab" * 400), (505, passage * 3)]
    out += [(60, out[0][1]), (60, out[0][1])]  # a repeated row
    rng.shuffle(out)
    return out


def by_hand_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))
        for i, t in members:
            out.append((i, keep[0], len(members), i == keep[0] and len(t) == len(keep[1]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [X.TRIE_BYTES, 2_000])
def test_exact(spark, rows, limit):
    got = X.exact_dedup(frame(spark, rows).repartition(5), trie_bytes=limit)
    assert sorted(map(tuple, got.collect())) == by_hand_exact(rows)


def test_exact_null_ids(spark):
    got = X.exact_dedup(frame(spark, [(None, "a b"), (None, "ab"), (7, "a b"), (None, "zz"), (None, "zz")]))
    rows = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect())
    assert rows == [(0, 0, 2, True), (0, 0, 2, True), (0, 7, 3, False), (0, 7, 3, False), (7, 7, 3, True)]
    docs = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "q"), (None, "q")])
    assert sorted((r.doc_id or 0, r.text) for r in X.drop_exact_copies(docs).collect()) == [(0, "q"), (1, "a")]



def test_drop_exact_shared_ids(spark):
    """A copy goes even if its id is null or repeated and kept for another text."""
    rows = [(7, "b"), (None, "b"), (None, "q"), (3, "x y"), (7, "x\x0by"), (8, None), (9, " \n"), (9, "w"), (7, "w"), (4, "pq"), (4, "p q")]
    left = X.drop_exact_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "q"), (3, "x y"), (4, "p q"), (7, "b"), (7, "w"), (9, " \n")]


def test_drop_exact_picks_one_of_repeated_rows(spark):
    rows = [(1, "a", "s2", 1), (1, "a", "s1", 9), (1, "a", "s1", 3), (2, "b", None, 1), (2, "b", "s", 0), (2, "B", "s", 0)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
        left = sorted(map(tuple, X.drop_exact_copies(docs).collect()), key=str)
        assert left == [(1, "a", "s1", 3), (2, "B", "s", 0), (2, "b", None, 1)]


def test_trie_terminals():
    trie = X.PatriciaTrie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc" * 50, b"abc" * 49 + b"x"]
    for i, k in enumerate(keys):
        trie.terminal(k).owner = (i,)
    for i, k in enumerate(keys):
        assert trie.terminal(k).owner == (i,)
    assert sorted(trie.pop_all()) == sorted((k, (i,)) for i, k in enumerate(keys))
    assert list(trie.pop_all()) == []


def fingerprint_by_hand(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_hand_near(rows):
    fps = {i: fingerprint_by_hand(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, f"{fps[i]:016x}", find(i)) for i, _ in rows)


def test_near(spark, rows):
    got = S.near_dedup(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == by_hand_near(rows)


def test_links_are_complete(spark):
    """Chains and pairs at distances 1, 2 and 3, in every kind of block."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        g = f
        for _ in range(4):
            bits = rng.sample(range(64), rng.choice([1, 2, 2, 3]))
            g ^= sum(1 << b for b in bits)
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in linked_components(S.near_links(df)).collect()}
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= 2:
                parent[find(b)] = find(a)
    for a in fps:
        for b in fps:
            same = got.get(S._signed(a), S._signed(a)) == got.get(S._signed(b), S._signed(b))
            assert same == (find(a) == find(b))


def test_drop_near(spark, rows):
    left = {r.doc_id for r in S.drop_near_copies(frame(spark, rows)).collect()}
    assert left == {c for _, _, c in by_hand_near(rows)}


def by_hand_repeats(rows, length=100):
    texts = dict(rows)
    seen, out = set(), []
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {r[0]: r for r in out}


@pytest.mark.parametrize("parts", [1, 7])
def test_repeats(spark, rows, parts):
    want = by_hand_repeats(rows)
    got = U.suffix_dedup(frame(spark, rows).repartition(parts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want[i] for i, _ in rows)
    assert sum(r.n_removed > 0 for r in got) > 30


def test_repeats_random_edits(spark):
    """Copies with edits everywhere, so that most windows meet in unlike contexts."""
    rng = random.Random(11)
    base = words(rng, 300)
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randrange(6)):
            p = rng.randrange(len(t))
            t[p : p + rng.randrange(3)] = "#" * rng.randrange(3)
        rows.append((i, "".join(t)))
    want = by_hand_repeats(rows)
    got = U.suffix_dedup(frame(spark, rows).repartition(6)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want.values())


def test_repeats_shared_and_null_ids(spark):
    text = words(random.Random(2), 60)
    docs = frame(spark, [(None, text), (5, text), (5, "q" + text), (5, text)])
    got = {(r.doc_id, r.n_bytes - len(text.encode())): r.n_removed for r in U.suffix_dedup(docs).collect()}
    # Of the two texts with id 5 one is first and whole; the null id comes last.
    assert got[None, 0] == len(text.encode())
    assert sorted([got[5, 0] > 0, got[5, 1] > 0]) == [False, True]


def test_pieces_of_long_texts():
    text = bytes(random.Random(1).randrange(256) for _ in range(5000))
    old, U._CHUNK = U._CHUNK, 1000
    try:
        pieces = list(U._pieces(1, text, 100))
    finally:
        U._CHUNK = old
    windows = [o + p for _, o, b in pieces for p in range(len(b) - 99)]
    assert sorted(windows) == list(range(4901))
    assert all(text[o : o + len(b)] == b for _, o, b in pieces)


def test_loser_tree():
    rng = random.Random(9)
    runs = []
    for k in range(7):
        run = sorted((bytes(rng.choice(b"ab") for _ in range(12)), k, i, 1, 2, b"x") for i in range(rng.randrange(40)))
        runs.append(run)
    merged = list(U.LoserTree([U.decoded(U.front_coded(r)) for r in runs]))
    assert [m[1] for m in merged] == sorted(x[0] for r in runs for x in r)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == U.shared(a[1], b[1])


@pytest.mark.parametrize("op", [X.exact_dedup, S.near_dedup, U.suffix_dedup, X.drop_exact_copies, S.drop_near_copies])
def test_empty(spark, op):
    assert op(frame(spark, [])).collect() == []
