"""Operators without a SQL oracle against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatcel.functions import arrays as AR
from flatcel.operators import assets as A
from flatcel.operators import matching as M
from flatcel.operators import pixels as X
from flatcel.operators import regions as R
from flatcel.operators import segmentation as SG
from flatcel.operators import sequences as Q
from flatcel.operators import timeline as TL
from flatcel.operators import top_matches as TM


def image(spark, rows, column="v"):
    return spark.createDataFrame(
        [(1, y, x, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], f"image_id long, y int, x int, {column} int"
    )


def as_array(df, shape, column):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def flood(grid, diagonal=False):
    h, w = grid.shape
    label = -np.ones((h, w), int)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    n = 0
    for y in range(h):
        for x in range(w):
            if label[y, x] < 0:
                stack, label[y, x] = [(y, x)], n
                while stack:
                    cy, cx = stack.pop()
                    for dy, dx in steps:
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < h and 0 <= nx < w and label[ny, nx] < 0 and grid[ny, nx] == grid[cy, cx]:
                            label[ny, nx] = n
                            stack.append((ny, nx))
                n += 1
    return label


def test_labels_do_not_depend_on_tiles(spark):
    grid = np.random.default_rng(5).integers(0, 2, (23, 31))
    want = flood(grid)
    for tile in (7, 64):
        got = R.number_regions(R.label_regions(image(spark, grid), tile=tile))
        assert np.array_equal(as_array(got, grid.shape, "label"), want)


def greedy(points, d):
    kept = []
    for p in points:
        if all((p[0] - k[0]) ** 2 + (p[1] - k[1]) ** 2 > d * d for k in kept):
            kept.append(p)
    return kept


def test_dedupe_points(spark):
    rng = random.Random(2)
    points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(200)})
    df = spark.createDataFrame([(1, *p) for p in points], "image_id long, y int, x int")
    got = R.dedupe_points(df, 4)
    assert sorted((r.y, r.x) for r in got.collect()) == sorted(greedy(points, 4))


def test_dedupe_points_at_one_place(spark):
    rows = [(1, 5, 5, "endpoint"), (1, 5, 5, "junction"), (1, 20, 20, "corner"), (1, 20, 20, "corner")]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, kind string")
    got = R.dedupe_points(df, 3)
    assert sorted((r.y, r.kind) for r in got.collect()) == [(5, "endpoint"), (20, "corner")]


def test_dedupe_points_over_tiles(spark):
    """Chains of points that cross tile borders, two images, repeated rows."""
    rng = random.Random(6)
    points = sorted({(rng.randrange(300), rng.randrange(240, 280)) for _ in range(500)})
    rows = [(i, y, x) for i in (1, 2) for y, x in points] * 2
    df = spark.createDataFrame(rows, "image_id long, y int, x int")
    out = R.dedupe_points(df, 3)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((i, *p) for i in (1, 2) for p in greedy(points, 3))


def test_spaced_sample(spark):
    df = spark.createDataFrame([(i, y, x) for i in (1, 2) for y in range(0, 20, 1 + i) for x in range(20)], "image_id long, y int, x int")
    rows = R.spaced_sample(df, 6, 5, seed=9).collect()
    for i in (1, 2):
        pts = [(r.y, r.x) for r in rows if r.image_id == i]
        assert 0 < len(pts) <= 6
        assert all(math.dist(a, b) > 5 for n, a in enumerate(pts) for b in pts[:n])


def closure(boxes):
    boxes = set(boxes)
    while True:
        for a in boxes:
            hit = next((b for b in boxes if b != a and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]), None)
            if hit:
                boxes = (boxes - {a, hit}) | {(min(a[0], hit[0]), min(a[1], hit[1]), max(a[2], hit[2]), max(a[3], hit[3]))}
                break
        else:
            return sorted(boxes)


def test_merge_boxes_both_ways(spark):
    rng = random.Random(4)
    boxes = []
    for _ in range(40):
        y, x = rng.randrange(150), rng.randrange(150)
        boxes.append((y, x, y + rng.randrange(1, 14), x + rng.randrange(1, 14)))
    df = spark.createDataFrame([(1, *b) for b in boxes], "image_id long, y1 int, x1 int, y2 int, x2 int")
    for small in (1000, 5):
        got = R.merge_boxes(df, small_set=small)
        assert sorted((r.y1, r.x1, r.y2, r.x2) for r in got.collect()) == closure(boxes)


def thin_by_hand(label, max_iter):
    h, w = label.shape
    result = label.copy()
    order = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    for _ in range(max_iter):
        new = result.copy()
        for y in range(h):
            for x in range(w):
                if result[y, x] or not any(
                    0 <= y + dy < h and 0 <= x + dx < w and result[y + dy, x + dx] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))
                ):
                    continue
                for dy, dx in order:
                    ny, nx = y + dy, x + dx
                    low_ok = (dy >= 0 or ny > 0) and (dx >= 0 or nx > 0)
                    if low_ok and ny < h and nx < w and result[ny, nx]:
                        new[y, x] = result[ny, nx]
                        break
        if np.array_equal(new, result):
            break
        result = new
    return result


def test_thin_lines(spark):
    rng = np.random.default_rng(8)
    label = np.where(rng.random((19, 22)) < 0.8, 0, rng.integers(1, 5, (19, 22)))
    for rounds, limit in ((3, 100), (4, 2)):
        got = R.thin_lines(image(spark, label, "label"), max_iter=limit, rounds_per_pass=rounds, tile=8)
        assert np.array_equal(as_array(got, label.shape, "label"), thin_by_hand(label, limit))


def test_trapped_ball_closes_a_gap(spark):
    grid = np.full((15, 24), 255)
    grid[:, 11] = 0
    grid[7, 11] = 255  # a one pixel gap in the wall
    flooded = R.number_regions(R.label_regions(image(spark, grid).where("v = 255"), tile=8))
    assert flooded.select("label").distinct().count() == 1
    balls = as_array(SG.trapped_ball(image(spark, grid), 1, tile=8), grid.shape, "label")
    assert set(balls[:, :11].ravel()) - {0} == {1} and set(balls[:, 12:].ravel()) - {0} == {2}
    largest = as_array(SG.trapped_ball(image(spark, grid), 1, "max", tile=8), grid.shape, "label")
    assert set(largest.ravel()) == {0, 2}


def test_merge_small(spark):
    label = np.zeros((30, 30), int)
    label[:, :20] = 1
    label[3, 3] = 7  # one pixel inside of 1
    label[5:8, 22:25] = 9  # small, alone
    label[10:30, 21:30] = 4  # 180 pixels, alone: stays
    got = as_array(SG.merge_small(image(spark, label, "label"), min_seg_size=10, tile=16), label.shape, "label")
    want = label.copy()
    want[3, 3], want[5:8, 22:25] = 1, 0
    assert np.array_equal(got, want)


def test_compute_seg_gives_two_sides(spark):
    grid = np.full((20, 30), 255)
    grid[:, 14] = 0
    seg = as_array(SG.compute_seg(image(spark, grid), radii=(1,), min_seg_size=2, tile=16), grid.shape, "label")
    assert len(set(seg[:, 1:14].ravel())) == 1 and len(set(seg[:, 15:].ravel())) == 1 and len(set(seg.ravel())) == 2


def test_corner_of_an_angle(spark):
    grid = np.zeros((20, 20), int)
    grid[4, 4:15] = 1
    grid[4:15, 4] = 1
    points = {(r.kind, r.y, r.x) for r in X.keypoints(image(spark, grid), tile=9).collect()}
    # The pixels beside the corner see three neighbors, hence count as junctions.
    assert points == {("endpoint", 4, 14), ("endpoint", 14, 4), ("corner", 4, 4), ("junction", 4, 5), ("junction", 5, 4)}


def test_quantize_keeps_few_colors_and_maps_to_nearest(spark):
    rng = np.random.default_rng(1)
    px = [(1, int(r), int(g), int(b), 9) for r, g, b in rng.integers(0, 256, (60, 3))]
    df = spark.createDataFrame(px, "project_id long, r int, g int, b int, a int").withColumn("i", F.monotonically_increasing_id())
    out = {r.i: (r.r, r.g, r.b) for r in X.quantize_colors(df, 8).collect()}
    chosen = set(out.values())
    assert len(chosen) == 8
    for r in df.collect():
        d = lambda c: (c[0] - r.r) ** 2 + (c[1] - r.g) ** 2 + (c[2] - r.b) ** 2
        assert d(out[r.i]) == min(map(d, chosen))


def test_quantize_equals_choosing_one_by_one(spark, monkeypatch):
    """Few candidates a round, so that choices take many rounds; ties; fewer colors than wanted; a null project."""
    monkeypatch.setattr(X, "CANDIDATES", 9)
    rng = np.random.default_rng(5)
    projects = {1: rng.integers(0, 256, (150, 3)), 2: rng.integers(0, 4, (90, 3)) * 80, None: rng.integers(0, 3, (12, 3)), 4: np.full((5, 3), 7)}
    px = [(k, *map(int, c), i) for k, p in projects.items() for i, c in enumerate(p)]
    got = X.quantize_colors(spark.createDataFrame(px, "project_id long, r int, g int, b int, a int"), 40)
    got = sorted((-1 if r.project_id is None else r.project_id, r.a, r.r, r.g, r.b) for r in got.collect())
    want = []
    for k, p in projects.items():
        table, n = np.unique(p, axis=0, return_counts=True)
        chosen = [table[np.argmax(n)]]
        while len(chosen) < 40:
            gap = np.min([((table - c) ** 2).sum(1) for c in chosen], axis=0)
            if not gap.max():
                break
            chosen.append(table[np.argmax(gap)])
        near = np.argmin([((p - c) ** 2).sum(1) for c in chosen], axis=0)
        want += [(-1 if k is None else k, i, *map(int, chosen[j])) for i, j in enumerate(near)]
    assert got == sorted(want)


def test_blocked_matching_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = np.random.default_rng(0)
    ref, tgt = rng.normal(size=(11, 5)), rng.normal(size=(9, 5))
    colors = rng.integers(0, 3, 11)
    side = lambda m, c: spark.createDataFrame(
        [(1, i, int(c[i]), [float(z) for z in m[i]]) for i in range(len(m))], "pair_id long, seg_id int, color_id int, features array<float>"
    )
    unit = lambda m: (m - m.mean(1, keepdims=True)) / np.linalg.norm(m - m.mean(1, keepdims=True), axis=1, keepdims=True)
    sim = unit(tgt) @ unit(ref).T / 0.1
    w = np.exp(sim - sim.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    for r in M.color_votes(side(ref, colors), side(tgt, np.zeros(9))).collect():
        assert abs(r.vote - w[r.tgt_seg, colors == r.color_id].sum()) < 1e-5
    hidden = M.color_votes(side(ref, np.full(11, -100)), side(tgt, np.zeros(9))).collect()
    assert {(r.color_id, r.vote) for r in hidden} == {(0, 1.0)} and len(hidden) == 9


def test_top_matches_skip_far_blocks(spark, monkeypatch):
    """Clustered features: the k best of the full matrix from far fewer products; copies tie by id."""
    monkeypatch.setattr(TM, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16)) * 4
    ref = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in centers])
    ref[100:130] = ref[100]  # copies: one direction of many members
    tgt = np.concatenate([c + 0.2 * rng.normal(size=(5, 16)) for c in centers] + [ref[100:101]])
    side = lambda m, p: spark.createDataFrame(
        [(p, i, 0, [float(z) for z in row]) for i, row in enumerate(m)], "pair_id string, seg_id int, color_id int, features array<double>"
    )
    stats = {}
    got = TM.top_matches(side(ref, "a").unionByName(side(ref[:2], "b")), side(tgt, "a").unionByName(side(tgt[:3], "b")), 4, 1.0, stats)
    got = {(r.pair_id, r.tgt_seg, r["rank"]): (r.ref_seg, r.sim) for r in got.collect()}
    unit = lambda m: (m - m.mean(1, keepdims=True)) / np.linalg.norm(m - m.mean(1, keepdims=True), axis=1, keepdims=True)
    for pair, r, t in (("a", ref, tgt), ("b", ref[:2], tgt[:3])):
        sim = unit(t) @ unit(r).T
        for i in range(len(t)):
            order = np.lexsort((np.arange(len(r)), -np.round(sim[i], 9)))[:4]
            mine = [got[pair, i, n + 1] for n in range(len(order))]
            assert np.allclose([s for _, s in mine], sim[i][order], atol=1e-7)
            if not (pair == "a" and len(set(np.round(sim[i][order], 7))) < len(order)):
                assert [j for j, _ in mine] == order.tolist()
    assert len(got) == 4 * len(tgt) + 2 * 3 and stats["met"] < stats["all"] / 2


def test_pack_large_equals_small(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.randrange(0, 20)) for g in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "image_id long, item int, length int")
    key = lambda d: sorted(map(tuple, d.select("image_id", "item", "row_nr", "start", "end").collect()))
    want = key(Q.pack(df, 32))
    assert key(Q.pack(df, 32, small_group=10)) == want
    row, end = 0, 0
    for (_, item, n), got in zip([r for r in rows if r[0] == 1], want):
        if end + n > 32:
            row, end = row + 1, 0
        assert got[2:] == (row, end, end + n)
        end += n


def timeline(spark, refs, selected, images=None):
    rows = []
    for nr in sorted({*refs, *selected, *(images or {})}):
        rows.append((1, TL.COLOR, nr, (images or {}).get(nr, f"i{nr}"), nr in refs, nr in selected))
    return spark.createDataFrame(rows, "project_id long, layer string, frame_nr int, image_id string, is_original boolean, is_selected boolean")


def matched(df):
    return [(r.frame_nr, r.ref_left, r.ref_right, r.ref_closest) for r in TL.match_references(df).orderBy("frame_nr").collect()]


def test_reference_matching_cases(spark):
    assert matched(timeline(spark, [2, 15], [5])) == [(5, 2, None, 2)]
    assert matched(timeline(spark, [2, 7], [6])) == [(6, None, 7, 7)]
    assert matched(timeline(spark, [3, 7], [5])) == [(5, 3, None, 3)]
    assert matched(timeline(spark, [], [5])) == [(5, None, None, None)]
    # The left reference belongs to a hold 2..4: distance from 4, result 2.
    held = {2: "h", 3: "h", 4: "h"}
    assert matched(timeline(spark, [4, 8], [6], held)) == [(6, 2, None, 2)]


def test_hold_blocks_break_at_holes_and_ghosts(spark):
    ids = {0: "a", 1: "a", 3: "a", 4: None, 5: "b", 6: "b"}
    df = spark.createDataFrame(
        [(1, TL.LINE, k, v, False, False) for k, v in ids.items()],
        "project_id long, layer string, frame_nr int, image_id string, is_original boolean, is_selected boolean",
    )
    got = sorted((r.first_frame, r.last_frame, r.image_id) for r in TL.hold_blocks(df).collect())
    assert got == [(0, 1, "a"), (3, 3, "a"), (5, 6, "b")]


def test_votes_at_low_temperature_and_all_masked(spark):
    """Similarities of 1000 and references that are all masked."""
    from flatcel.operators import matching as M

    schema = "pair_id long, side string, seg_id int, features array<float>, color_id int"
    ref = spark.createDataFrame([(1, "ref", 0, [1.0, 0.0], 5), (1, "ref", 1, [0.6, 0.8], 6), (2, "ref", 0, [1.0, 0.0], -100), (2, "ref", 1, [0.0, 1.0], -100)], schema)
    tgt = spark.createDataFrame([(1, "tgt", 0, [-1.0, 0.0], 0), (2, "tgt", 0, [0.0, 1.0], 0)], schema)
    votes = {(r.pair_id, r.color_id): r.vote for r in M.color_votes(ref, tgt, 0.001).collect()}
    assert votes[1, 6] > 0.999 and votes[2, 0] == 1.0
    weights = {r.pair_id: r.weights for r in M.masked_softmax(M.similarity(ref, tgt, 0.001), 0.001).collect()}
    assert weights[1][1] > 0.999 and abs(sum(weights[2]) - 1) < 1e-9


def test_drawn_subsequences(spark):
    border = 65536
    rows = [("few", f) for f in (1, 9000, 10500, 30000)] + [("two", 5), ("two", 6), (None, 1), ("gap", None)]
    rows += [("many", f) for f in (3, 4, 4, 6, 9, border - 2, border - 1, border, border + 2, border + 3, 2 * border)]
    rows += [("less", f) for f in (-2, -1, 0, 1, 7)]
    frames = spark.createDataFrame(rows, "project_id string, frame_idx int")

    def tuples(name, n):
        own = sorted({f for p, f in rows if p == name})
        far = 10000 if len(own) < 5 else 3
        return [t for t in permutations(own, n) if max(t) - min(t) <= far]

    # With as many draws as there are tuples, every one comes exactly once.
    got = Q.draw_subsequences(frames, 3, 3, max_subseqs=10_000).collect()
    want = [(name, t) for name in ("few", "many", "less") for n in (1, 2, 3) for t in tuples(name, n)]
    assert sorted((r.project_id, tuple(r.frames)) for r in got) == sorted(want)
    assert sorted(r.draw for r in got if r.project_id == "few") == list(range(sum(p == "few" for p, _ in want)))
    # Fewer draws are distinct tuples, and the same ones each time; pairs of two frames repeat.
    some = [sorted((r.project_id, r.draw, tuple(r.frames)) for r in Q.draw_subsequences(frames, 2, 3, 7, 5).collect()) for _ in "ab"]
    assert some[0] == some[1]
    drawn = {p: [t for q, _, t in some[0] if q == p] for p in ("many", "two")}
    assert len(drawn["many"]) == len(set(drawn["many"])) == 7 and set(drawn["many"]) <= set(tuples("many", 2))
    assert len(drawn["two"]) == 5 and set(drawn["two"]) == {(5, 6), (6, 5)}
    assert Q.draw_subsequences(frames.where("false"), 3, 3, 5).count() == 0
    with pytest.raises(ValueError):
        Q.draw_subsequences(frames, 3, 3, 4, 5)


def test_draws_from_billions_of_tuples(spark):
    frames = spark.range(2000).selectExpr("id % 2 as project_id", "id * 3 as frame_idx")
    got = [tuple(r.frames) for r in Q.draw_subsequences(frames, 4, 600, 40, seed=3).collect()]
    # Nearly all tuples within a hundred frames have length four.
    assert len(got) == 80 and len(set(got)) == 80 and sum(len(t) == 4 for t in got) > 60
    assert all(len(set(t)) == len(t) and max(t) - min(t) <= 600 for t in got)
    smallest = sorted(min(t) for t in got)
    assert smallest[0] < 600 and smallest[-1] > 4800  # from all over the sequence


def test_manifest_tree(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def by_hand(files, depth):
        entries = Counter((sha(f or ""), sha(f"{f or ''}:{d or ''}")) for f, d in files)
        if depth is None:
            above = (len(entries) - 1) // 16
            depth = len(f"{above:x}") if above else 0
        level = {}
        for (name, entry), n in entries.items():
            level.setdefault(name[:depth], []).append((f"{entry}:{n}", n))
        level = {p: (sum(n for _, n in x), sha(",".join(sorted(e for e, _ in x)))) for p, x in level.items()}
        out = dict(level)
        for d in range(depth - 1, -1, -1):
            up = {}
            for p in sorted(level):
                up.setdefault(p[:d], []).append(p)
            level = {q: (sum(level[p][0] for p in ps), sha(",".join(p[-1] + level[p][1] for p in ps))) for q, ps in up.items()}
            out |= level
        return out

    sets = {
        "one": [("a", "1")],
        "sixteen": [(f"f{i}", "x") for i in range(16)],
        "more": [(f"f{i}", "x") for i in range(17)],
        "deep": [(f"g{i}", str(i % 7)) for i in range(300)] + [("g1", "1")] * 3 + [("g1", "2"), (None, "3"), ("g2", None)],
        None: [("a", "1"), ("b", "2")],
    }
    rows = [(k, f, d, "x", 1) for k, files in sets.items() for f, d in files]
    frame = lambda r: spark.createDataFrame(r, "platform string, file string, sha256 string, prefix string, files int")

    def tree(r, depth=None):
        return sorted((str(x.platform), x.prefix, x.files, x.digest) for x in A.manifest_tree(frame(r), depth=depth).collect())

    for depth in (None, 0, 2):
        want = sorted((str(k), p, n, d) for k, files in sets.items() for p, (n, d) in by_hand(files, depth).items())
        assert tree(rows, depth) == tree(rows[::-1], depth) == want
    assert tree([]) == []
    # One file changed, one gone, one set gone: only their ranges.
    new = [r if r[1] != "g5" else (*r[:2], "other", *r[3:]) for r in rows if r[1] != "g9" and r[0] != "one"]
    found = A.changed_ranges(A.manifest_tree(frame(rows), depth=2), A.manifest_tree(frame(new), depth=2))
    want = {("deep", sha("g5")[:2]), ("deep", sha("g9")[:2]), ("one", sha("a")[:2])}
    assert sorted((r.platform, r.prefix) for r in found.collect()) == sorted(want)
    same = A.changed_ranges(A.manifest_tree(frame(rows), depth=2), A.manifest_tree(frame(rows), depth=2))
    assert same.count() == 0


def test_rounded_keeps_the_sign_of_zero(spark):
    values = [-0.0000004, -0.0, 0.0, 0.0000004, -0.0000005, 1.2345675, -1.2345675, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(AR.rounded(F.col("v"), 6).alias("r")).collect()
    assert [str(r.r) for r in rows] == ["-0.0", "-0.0", "0.0", "0.0", "-1e-06", "1.234568", "-1.234568", "nan", "None"]


def test_pixel_grids_are_not_broadcast(spark):
    small = image(spark, [[1, 2], [3, 4]])
    boxes = spark.createDataFrame([(1, 1, 3, 1, 3, 4, 4)], "image_id long, top int, bottom int, left int, right int, h int, w int")
    out = X.uncrop(small, boxes)
    assert as_array(out, (4, 4), "v").tolist() == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_images_are_found_before_passes_multiply_frames(spark):
    from flatcel.operators import export as E

    frames = spark.createDataFrame(
        [(1, "colorLayer1", 1, "c", True, True)],
        "project_id long, layer string, frame_nr int, image_id string, is_original boolean, is_selected boolean",
    )
    settings = spark.createDataFrame([(1, True, True, True)], "project_id long, line_visible boolean, color_visible boolean, separated boolean")
    swatches = spark.createDataFrame([(1, 0), (1, 1)], "project_id long, pos int")
    plan = E.plan_export(frames, settings, swatches)
    assert sorted((r.frame_nr, r["pass"], r.color_id) for r in plan.collect()) == [(1, 0, "c"), (1, 1, "c")]
    joins = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "block" in joins[0]
