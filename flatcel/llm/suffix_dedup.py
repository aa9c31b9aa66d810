"""Suffix-array dedup: repeated byte strings found by a common-prefix-aware merge sort.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier. Sorting
the suffix of every byte would exchange the corpus many times over, so two steps decide
first which suffixes can repeat at all and share one suffix among neighbouring windows:

1. Every window of ``length`` bytes is owned by its anchor, the gram of least hash inside
   it (leftmost on a tie). Equal windows have equal anchors at equal offsets. Neighbouring
   windows share an anchor, so one record stands for some thirty windows; its context is
   the union of its windows. Records meet by anchor hash. Equal contexts leave their first
   place and lose the others; an anchor seen once is dropped; an anchor with unlike
   contexts goes on to the sort. Map tasks settle what they can among their own records
   before the exchange, so a passage that a third of all documents share arrives once per
   task.
2. The suffixes that start at these anchors are sorted in their map task, front-coded
   (bytes shared with the suffix before, then the rest) and exchanged as sorted runs. A
   loser tree merges the runs of a bucket; it carries common-prefix lengths and compares
   only behind them. A window that starts ``o`` bytes before its anchor repeats another
   one if their suffixes share ``length - o`` bytes and the bytes before the anchors agree
   ``o`` bytes back. The merge gives the first as runs of common-prefix lengths, a sort of
   the reversed bytes before the anchors the second. Of equal windows the first place
   stays, the others go.

A bucket holds the distinct contexts of its anchors, some 150 bytes each; nothing is
compared pair by pair.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from flatcel.session import cut_lineage

LENGTH = 100
# Bytes of the gram whose hash picks the anchor of a window.
GRAM = 36
_CHUNK = 4 << 20  # bytes hashed at once; positions in a chunk fit 23 bits
_TASK_RECORDS = 1_500_000  # records held by a map task before it sends them
_TASK_SUFFIXES = 300_000  # suffixes held by a map task before it sends runs
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULTI = 255  # marks an anchor that has unlike contexts within one task


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``gram`` consecutive bytes."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64, out=prefix[1:])
        back = np.full(n - gram + 1, _UNBASE, np.uint64)
        back[0] = 1
        h = (prefix[gram:] - prefix[:-gram]) * np.cumprod(back, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor, first window, last window) of each run of windows with one anchor.

    ``data`` holds several texts; ``ends`` gives for each byte where its text ends. Windows
    that cross a text's end do not count."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 23) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, m, have = length - gram + 1, key, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: n - length + 1], m[width - have : width - have + n - length + 1])
    at = (m & low).astype(np.int64)
    start = np.flatnonzero(np.arange(n - length + 1) + length <= ends[: n - length + 1])
    at = at[start]
    if not len(at):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    new = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(at) - 1]])
    return h[at[first]], at[first], start[first], start[last]


# Windows start at lo .. lo + n, their anchor at lo + skip.
RECORD = np.dtype(
    [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "u1"), ("skip", "u1")]
)
CANDIDATE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "u1"), ("skip", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4")])


def _pieces(doc: int, text: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc, offset, bytes) parts of at most a chunk that share length - 1 bytes, so that every
    window lies in exactly one of them."""
    step = _CHUNK - length + 1
    for offset in range(0, max(1, len(text) - length + 1), step):
        yield doc, offset, text[offset : offset + _CHUNK]


def _records(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> np.ndarray:
    joined = b"".join(p for _, _, p in pieces)
    sizes = np.array([len(p) for _, _, p in pieces])
    stops = np.cumsum(sizes)
    data = np.frombuffer(joined, np.uint8)
    g, at, lo, hi = anchors(data, np.repeat(stops, sizes), length, gram)
    out = np.empty(len(g), RECORD)
    owner = np.searchsorted(stops, lo, side="right")
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(joined)
    out["gram"] = g
    out["context"] = np.fromiter(
        (digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())), np.uint64, len(g)
    )
    out["doc"] = np.array([d for d, _, _ in pieces], np.int64)[owner]
    out["lo"] = lo - (stops - sizes)[owner] + np.array([o for _, o, _ in pieces])[owner]
    out["n"] = hi - lo
    out["skip"] = at - lo
    return out


def _settle(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order-sorted records, first of its context, anchor has unlike contexts) flags."""
    r = records[np.lexsort((records["lo"], records["doc"], records["context"], records["gram"]))]
    if not len(r):
        return r, np.zeros(0, bool), np.zeros(0, bool)
    new_gram = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
    new_context = new_gram | np.concatenate([[True], r["context"][1:] != r["context"][:-1]])
    group = np.cumsum(new_gram) - 1
    contexts = np.bincount(group, weights=new_context)
    return r, new_context, (contexts > 1)[group]


def _ranges(r: np.ndarray, extra: int) -> np.ndarray:
    out = np.empty(len(r), RANGE)
    out["doc"], out["lo"], out["hi"] = r["doc"], r["lo"], r["lo"].astype(np.int64) + r["n"] + extra
    return out


def merged(r: np.ndarray) -> np.ndarray:
    """Union of the ranges of each document, as sorted disjoint ranges."""
    if not len(r):
        return r
    r = r[np.lexsort((r["lo"], r["doc"]))]
    doc_no = np.cumsum(np.concatenate([[0], r["doc"][1:] != r["doc"][:-1]])).astype(np.int64)
    reach = np.maximum.accumulate((doc_no << 32) + r["hi"].astype(np.int64))
    start = (doc_no << 32) + r["lo"].astype(np.int64)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    out = r[first].copy()
    out["hi"] = (reach[np.concatenate([first[1:] - 1, [len(r) - 1]])] & 0xFFFFFFFF).astype(np.uint32)
    return out


def _pack(array: np.ndarray) -> bytes:
    """Column by column, compressed."""
    body = b"".join(np.ascontiguousarray(array[c]).tobytes() for c in array.dtype.names)
    return struct.pack("<I", len(array)) + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    body = zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=n * dtype.itemsize + 1)
    out, at = np.empty(n, dtype), 0
    for c in dtype.names:
        size = n * dtype[c].itemsize
        out[c] = np.frombuffer(body[at : at + size], dtype[c])
        at += size
    return out


def _candidates(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), CANDIDATE)
    for c in CANDIDATE.names:
        out[c] = r[c]
    return out


def _doc_rows(candidate: bool, rows: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
    """(doc, candidate, packed lo/hi pairs or candidates), one row per document."""
    if not len(rows):
        return
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    cut = np.flatnonzero(np.diff(rows["doc"])) + 1
    body = rows if candidate else np.stack([rows["lo"], rows["hi"]], axis=1).astype("<u4")
    for part, doc in zip(np.split(body, cut), rows["doc"][np.concatenate([[0], cut])].tolist()):
        yield doc, candidate, part.tobytes()


_RUN = StructType([StructField("bucket", IntegerType()), StructField("kind", IntegerType()), StructField("run", BinaryType())])
_SUFFIX_RUN = StructType([StructField("bucket", IntegerType()), StructField("run", BinaryType())])
_DOC_RANGES = StructType(
    [StructField("doc", LongType()), StructField("candidate", BooleanType()), StructField("pairs", BinaryType())]
)


def _rows(rows: Iterable[tuple], schema: StructType, size: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds = {
        IntegerType: pa.int32(), LongType: pa.int64(), BinaryType: pa.binary(), BooleanType: pa.bool_(), StringType: pa.string()
    }
    fields = [(f.name, kinds[type(f.dataType)]) for f in schema]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(fields)})

    held = 0
    for row in rows:
        out.append(row)
        held += max((len(x) for x in row if isinstance(x, bytes)), default=0)
        if len(out) >= size or held > 8 << 20:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _send_records(length: int, gram: int, buckets: int):
    """Map side of step 1: settle the task's own records, send one per context and anchor."""

    def flush(parts: list[np.ndarray]) -> Iterator[tuple]:
        r, first, unlike = _settle(np.concatenate(parts) if parts else np.zeros(0, RECORD))
        if not len(r):
            return
        again = np.concatenate([[False], r[1:] == r[:-1]])  # a repeated row of the same document
        gone = merged(_ranges(r[~first & ~again], length))
        some = _candidates(r[first & unlike])
        for candidate, x in ((0, gone), (1, some)):
            b = x["doc"] % buckets
            for k in np.unique(b):
                yield int(k), candidate, _pack(x[b == k])
        # An anchor with unlike contexts is settled by its suffixes; one mark tells the others.
        mark = first & unlike & np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
        send = r[(first & ~unlike) | mark]
        send["n"] = np.where(mark[(first & ~unlike) | mark], _MULTI, send["n"])
        b = (send["gram"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.diff(b[order])) + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(b[part[0]]), 2, _pack(send[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            pieces, size, parts, held = [], 0, [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    if len(data) < length:
                        continue
                    for piece in _pieces(doc, data, length):
                        if size + len(piece[2]) > _CHUNK and pieces:
                            parts.append(_records(pieces, length, gram))
                            held += len(parts[-1])
                            pieces, size = [], 0
                            if held > _TASK_RECORDS:
                                yield from flush(parts)
                                parts, held = [], 0
                        pieces.append(piece)
                        size += len(piece[2])
            if pieces:
                parts.append(_records(pieces, length, gram))
            yield from flush(parts)

        yield from _rows(rows(), _RUN)

    return run


def _meet_records(length: int):
    """Owner side of step 1: ranges that go and windows whose suffixes must be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            by_bucket: dict[int, list[np.ndarray]] = defaultdict(list)
            for batch in batches:
                for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 2:
                        by_bucket[bucket].append(_unpack(blob, RECORD))
                    else:
                        yield from _doc_rows(bool(kind), _unpack(blob, CANDIDATE if kind else RANGE))
            while by_bucket:
                _, parts = by_bucket.popitem()
                r, first, unlike = _settle(np.concatenate(parts))
                new = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
                group = np.cumsum(new) - 1
                marked = (np.bincount(group, weights=r["n"] == _MULTI) > 0)[group]
                own = r["n"] != _MULTI
                again = np.concatenate([[False], r[1:] == r[:-1]])
                # A mark may stand before the records of its context: the first own record stays.
                context = np.cumsum(new | first) - 1
                rank = np.cumsum(own) - 1
                lead = np.full(context[-1] + 1, len(r), np.int64)
                np.minimum.at(lead, context[own], rank[own])
                keeps = own & (rank == lead[context])
                yield from _doc_rows(False, merged(_ranges(r[own & ~keeps & ~again], length)))
                yield from _doc_rows(True, _candidates(r[keeps & (unlike | marked)]))

        yield from _rows(rows(), _DOC_RANGES)

    return run


# ---------------------------------------------------------------- suffix runs


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first ``at`` bytes."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    high = n
    while high - at > 1:
        middle = (at + high) // 2
        if a[at:middle] == b[at:middle]:
            at = middle
        else:
            high = middle
    return at


_HEAD = struct.Struct("<HHBqIBB")


def front_coded(suffixes: list[tuple[bytes, int, int, int, int, bytes]]) -> bytes:
    """A sorted run of (suffix, document, first window, n, skip, reversed bytes before): each entry
    holds the number of bytes shared with the suffix before and the rest of it."""
    out, before = bytearray(), b""
    for text, doc, lo, n, skip, back in suffixes:
        k = shared(before, text)
        out += _HEAD.pack(k, len(text) - k, len(back), doc, lo, n, skip)
        out += text[k:]
        out += back
        before = text
    return bytes(out)


def decoded(run: bytes) -> Iterator[tuple]:
    """(shared bytes, suffix, document, first window, n, skip, reversed bytes before) in order."""
    at, before = 0, b""
    while at < len(run):
        k, rest, back, doc, lo, n, skip = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        before = before[:k] + run[at : at + rest]
        at += rest
        yield k, before, doc, lo, n, skip, run[at : at + back]
        at += back


class LoserTree:
    """Merges sorted runs of (shared bytes, suffix, ..).

    Every player knows how many bytes it shares with the suffix last taken. Of two players
    the one that shares more is smaller; only if both share equally many are they compared,
    from there on, and the loser keeps what it shares with the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.head: list[tuple | None] = [next(r, None) for r in runs]
        self.common = [0] * self.size
        self.losers = [-1] * self.size
        self.winner = self._build(1) if runs else -1

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.common[a] != self.common[b]:
            return (a, b) if self.common[a] > self.common[b] else (b, a)
        n = shared(x[1], y[1], self.common[a])
        if x[1][n:] <= y[1][n:]:
            self.common[b] = n
            return a, b
        self.common[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        """(bytes shared with the suffix before, suffix, ..) in order."""
        while self.winner >= 0 and self.head[self.winner] is not None:
            w = self.winner
            yield self.common[w], *self.head[w][1:]
            self.head[w] = next(self.runs[w], None)
            if self.head[w] is not None:
                self.common[w] = self.head[w][0]
            node = (w + self.size) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def repeated_windows(merged_run: Iterable[tuple], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every window of the merged suffixes that also starts earlier."""
    common, docs, lows, ns, skips, backs = [], [], [], [], [], []
    for k, _, doc, lo, n, skip, back in merged_run:
        common.append(k)
        docs.append(doc)
        lows.append(lo)
        ns.append(n)
        skips.append(skip)
        backs.append(back)
    size = len(common)
    if size < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    right = np.array(common)
    right[0] = -1
    group = np.cumsum(right < gram)
    doc, lo = np.array(docs, np.int64), np.array(lows, np.int64)
    n, skip = np.array(ns, np.int64), np.array(skips, np.int64)
    by_back = sorted(range(size), key=lambda i: (group[i], backs[i]))
    left = np.array(
        [-1]
        + [shared(backs[a], backs[b]) if group[a] == group[b] else -1 for a, b in zip(by_back, by_back[1:])]
    )
    by_back = np.array(by_back)
    anchor = lo + skip
    order = np.lexsort((anchor, doc))
    again = np.zeros(size, bool)  # a repeated row of the same document
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
    order = order[~again[order]]
    gone_doc, gone_at = [], []
    back_class = np.empty(size, np.int64)
    for o in range(length - gram + 1):
        here = order[(skip[order] >= o) & (skip[order] - n[order] <= o)]
        if len(here) < 2:
            continue
        back_class[by_back] = np.cumsum(left < o)
        key = np.cumsum(right < length - o)[here] * (size + 1) + back_class[here]
        sort = np.argsort(key, kind="stable")  # keeps the order of places
        later = here[sort[1:][key[sort[1:]] == key[sort[:-1]]]]
        gone_doc.append(doc[later])
        gone_at.append(anchor[later] - o)
    if not gone_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(gone_doc), np.concatenate(gone_at)


def _send_suffixes(length: int, buckets: int):
    """Map side of step 2: sorted, front-coded runs of the suffixes at candidate anchors."""

    def flush(held: dict[int, list]) -> Iterator[tuple]:
        for bucket, run in held.items():
            run.sort()
            yield bucket, zstandard.ZstdCompressor(level=1).compress(front_coded(run))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[int, list] = defaultdict(list)
            n_held = 0
            for batch in batches:
                for doc, text, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    for blob in packed:
                        for g, _, lo, n, skip in np.frombuffer(blob, CANDIDATE).tolist():
                            at = lo + skip
                            held[g % buckets].append((data[at : lo + n + length], doc, lo, n, skip, data[lo:at][::-1]))
                            n_held += 1
                    if n_held > _TASK_SUFFIXES:
                        yield from flush(held)
                        held, n_held = defaultdict(list), 0
            yield from flush(held)

        yield from _rows(rows(), _SUFFIX_RUN)

    return run


def _merge_suffixes(length: int, gram: int):
    """Owner side of step 2: starts of windows that go, as packed [lo, hi) pairs of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            runs: dict[int, list[bytes]] = defaultdict(list)
            for batch in batches:
                for bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    runs[bucket].append(blob)
            while runs:
                _, blobs = runs.popitem()
                texts = [zstandard.ZstdDecompressor().decompressobj().decompress(b) for b in blobs]
                doc, at = repeated_windows(LoserTree([decoded(t) for t in texts]), length, gram)
                order = np.argsort(doc, kind="stable")
                cut = np.flatnonzero(np.diff(doc[order])) + 1
                for part in np.split(order, cut):
                    if len(part):
                        yield int(doc[part[0]]), False, _single(at[part])

        yield from _rows(rows(), _DOC_RANGES)

    return run


def _single(starts: np.ndarray) -> bytes:
    """Window starts as lo/hi pairs, runs of consecutive starts joined."""
    starts = np.unique(starts.astype(np.int64))
    cut = np.flatnonzero(np.diff(starts) > 1)
    lo = starts[np.concatenate([[0], cut + 1])]
    hi = starts[np.concatenate([cut, [len(starts) - 1]])] + 1
    return np.stack([lo, hi], axis=1).astype("<u4").tobytes()


def union(blobs: list[bytes] | None, extra: int = 0) -> list[list[int]]:
    """Sorted disjoint [lo, hi) of packed pairs, each lengthened by ``extra``; ranges that touch
    are one."""
    if not blobs:
        return []
    pairs = np.concatenate([np.frombuffer(b, "<u4").reshape(-1, 2) for b in blobs]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1] + extra)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    stop = reach[np.concatenate([first[1:] - 1, [len(pairs) - 1]])]
    return np.stack([pairs[first, 0], stop], axis=1).tolist()


# ---------------------------------------------------------------- operator


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc long, id, text): ``doc`` orders documents as their ids do, null last.

    Unique long ids are used as they are. Otherwise every distinct (id, text hash) gets a
    number in sorted order, so rows that share an id but not the text stay apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    k = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = rows.select("id", k.alias("k")).distinct()
    if isinstance(rows.schema["id"].dataType, (LongType, IntegerType)):
        shared_ids = keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
        if shared_ids.isEmpty():
            return rows.select(F.col("id").cast("long").alias("doc"), "id", "text")
    numbered = cut_lineage(
        keys.orderBy(F.col("id").asc_nulls_last(), "k").select(
            F.monotonically_increasing_id().alias("doc"), F.col("id").alias("id2"), F.col("k").alias("k2")
        )
    )
    return rows.join(numbered, F.col("id").eqNullSafe(F.col("id2")) & (k == F.col("k2"))).select("doc", "id", "text")


def repeated_ranges(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, pairs): per document packed [lo, hi) ranges of bytes to remove, in several rows."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("doc", "text")
    records = texts.mapInArrow(_send_records(length, gram, buckets), _RUN)
    met = cut_lineage(records.repartition(buckets, "bucket").mapInArrow(_meet_records(length), _DOC_RANGES))
    windows = met.where("candidate").groupBy("doc").agg(F.collect_list("pairs").alias("pairs"))
    suffixes = (
        texts.join(windows, "doc")
        .select("doc", "text", "pairs")
        .mapInArrow(_send_suffixes(length, buckets), _SUFFIX_RUN)
        .repartition(buckets, "bucket")
        .mapInArrow(_merge_suffixes(length, gram), _DOC_RANGES)
    )
    gone = cut_lineage(suffixes)
    longer = F.lit(length - 1)
    return (
        met.where("not candidate")
        .select("doc", "pairs", F.lit(0).alias("extra"))
        .unionByName(gone.select("doc", "pairs", longer.alias("extra")))
    )


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Removed is each byte covered by a ``length``-byte string that also starts earlier: in
    a smaller id, or earlier in the same text; strings are judged on the input. ``kept``
    holds the remaining bytes. Null counts as empty; texts shorter than ``length`` lose
    nothing; null ids come last; rows that repeat id and text are one document and get
    equal results, rows that share an id only are ordered by a hash of the text. Other
    columns are not looked at; an empty table gives an empty result.
    """
    rows = _ordered(docs, id_col, text_col)
    ranges = repeated_ranges(rows, length, gram)
    per_doc = ranges.groupBy("doc").agg(
        F.collect_list(F.when(F.col("extra") == 0, F.col("pairs"))).alias("whole"),
        F.collect_list(F.when(F.col("extra") > 0, F.col("pairs"))).alias("windows"),
    )
    joined = rows.join(per_doc.withColumnRenamed("doc", "doc2"), F.col("doc") == F.col("doc2"), "left").select(
        "id", "text", "whole", "windows"
    )
    extra = length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _finish(batch, extra)

    out = StructType(
        [
            joined.schema["id"],
            *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
            StructField("kept_sha256", StringType()),
            StructField("kept", BinaryType()),
        ]
    )
    return joined.mapInArrow(run, out).withColumnRenamed("id", id_col)


def _finish(batch: pa.RecordBatch, extra: int) -> Iterator[pa.RecordBatch]:
    n_bytes, n_removed, n_spans, digest, texts = [], [], [], [], []
    for text, whole, windows in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
        data = (text or "").encode("utf-8", "surrogatepass")
        spans = union(
            [np.array(x, "<u4").tobytes() for x in (union(whole), union(windows, extra)) if x]
        )
        kept, at = [], 0
        for lo, hi in spans:
            kept.append(data[at:lo])
            at = hi
        kept.append(data[at:])
        rest = b"".join(kept)
        n_bytes.append(len(data))
        n_removed.append(len(data) - len(rest))
        n_spans.append(len(spans))
        digest.append(hashlib.sha256(rest).hexdigest())
        texts.append(rest)
    yield pa.record_batch(
        {
            "id": batch.column(0),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
            "kept": pa.array(texts, pa.binary()),
        }
    )
