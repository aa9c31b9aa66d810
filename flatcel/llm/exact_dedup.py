"""Exact dedup by Patricia-trie owners.

Every text, reduced to the bytes that count, is inserted as a full byte string into
a compressed radix trie; the terminal node of a text stores its owner (the row that
stays) and the number of rows seen. Map tasks build a trie of their own rows first
and send one row per distinct text to the partition of its (length, content hash),
so a text that a third of all rows share arrives once per map task. A trie above its
memory limit spills whole subtrees: in map tasks downstream (the owner task merges
them), in owner tasks as finished results, since rows arrive ordered by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

# Deleted before texts are compared.
WHITESPACE = b" \t\n\x0b\x0c\r"
# Bytes of labels and nodes that one trie may hold.
TRIE_BYTES = 48 << 20
_NODE_BYTES = 200


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] | None = None
        self.owner: tuple | None = None


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """Number of bytes that ``label`` and ``key[at:]`` share."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    step = 8
    while step < high and key.startswith(label[:step], at):
        low, step = step, step * 2
    high = min(high, step)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie of byte strings whose terminal nodes hold owners."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.root.kids = {}
        self.bytes = 0
        self.branch_bytes: dict[int, int] = {}

    def terminal(self, key: bytes) -> Node:
        """The node that ends ``key``, made if it is not there yet."""
        node, at = self.root, 0
        while at < len(key):
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.kids[key[at]] = kid
                self._grow(key, len(key) - at + _NODE_BYTES)
                return kid
            n = shared_prefix(kid.label, key, at)
            if n < len(kid.label):
                upper = Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids = {kid.label[0]: kid}
                node.kids[key[at]] = upper
                self._grow(key, _NODE_BYTES)
                kid = upper
            node, at = kid, at + n
        return node

    def _grow(self, key: bytes, n: int) -> None:
        self.bytes += n
        self.branch_bytes[key[0]] = self.branch_bytes.get(key[0], 0) + n

    def pop_all(self) -> Iterator[tuple[bytes, tuple]]:
        """All (text, owner) pairs; the trie is empty afterwards."""
        if self.root.owner is not None:
            yield b"", self.root.owner
            self.root.owner = None
        yield from self.pop_subtrees(0)

    def pop_subtrees(self, keep_bytes: int) -> Iterator[tuple[bytes, tuple]]:
        """Remove the heaviest subtrees until at most ``keep_bytes`` are held."""
        for first in sorted(self.branch_bytes, key=self.branch_bytes.get, reverse=True):
            if self.bytes <= keep_bytes:
                return
            self.bytes -= self.branch_bytes.pop(first)
            stack = [(b"", self.root.kids.pop(first))]
            while stack:
                prefix, node = stack.pop()
                text = prefix + node.label
                if node.owner is not None:
                    yield text, node.owner
                if node.kids:
                    stack.extend((text, kid) for kid in node.kids.values())


def better(a: tuple, b: tuple | None) -> tuple:
    """Owner of two claims (n_chars, id, rows): longest original, then smallest id, ids before
    null; the rows add up."""
    if b is None:
        return a
    first = a if (-a[0], a[1] is None, a[1]) < (-b[0], b[1] is None, b[1]) else b
    if a[0] == b[0] and a[1] is None and b[1] is None:
        first = a
    return first[0], first[1], a[2] + b[2]


def _claim(node: Node, claim: tuple) -> None:
    if node.owner is None:
        node.owner = claim
    elif claim[0] == node.owner[0] and claim[1] == node.owner[1]:
        node.owner = (claim[0], claim[1], claim[2] + node.owner[2])
    else:
        node.owner = better(claim, node.owner)


def normalised(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(None, WHITESPACE)


def _batch(rows: list[tuple[bytes, tuple]], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "n_bytes": pa.array([len(t) for t, _ in rows], pa.int64()),
            "text_hash": pa.array([hashlib.sha256(t).digest() for t, _ in rows], pa.binary()),
            "content": pa.array([t for t, _ in rows], pa.binary()),
            "keep_chars": pa.array([o[0] for _, o in rows], pa.int64()),
            "keep_id": pa.array([o[1] for _, o in rows], id_type),
            "group_size": pa.array([o[2] for _, o in rows], pa.int64()),
        }
    )


def _batches(rows: Iterable[tuple[bytes, tuple]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[0])
        if len(out) >= 5000 or held >= 8 << 20:
            yield _batch(out, id_type)
            out, held = [], 0
    if out:
        yield _batch(out, id_type)


def _local_owners(trie_bytes: int):
    """Map side: one row per distinct text of the task (more if the trie spills)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = PatriciaTrie(), pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chars):
                _claim(trie.terminal(normalised(text)), (n, key, 1))
                if trie.bytes > trie_bytes:
                    yield from _batches(trie.pop_subtrees(trie_bytes // 2), id_type)
        yield from _batches(trie.pop_all(), id_type)

    return run


def _final_owners(trie_bytes: int):
    """Owner side: rows come ordered by (length, hash), so above the limit every subtree
    but that of the current key is finished and leaves the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type, last = PatriciaTrie(), pa.int64(), None

        def finished(rows):
            for b in _batches(rows, id_type):
                yield b.select(["n_bytes", "text_hash", "keep_chars", "keep_id", "group_size"])

        for batch in batches:
            id_type = batch.column(4).type
            for n, digest, text, chars, key, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if (n, digest) != last and trie.bytes > trie_bytes:
                    yield from finished(trie.pop_all())
                last = (n, digest)
                _claim(trie.terminal(text), (chars, key, rows))
        yield from finished(trie.pop_all())

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "n_chars": pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "text_hash": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            }
        )


def text_owners(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per distinct text: n_bytes, text_hash, keep_chars, keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = [StructField("n_bytes", LongType()), StructField("text_hash", BinaryType())]
    owner = [
        StructField("keep_chars", LongType()),
        StructField("keep_id", rows.schema["id"].dataType),
        StructField("group_size", LongType()),
    ]
    local = rows.mapInArrow(
        _local_owners(trie_bytes), StructType([*key, StructField("content", BinaryType()), *owner])
    )
    return (
        local.repartition("n_bytes", "text_hash")
        .sortWithinPartitions("n_bytes", "text_hash")
        .mapInArrow(_final_owners(trie_bytes), StructType([*key, *owner]))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when identical without ASCII whitespace; null is the empty text.
    The row with the most code points stays, then the smallest id; a null id loses to
    every other (if all ids are null, keep_id is null and the longest rows stay).
    Rows that repeat id and text count in group_size and are marked alike. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.mapInArrow(
        _keys,
        StructType(
            [
                rows.schema["id"],
                StructField("n_chars", LongType()),
                StructField("n_bytes", LongType()),
                StructField("text_hash", BinaryType()),
            ]
        ),
    )
    owners = text_owners(docs, id_col, text_col, trie_bytes)
    return keyed.join(owners, ["n_bytes", "text_hash"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("text_hash")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, once each.

    Of rows that repeat id and text, the one whose other columns are smallest in their order
    (nulls first) stays; these must be of types that sort. Null texts count as empty in
    comparisons and stay null; an empty table gives an empty result."""
    owners = text_owners(docs, id_col, text_col).select(
        F.col("text_hash").alias("__hash"), F.col("keep_id").alias("__kept"), F.col("keep_chars").alias("__chars")
    )
    text = F.coalesce(text_col, F.lit(""))
    # The bytes that count, as in normalised().
    digest = F.unhex(F.sha2(F.translate(text, WHITESPACE.decode(), "").cast("binary"), 256))
    owned = (
        (digest == F.col("__hash"))
        & F.col(id_col).eqNullSafe(F.col("__kept"))
        & (F.char_length(text) == F.col("__chars"))
    )
    stay = docs.join(owners, owned, "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if not others:
        return stay.distinct()
    least = stay.groupBy(id_col, text_col).agg(F.min(F.struct(*others)).alias("__least"))
    return least.select(
        *[F.col(c) if c in (id_col, text_col) else F.col("__least")[c].alias(c) for c in docs.columns]
    )
