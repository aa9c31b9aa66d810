"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of word shingles. The bits are cut into blocks and
every table masks out a different choice of ``radius`` blocks: two fingerprints that
differ in at most ``radius`` bits touch at most ``radius`` blocks, so at least one
table masks all the differing bits and both fall into the same bucket there. With
six blocks (15 tables) a bucket key keeps 42 bits or more.

Inside a bucket no pairs are listed. Members agree on the kept bits, so within the
masked bits each member claims itself and its one-bit neighbours as centres: two
fingerprints are at most two bits apart exactly if they share a centre. All claimants of one centre (at most 65) are
linked to the smallest of them. Work grows with the number of distinct fingerprints,
whatever the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flatcel.llm.components import linked_components
from flatcel.session import cut_lineage, drop_written

SHINGLE_WORDS = 3
BLOCKS = 6
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` (64 bits each) have, as an unsigned number; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):  # bounds the bit matrix of very long texts
        block = hashes[start : start + (1 << 15)]
        bits = np.unpackbits(block.astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of ``text`` as an unsigned 64-bit number; 0 without words."""
    parts = b"" if text is None else text.encode("utf-8", "surrogatepass")
    parts = parts.lower().split()  # bytes: A-Z only, ASCII whitespace only
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    n = max(1, len(parts) - words + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, fp) per row; fp is the signed form of the 64-bit fingerprint."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("fp", LongType())]))


def covering_tables(radius: int = 2, blocks: int = BLOCKS) -> list[list[int]]:
    """The masked-out bit positions of each table."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [
        [b for block in chosen for b in range(edges[block], edges[block + 1])]
        for chosen in combinations(range(blocks), radius)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(distinct: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp, unique) so that two
    fingerprints are connected iff a chain of steps of at most 2 bits joins them."""
    tables = covering_tables(2, blocks)
    kept = [_signed(((1 << 64) - 1) ^ sum(1 << b for b in masked)) for masked in tables]
    flips = [[0, *(_signed(1 << b) for b in masked)] for masked in tables]
    buckets = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                    for t, m in enumerate(kept)
                ]
            )
        ).alias("b"),
    ).select("fp", "b.t", "b.key")
    crowded = buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = buckets.join(crowded, ["t", "key"], "left_semi")
    flips_of = F.array(*[F.array(*[F.lit(x) for x in f]) for f in flips])
    centres = (
        members.select("fp", F.explode(F.element_at(flips_of, F.col("t") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .distinct()
    )
    # A centre has at most 65 claimants: itself and its 64 one-bit neighbours.
    least = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return centres.join(least, "centre").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def covered_links(distinct: DataFrame, radius: int, blocks: int, apart: int) -> DataFrame:
    """Links (a, b), a < b, between fingerprints of ``distinct`` (fp, unique) that share a bucket of the
    covering tables and differ in at most ``apart`` bits, written. Any two that differ in at most
    ``radius`` bits share a bucket; others may. The members of a bucket are linked to its least one
    only, so a table gives fewer links than there are fingerprints."""
    masked = covering_tables(radius, blocks)
    kept = [F.lit(_signed(((1 << 64) - 1) ^ sum(1 << b for b in bits))) for bits in masked]
    buckets = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(mask) for mask in kept])).alias("t", "key")
    )
    shared = (
        buckets.groupBy("t", "key")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    shared = cut_lineage(shared)
    larger = shared.where("n > 2").select("t", "key", "a", F.col("b").alias("last"))
    between = buckets.join(larger, ["t", "key"]).where("fp <> a and fp <> last").select("a", F.col("fp").alias("b"))
    links = shared.select("a", "b").unionByName(between)
    out = cut_lineage(links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart).distinct())
    drop_written(shared)
    return out


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints at most 2 bits apart are linked, component_id is the smallest id
    reachable (null only if all ids of the component are null). Null and wordless
    texts have fingerprint zero and link like any other; a text of fewer words than a
    shingle is one shingle. Repeated rows get equal results. Other columns are not
    looked at. An empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    owners = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = linked_components(near_links(owners.select("fp"), blocks))
    classes = owners.join(roots, owners["fp"] == roots["node"], "left").select(
        owners["fp"], "first_id", F.coalesce("root", owners["fp"]).alias("root")
    )
    firsts = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = classes.join(firsts, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group (that of component_id), with all columns.

    Rows without an id stay: they have no place in the order that picks the winner.
    Repeated rows of the winner stay as they are."""
    found = near_dedup(docs, id_col, text_col)
    out = (
        found.where(F.col(id_col) != F.col("component_id"))
        .select(F.col(id_col).alias("__out"))
        .distinct()
    )
    return docs.join(out, F.col(id_col) == F.col("__out"), "left_anti")
