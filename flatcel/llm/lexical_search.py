"""Ranked lexical search by per-term geometric blocking.

The index holds, for every term that can lead to a result, the documents of its posting list in
blocks of similar documents, and for every block the greatest impact of each coordinate (term) the
queries use beside this term. A query visits a block only if the sum over these summaries reaches
the query's threshold: a document in a skipped block scores no more than the sum. Thresholds are
exact scores of real documents (the k-th best of a few that hold a query's weightiest terms), and
only blocks strictly below are skipped, so the result is that of scoring everything.

Documents are dealt by their direction in term space into chunks of bounded size, similar ones
together; a chunk is the unit of index building and of scoring, so no task holds a posting list. A
direction that many copies share is split over chunks. Common words, whose greatest contributions
together stay below a query's threshold, are no entry points of that query: what holds nothing else
cannot be a result. All scores are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from flatcel.session import cut_lineage, drop_written

TOP_K = 10
BLOCK = 16  # documents a block aims at
CHUNK_CELLS = 1 << 20  # postings a chunk aims at
SLICE_TERMS = 1 << 18  # distinct query terms handled in one go; more take several slices
SEED_TERMS, SEED_DOCS = 4, 32  # where a query's threshold comes from
PLANES = 16  # directions that tell documents apart

# Everything but 0-9, A-Z, a-z and non-ASCII separates words; A-Z become a-z.
_FOLD = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 0x20 * (0x41 <= b <= 0x5A) for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_FOLD).split(b" ") if w]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """One slice of queries. Query ``q`` has the terms ``cols[starts[q]:starts[q + 1]]``, sorted, with
    their ``repeats``; ``weights`` are filled in once the documents are counted."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    cols: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray | None = None

    def terms(self, q: int) -> np.ndarray:
        return self.cols[self.starts[q] : self.starts[q + 1]]

    def gains(self, q: int) -> np.ndarray:
        """Repeats times weight, in the order of ``terms``."""
        return self.repeats[self.starts[q] : self.starts[q + 1]] * self.weights[self.terms(q)]

    def columns(self, queries: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.terms(q) for q in queries]))

    def matrix(self, queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Gains of ``queries``, a column each, at ``columns`` (sorted, holding all their terms)."""
        out = np.zeros((len(columns), len(queries)), "int64")
        for k, q in enumerate(queries):
            out[np.searchsorted(columns, self.terms(q)), k] = self.gains(q)
        return out


def _slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    """The queries in slices of bounded vocabulary, in the order they are read."""
    ids, counts, size = [], [], 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        own = Counter(terms_of(bytes(r.t)))
        if not own:
            continue
        if ids and size + len(own) > SLICE_TERMS:
            yield _numbered(ids, counts)
            ids, counts, size = [], [], 0
        ids.append(r.i)
        counts.append(own)
        size += len(own)
    if ids:
        yield _numbered(ids, counts)


def _numbered(ids: list, counts: list[Counter]) -> Queries:
    vocabulary = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
    cells = [sorted((vocabulary[t], n) for t, n in c.items()) for c in counts]
    cols, repeats = np.array([cell for own in cells for cell in own], dtype="int64").T
    return Queries(ids, vocabulary, np.cumsum([0, *map(len, cells)]), cols, repeats)


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document its number of terms and, of the query terms, (term, tf) as two arrays; ``sig`` is
    its direction: on which side of some random planes its terms lie."""
    id_name = docs.schema[id_col].dataType.simpleString()
    planes = _planes(len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(PLANES)
        for batch in batches:
            lengths, sigs, ends, terms, tfs = [], [], [0], [], []
            for value in batch.column("t"):
                raw = value.as_buffer()
                words = terms_of(raw.to_pybytes()) if raw is not None else []
                own = sorted((vocabulary[t], n) for t, n in Counter(words).items() if t in vocabulary)
                lengths.append(len(words))
                terms += [t for t, _ in own]
                tfs += [n for _, n in own]
                ends.append(len(terms))
                at = terms[ends[-2] :]
                sigs.append(int(powers[planes[at].sum(axis=0) > 0].sum()) if at else 0)
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(lengths, pa.int64()), pa.array(sigs, pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                names=["id", "n", "sig", "terms", "tfs"],
            )

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return text.mapInArrow(count, f"id {id_name}, n long, sig int, terms array<int>, tfs array<long>")


class Chunk:
    """The documents of one chunk: cells (term, impact) in the order of documents. A document's
    impact of a term is what one occurrence of the term in a query adds for weight 1."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("pos").combine_chunks()
        lists = table.column("terms").combine_chunks()
        self.ids = table.column("id").combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        self.term = lists.flatten().to_numpy().astype("int64")
        self.impact = table.column("impacts").combine_chunks().flatten().to_numpy().astype("int64")

    def cells_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells of ``docs``, and where each document's cells begin among them."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        heads = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.starts[docs] - heads, sizes), heads

    def scores(self, docs: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs``; ``gain`` holds the query's gain of every term."""
        cells, heads = self.cells_of(docs)
        return np.add.reduceat(self.impact[cells] * gain[self.term[cells]], heads)


def _clusters(points: np.ndarray) -> np.ndarray:
    """Cluster of each point: evenly spaced points are centers, each goes to the nearest by angle."""
    k = -(-len(points) // BLOCK)
    if k == 1:
        return np.zeros(len(points), int)
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-30)
    centers = unit[:: -(-len(points) // k)]
    out = np.empty(len(points), int)
    step = max(1, CHUNK_CELLS // len(centers))
    for at in range(0, len(unit), step):
        out[at : at + step] = (unit[at : at + step] @ centers.T).argmax(axis=1)
    return out


def _blocks(chunk: Chunk, queries: Queries, entries: dict[int, np.ndarray]) -> Iterator[tuple]:
    """(term, documents, coordinates, greatest impacts) of the blocks of each entry term's posting list.
    ``entries``: term -> queries it leads to; only coordinates of these queries are summarized."""
    doc = np.repeat(np.arange(len(chunk.starts) - 1), np.diff(chunk.starts))
    planes = _planes(len(queries.weights))
    force = planes[chunk.term] * (chunk.impact * queries.weights[chunk.term])[:, None].astype(float)
    points = np.add.reduceat(force, chunk.starts[:-1])
    order = np.argsort(chunk.term, kind="stable")
    terms, first = np.unique(chunk.term[order], return_index=True)
    slot = np.full(len(queries.weights), -1)
    for term, members in zip(terms.tolist(), np.split(doc[order], first[1:])):
        if term not in entries:
            continue
        columns = queries.columns(entries[term])
        slot[columns] = np.arange(len(columns))
        cluster = _clusters(points[members])
        by = np.argsort(cluster, kind="stable")
        heads = np.nonzero(np.diff(cluster[by], prepend=-1))[0]
        for docs in np.split(members[by], heads[1:]):
            cells, _ = chunk.cells_of(docs)
            at = slot[chunk.term[cells]]
            most = np.zeros(len(columns), "int64")
            np.maximum.at(most, at[at >= 0], chunk.impact[cells[at >= 0]])
            seen = np.nonzero(most)[0]
            yield term, docs, columns[seen], most[seen]
        slot[columns] = -1


def _planes(terms: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((terms, PLANES))


INDEX = "chunk int, term int, docs array<int>, coords array<int>, most array<int>"
VISITS = "at int, docs array<int>, queries array<int>"


def build_index(chunks: DataFrame, queries: Queries, entries: dict[int, np.ndarray]) -> DataFrame:
    """One row per block of an entry term's posting list (see ``_blocks``), chunk by chunk."""

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(*_blocks(Chunk(table), queries, entries)))
        names = [f.split()[0] for f in INDEX.split(", ")]
        if not rows:
            return pa.table({n: pa.array([], pa.int32() if n in names[:2] else pa.list_(pa.int32())) for n in names})
        lists = [pa.array([a.astype("int32") for a in column], pa.list_(pa.int32())) for column in rows[1:]]
        chunk = pa.array(np.full(len(rows[0]), table.column("chunk")[0].as_py(), "int32"))
        return pa.table(dict(zip(names, [chunk, pa.array(rows[0], pa.int32()), *lists])))

    return chunks.groupBy("chunk").applyInArrow(build, INDEX)


def visits(index: DataFrame, queries: Queries, entries: dict[int, np.ndarray], limits: np.ndarray) -> DataFrame:
    """Blocks whose summary bound reaches the limit of a query, with these queries."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hit, queried = batch.column("docs"), [], []
            coords, most = batch.column("coords"), batch.column("most")
            ends, starts = coords.offsets.to_numpy()[1:], coords.offsets.to_numpy()[:-1]
            flat, value = coords.values.to_numpy(), most.values.to_numpy().astype("int64")
            term = batch.column("term").to_numpy()
            order = np.argsort(term, kind="stable")
            terms, first = np.unique(term[order], return_index=True)
            for t, blocks in zip(terms.tolist(), np.split(order, first[1:])):
                led = entries[t]
                columns = queries.columns(led)
                gains = queries.matrix(led, columns)
                for b in blocks.tolist():
                    cells = slice(starts[b], ends[b])
                    reached = value[cells] @ gains[np.searchsorted(columns, flat[cells])]
                    passed = led[reached >= limits[led]]
                    if len(passed):
                        hit.append(b)
                        queried.append(passed.astype("int32"))
            if hit:
                some = pa.array(hit, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").take(some), docs.take(some), pa.array(queried, pa.list_(pa.int32()))],
                    names=["at", "docs", "queries"],
                )

    return index.mapInArrow(bound, VISITS)


def score_visits(chunks: DataFrame, visited: DataFrame, queries: Queries, k: int) -> DataFrame:
    """The k best (query, id, score) among the visited documents of each chunk, scores above 0; of
    equal scores and ids any. Every visited document of a query is scored once, exactly."""
    id_type = chunks.schema["id"].dataType.simpleString()

    def score(documents: pa.Table, blocks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "pos": [], "score": []}
        ids = pa.nulls(0)
        if documents.num_rows and blocks.num_rows:
            chunk = Chunk(documents)
            ids = chunk.ids
            by_id = pa.compute.rank(ids, "ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype("int64")
            wanted: dict[int, list[int]] = {}
            for b, listed in enumerate(blocks.column("queries").to_pylist()):
                for q in listed:
                    wanted.setdefault(q, []).append(b)
            docs = blocks.column("docs").combine_chunks()
            starts, members = docs.offsets.to_numpy(), docs.values.to_numpy().astype("int64")
            gain = np.zeros(len(queries.weights), "int64")
            for q, listed in wanted.items():
                some = np.unique(np.concatenate([members[starts[b] : starts[b + 1]] for b in listed]))
                gain[queries.terms(q)] = queries.gains(q)
                scores = chunk.scores(some, gain)
                gain[queries.terms(q)] = 0
                best = np.lexsort((by_id[some], -scores))[:k]
                best = best[scores[best] > 0]
                out["query"] += [q] * len(best)
                out["pos"] += some[best].tolist()
                out["score"] += scores[best].tolist()
        picked = pa.array(out["pos"], pa.int32())
        found = ids.take(picked) if len(picked) else pa.array([], documents.schema.field("id").type)
        return pa.table(
            {"query": pa.array(out["query"], pa.int32()), "id": found, "score": pa.array(out["score"], pa.int64())}
        )

    return chunks.groupBy("chunk").cogroup(visited.groupBy("at")).applyInArrow(
        score, f"query int, id {id_type}, score long"
    )


def _best(scored: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to k of each query; the tasks keep k rows a query before the shuffle."""
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _seeds(postings: DataFrame, queries: Queries, most: np.ndarray) -> DataFrame:
    """For every query the strongest documents of its weightiest terms, as visits."""
    led: dict[int, list[int]] = {}
    for q in range(len(queries.ids)):
        for i in np.argsort(-queries.gains(q) * most[queries.terms(q)], kind="stable")[:SEED_TERMS]:
            led.setdefault(int(queries.terms(q)[i]), []).append(q)
    spark = postings.sparkSession
    terms = spark.createDataFrame([(t, q) for t, q in led.items()], "term int, queries array<int>")
    strongest = Window.partitionBy("term").orderBy(F.desc("impact"), "chunk", "pos")
    top = (
        postings.join(F.broadcast(terms.select("term")), "term", "left_semi")
        .withColumn("__r", F.row_number().over(strongest))
        .where(F.col("__r") <= SEED_DOCS)
    )
    return top.groupBy("chunk", "term").agg(F.collect_list("pos").alias("docs")).join(F.broadcast(terms), "term").select(
        F.col("chunk").alias("at"), "docs", "queries"
    )


def _entries(queries: Queries, most: np.ndarray, limits: np.ndarray) -> dict[int, np.ndarray]:
    """Terms through which a query has to look: the rest of its terms together stay below its limit."""
    led: dict[int, list[int]] = {}
    for q in range(len(queries.ids)):
        gains = queries.gains(q) * most[queries.terms(q)]
        order = np.argsort(gains, kind="stable")
        needed = order[np.cumsum(gains[order]) >= limits[q]]
        for t in queries.terms(q)[needed[gains[needed] > 0]].tolist():
            led.setdefault(t, []).append(q)
    return {t: np.array(q) for t, q in led.items()}


@dataclass
class Prepared:
    """What searching one slice needs, all of it written."""

    chunks: DataFrame
    index: DataFrame
    entries: dict[int, np.ndarray]
    limits: np.ndarray


def prepare(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> Prepared | None:
    """Count terms, deal documents to chunks, find thresholds and build the index of one slice."""
    counted = cut_lineage(_counted(docs, queries.vocabulary, id_col, text_col))
    n_docs, length, cells = counted.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    if not cells:
        drop_written(counted)
        return None
    m = F.expr(f"int(25 + (cast(75 * n as decimal(38, 0)) * {n_docs}) div {length})")
    salt = F.xxhash64("id", "n", "tfs")
    chunks = cut_lineage(
        counted.where(F.size("terms") > 0)
        .withColumn("m", m.cast("long"))
        .select("id", "sig", "terms", F.expr("transform(tfs, tf -> int((1000000000 * tf) div (1000 * tf + 8 * m)))").alias("impacts"), salt.alias("salt"))
        .repartitionByRange(-(-cells // CHUNK_CELLS), "sig", "salt")
        .select(
            F.spark_partition_id().alias("chunk"), (F.monotonically_increasing_id() % (1 << 33)).cast("int").alias("pos"),
            "id", "terms", "impacts",
        )
    )
    drop_written(counted)
    postings = chunks.select("chunk", "pos", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("impacts").alias("impact"))))
    df, most = np.zeros(len(queries.vocabulary), "int64"), np.zeros(len(queries.vocabulary), "int64")
    for r in postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most")).collect():
        df[r.term], most[r.term] = r.df, r.most
    queries.weights = np.array([weight(n_docs, int(n)) for n in df], "int64")
    limits = np.ones(len(queries.ids), "int64")  # a score of 0 is no result
    seeded = _best(score_visits(chunks, _seeds(postings, queries, most), queries, k), k)
    for r in seeded.where(F.col("rank") == k).select("query", "score").collect():
        limits[r.query] = r.score
    entries = _entries(queries, most, limits)
    return Prepared(chunks, cut_lineage(build_index(chunks, queries, entries)), entries, limits)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The k best documents for each row of ``items`` (``item_col``, ``text_col``): item id, rank (from
    1), document id, score. Only scores above 0 count; equal scores go by ascending id, null ids last.

    Null and empty texts have no terms: such documents are never found, such items find nothing.
    Repeated rows and ids are rows of their own, on both sides. Empty tables give no rows. Texts are
    read whole; other columns are not read, whatever their names. The queries' terms are handled in
    slices of SLICE_TERMS, each a pass over the documents.
    """
    spark = docs.sparkSession
    id_name, item_name = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {item_name}, rank int, {id_col} {id_name}, score long")
    for queries in _slices(items, item_col, text_col):
        ready = prepare(docs, queries, k, id_col, text_col)
        if ready is None:
            continue
        seen = visits(ready.index, queries, ready.entries, ready.limits)
        best = _best(score_visits(ready.chunks, seen, queries, k), k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item {item_name}")
        found = cut_lineage(best.join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
        drop_written(ready.chunks, ready.index)
        out = out.unionByName(found.toDF(item_col, "rank", id_col, "score"))
    return out
