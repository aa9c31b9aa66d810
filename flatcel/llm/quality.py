"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features describe the line and its neighbours; a label
also depends on the label before it. The forward-backward pass gives each line its
marginal probability of being good, and the marginals, weighted by line length, add up
to the quality of the document. A two-parameter logistic step, fitted on the training
documents, turns that mean into a score around 0.5.

The field is fitted on a bounded sample of labelled documents (``max_train_docs``): the
sample is dealt into shards, a task fits each shard, and the weights are averaged.
Scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flatcel.llm.common import bounded_sample

MAX_TRAIN_DOCS = 4_000
SHARDS = 8
STEPS = 120

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"
_BARS = b"|\t"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"
_HIGH = bytes(range(128, 256))
OWN = 16  # features of the line itself, the constant first
NEAR = (2, 4, 5, 6, 7, 10, 11, 15)  # features that are also taken from both neighbours
WIDTH = OWN + 2 * len(NEAR) + 3


def _own_features(line: bytes, seen: set[bytes]) -> list[float]:
    n = len(line)
    if not n:
        return [1.0] + [0.0] * 10 + [1.0] + [0.0] * 4
    count = lambda chars: n - len(line.translate(None, chars))
    upper, lower, high = count(_UPPER), count(_LOWER), count(_HIGH)
    words = line.split()
    w = max(1, len(words))
    repeated = line in seen
    seen.add(line)
    return [
        1.0,
        min(1.0, math.log1p(n) / 8),
        upper / max(1, upper + lower),
        count(_DIGIT) / n,
        min(1.0, 4 * count(_PUNCT) / n),
        min(1.0, 8 * count(_BARS) / n),
        min(1.0, 8 * line.count(b"!") / n),
        1.0 - len(set(words)) / w,
        min(1.0, n / w / 16),
        1.0 if line.rstrip()[-1:] in (b".", b"?", b"!") else 0.0,
        1.0 if repeated else 0.0,
        1.0 if n < 20 else 0.0,
        min(1.0, max(map(len, words), default=0) / 60),
        min(1.0, 2 * line.count(b" ") / n),
        high / n,
        min(1.0, 4 * count(_SYMBOLS) / n),
    ]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features per line, weight per line). Null and empty texts are one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    seen: set[bytes] = set()
    own = np.array([_own_features(x, seen) for x in lines])
    size = np.array([len(x) for x in lines], float)
    near = own[:, NEAR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    edge = np.zeros((len(lines), 3))
    edge[0, 0] = edge[-1, 1] = 1.0
    edge[1:, 2] = np.abs(np.diff(own[:, 1]))
    return np.hstack([own, before, after, edge]), size + 1.0


def _marginals(unary: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains padded to (chains, longest): the probability of good per line and the expected
    number of each transition per chain, by scaled forward-backward. ``unary`` is the log odds
    of good, ``pair[a, b]`` the log weight of a followed by b (0 bad, 1 good)."""
    chains, longest = unary.shape
    e = np.exp(np.clip(unary, -30, 30))
    emit = np.stack([1 / (1 + e), e / (1 + e)], axis=-1)
    step = np.exp(pair)
    alpha = np.empty((longest, chains, 2))
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    alpha[0] = a
    for t in range(1, longest):
        a = (a @ step) * emit[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    good = np.empty((chains, longest))
    moves = np.zeros((chains, 2, 2))
    beta = np.ones((chains, 2))
    for t in range(longest - 1, -1, -1):
        last = (lengths - 1 == t)[:, None]
        beta = np.where(last, 1.0, beta)
        post = alpha[t] * beta
        good[:, t] = post[:, 1] / post.sum(1)
        if t:
            ahead = emit[:, t] * beta
            both = alpha[t - 1][:, :, None] * step[None] * ahead[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            moves += np.where((lengths > t)[:, None, None], both, 0.0)
            beta = ahead @ step.T
            beta /= beta.sum(1, keepdims=True)
    return good, moves


def _groups(lengths: np.ndarray, cells: int = 200_000) -> Iterator[np.ndarray]:
    """Chains of like length, so that padding stays small and a group has bounded size."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while (
            stop < len(order)
            and lengths[order[stop]] <= 2 * lengths[order[start]] + 4
            and (stop - start + 1) * lengths[order[stop]] <= cells
        ):
            stop += 1
        yield order[start:stop]
        start = stop


def document_means(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the line marginals of each document."""
    w, pair = weights[:WIDTH], weights[WIDTH : WIDTH + 4].reshape(2, 2)
    lengths = np.array([len(s) for _, s in rows], int)
    out = np.empty(len(rows))
    for group in _groups(lengths):
        longest = lengths[group].max()
        unary = np.zeros((len(group), longest))
        size = np.zeros((len(group), longest))
        for i, g in enumerate(group):
            unary[i, : lengths[g]] = rows[g][0] @ w
            size[i, : lengths[g]] = rows[g][1]
        good, _ = _marginals(unary, lengths[group], pair)
        out[group] = (good * size).sum(1) / size.sum(1)
    return out


def _fit_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights of the field for one shard: gradient ascent (Adam) on the mean log likelihood per
    line, every line taking the label of its document, then the logistic step."""
    frame = frame.sort_values("id")
    rows = [line_features(t) for t in frame["text"]]
    label = frame["label"].to_numpy(float)
    lengths = np.array([len(s) for _, s in rows], int)
    total = lengths.sum()
    # Both classes weigh the same, whatever their share.
    share = np.array([max(1, lengths[label == c].sum()) for c in (0.0, 1.0)]) / total
    heavy = np.where(label == 1.0, 0.5 / share[1], 0.5 / share[0])
    groups = []
    for group in _groups(lengths):
        longest = lengths[group].max()
        x = np.zeros((len(group), longest, WIDTH))
        for i, g in enumerate(group):
            x[i, : lengths[g]] = rows[g][0]
        groups.append((group, x))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for k in range(1, STEPS + 1):
        grad = -1e-3 * theta
        grad[WIDTH:] -= 2e-2 * theta[WIDTH:]  # lines of a document share a label by construction
        for group, x in groups:
            good, moves = _marginals(x @ theta[:WIDTH], lengths[group], theta[WIDTH:].reshape(2, 2))
            real = np.arange(x.shape[1])[None, :] < lengths[group][:, None]
            miss = np.where(real, label[group][:, None] - good, 0.0) * heavy[group][:, None]
            grad[:WIDTH] += np.tensordot(miss, x, ((0, 1), (0, 1))) / total
            seen = np.zeros_like(moves)
            c = label[group].astype(int)
            seen[np.arange(len(group)), c, c] = lengths[group] - 1
            grad[WIDTH:] += ((seen - moves) * heavy[group][:, None, None]).sum(0).ravel() / total
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    mean = document_means(rows, theta)
    a, b = 1.0, 0.0
    for _ in range(400):  # logistic step on the log odds of the mean, plain class weights
        z = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))
        p = 1 / (1 + np.exp(-(a * z + b)))
        a += 0.05 * (((label - p) * z).mean() - 1e-3 * (a - 1))
        b += 0.3 * (label - p).mean()
    out = np.append(theta, [a, b])
    return pd.DataFrame({"i": np.arange(len(out)), "w": out, "n": float(len(frame))})


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train_docs: int = MAX_TRAIN_DOCS,
) -> np.ndarray:
    """Weights (line features, transitions, logistic step) from labelled documents.

    ``labels`` (id, label 0/1) is counted and thinned to about ``max_train_docs`` rows by a
    hash of the id before it meets the texts. Of texts that share an id, the one with the
    smallest hash is used. Shards with one class only are left out;
    without any usable shard the weights are zero and every score is 0.5."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(
        "id is not null and label in (0, 1)"
    ).groupBy("id").agg(F.max("label").alias("label"))
    sample = bounded_sample(usable, "id", max_train_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of_id = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(of_id.alias("text"))  # bounded by max_train_docs
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SHARDS)))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["label"].nunique() < 2:
            return pd.DataFrame({"i": [], "w": [], "n": []}).astype({"i": int})
        return _fit_shard(frame.sort_values("id", ignore_index=True))

    fitted = shards.groupBy("shard").applyInPandas(fit, "i int, w double, n double")
    mean = fitted.groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).collect()
    weights = np.zeros(WIDTH + 6)
    for r in mean:  # one row per weight
        weights[r["i"]] = r["w"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``; 0 to 1, higher is better.

    Null and empty texts are one empty line and get the score of that line; repeated rows
    get equal scores, null ids stay; other columns are not looked at; an empty table
    gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    w = [float(x) for x in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(w)
        a, b = weights[WIDTH + 4 :]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                mean = document_means([line_features(t.as_py()) for t in part.column(1)], weights)
                mean = np.clip(mean, 1e-6, 1 - 1e-6)
                p = 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))
                yield pa.record_batch({"id": part.column(0), "score": pa.array(p, pa.float64())})

    out = StructType([rows.schema["id"], StructField("score", DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def drop_low_quality(
    docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    The score runs on the rows as they pass (no join): texts are scored next to the
    columns they stand with."""
    w = [float(x) for x in weights]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(w)
        a, b = weights[WIDTH + 4 :]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                mean = document_means([line_features(t.as_py()) for t in part.column(place)], weights)
                mean = np.clip(mean, 1e-6, 1 - 1e-6)
                p = 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))
                yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
