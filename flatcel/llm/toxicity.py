"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled documents are dealt into three folds by a hash of the id. The first yields the
lexicon: words and word stems that stand almost only in toxic texts, besides a short
fixed list. The second trains the trees on lexicon densities, closeness of lexicon words
to second-person words, capitals, punctuation and obfuscation rates. The third calibrates
the trees' probability by isotonic regression. Every fold is bounded by
``max_train_docs``; scoring reads every whole text in Arrow batches, the trees and the
calibration are Spark's own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from flatcel.llm.common import bounded_sample
from flatcel.session import cut_lineage

MAX_TRAIN_DOCS = 24_000
# At most so many learned lexicon entries; they are part of every task.
LEXICON_TERMS = 4_000
THRESHOLD = 0.3

# Insults in use, second-person words, letters written as signs.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash scum clown disgusting garbage "
    "vermin imbecile fool fools hate ugly shut dumm idioten versager abschaum imbécile crétin estúpido basura"
).split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre usted tú ti vosotros".split()
)
SIGNS = str.maketrans("013457@$!|", "oieastasil")
PUNCTUATION = ".,;:!?\"'()[]{}<>-_*~`/\\#%&+=|@$"
NEAR = 5


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if w]


def lexicon_terms(words: Counter | list[str]) -> set[str]:
    """Lexicon entries of a text: whole words, and stems of four and five letters."""
    out = set()
    for w in set(words):
        if len(w) <= 40:
            out.add(w)
        if len(w) >= 5:
            out.add(w[:4] + "~")
            out.add(w[:5] + "~~")
    return out


def plain(word: str) -> str:
    """``word`` with signs read as letters and other signs left out."""
    return "".join(c for c in word.translate(SIGNS) if c.isalpha())


FEATURES = 16


class Featurizer:
    """Dense features of a text against a lexicon {entry: weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known = frozenset(INSULTS)

    def _weight(self, word: str) -> tuple[float, float]:
        """Weight as a word, weight as a stem."""
        get = self.lexicon.get
        stem = max(get(word[:4] + "~", 0.0), get(word[:5] + "~~", 0.0)) if len(word) >= 5 else 0.0
        return get(word, 0.0), stem

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = tokens(text)
        n = max(1, len(words))
        counts = Counter(words)
        word_n = stem_n = known_n = hidden_n = odd_n = 0
        word_kinds = stem_kinds = 0
        heaviest = 0.0
        marked = set()
        for w, k in counts.items():
            a, b = self._weight(w)
            if a:
                word_n, word_kinds = word_n + k, word_kinds + 1
            if b:
                stem_n, stem_kinds = stem_n + k, stem_kinds + 1
            if w in self.known:
                known_n += k
            if a or b or w in self.known:
                marked.add(w)
                heaviest = max(heaviest, a, b)
            if not w.isalpha():
                p = plain(w)
                if len(p) >= 3 and any(c.isalpha() for c in w):
                    odd_n += k
                    if p in self.known or self.lexicon.get(p):
                        hidden_n += k
                        marked.add(w)
        near = 0
        if marked:
            persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            j = 0
            for i, w in enumerate(words):
                if w in marked:
                    while j < len(persons) and persons[j] < i - NEAR:
                        j += 1
                    near += j < len(persons) and persons[j] <= i + NEAR
        second = sum(counts[w] for w in SECOND_PERSON if w in counts)
        size = max(1, len(text))
        raw = text.encode("utf-8", "surrogatepass")
        capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
        marks = len(raw) - len(raw.translate(None, b"!?"))
        points = len(raw) - len(raw.translate(None, PUNCTUATION.encode()))
        log = math.log1p
        return [
            log(len(words)),
            log(1000 * word_n / n),
            log(word_kinds),
            log(1000 * stem_n / n),
            log(stem_kinds),
            log(1000 * known_n / n),
            log(known_n),
            near / max(1, sum(counts[w] for w in marked)),
            log(near),
            second / n,
            capitals / size,
            marks / size,
            points / size,
            odd_n / n,
            log(hidden_n),
            heaviest,
        ]


def learn_lexicon(rows: DataFrame, max_terms: int = LEXICON_TERMS, least: int = 3, odds: float = 3.0) -> dict[str, float]:
    """Entries of at least ``least`` toxic texts whose smoothed log odds exceed ``odds``, the
    strongest ``max_terms`` of them. ``rows``: (text, label); equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, label = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = lexicon_terms(tokens(text))
                term.extend(found)
                label.extend([y] * len(found))
            yield pa.record_batch({"term": pa.array(term, pa.string()), "label": pa.array(label, pa.float64())})

    once = rows.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    sizes = once.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = float(sizes[0] or 0), float(sizes[1] or 0)
    terms = once.select("text", "label").mapInArrow(
        run, StructType([StructField("term", StringType()), StructField("label", DoubleType())])
    )
    weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (clean + 1))
    strong = (
        terms.groupBy("term")
        .agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
        .where(F.col("pos") >= least)
        .select("term", weight.alias("w"), "pos")
        .where(F.col("w") > odds)
        .orderBy(F.desc("pos"), F.desc("w"), "term")
        .limit(max_terms)
    )
    return {r["term"]: r["w"] for r in strong.collect()}  # at most max_terms rows


def features(rows: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns of ``rows`` and ``x``, the features of its ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(lexicon)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = [of(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
                out = {c: part.column(part.schema.get_field_index(c)) for c in keep}
                yield pa.record_batch(out | {"x": pa.array(x, pa.list_(pa.float64()))})

    schema = StructType([*[rows.schema[c] for c in keep], StructField("x", ArrayType(DoubleType()))])
    return rows.select(*keep, "text").mapInArrow(run, schema)


class ToxicityModel:
    """Lexicon, trees and calibration; without trees every score is ``prior``."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, prior: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def raw(self, featured: DataFrame) -> DataFrame:
        with_vector = featured.withColumn("features", array_to_vector("x"))
        return self.trees.transform(with_vector).withColumn("raw", vector_to_array("probability")[1])

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) for every row of ``docs``.

        Null and empty texts have no words and are scored on that; repeated rows get equal
        scores, null ids stay; other columns are not looked at; an empty table gives an
        empty result."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if self.trees is None:
            return rows.select(F.col("id").alias(id_col), F.lit(self.prior).alias("score"))
        scored = self.raw(features(rows, self.lexicon))
        if self.calibration is not None:
            scored = self.calibration.transform(scored)
        else:
            scored = scored.withColumn("calibrated", F.col("raw"))
        return scored.select(
            F.col("id").alias(id_col), F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score")
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_train_docs: int = MAX_TRAIN_DOCS,
    rounds: int = 12,
    depth: int = 3,
) -> ToxicityModel:
    """Model from labelled documents (id, label 0/1), thinned to about ``max_train_docs``.

    With labels of one class only, or none, the score is the share of toxic labels."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(
        "id is not null and label in (0, 1)"
    ).groupBy("id").agg(F.max("label").alias("label"))
    sample = bounded_sample(usable, "id", max_train_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = cut_lineage(  # at most max_train_docs texts
        texts.join(F.broadcast(sample), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)))
    )
    folds = {"lexicon": F.col("fold") < 5, "trees": F.col("fold").between(5, 7), "calibration": F.col("fold") > 7}
    size = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("label").alias("share"),
        *[F.count_distinct(F.when(c, F.col("label"))).alias(k) for k, c in folds.items()],
    ).first()
    lexicon = learn_lexicon(rows.where(folds["lexicon"]).select("text", "label"))
    if size["trees"] < 2:
        return ToxicityModel(lexicon, prior=float(size["share"] or 0.0))
    ready = cut_lineage(features(rows.where(F.col("fold") >= 5), lexicon, ("label", "fold")))
    data = ready.withColumn("features", array_to_vector("x"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxMemoryInMB=64).fit(
        data.where(folds["trees"]).select("features", "label").coalesce(6)
    )
    model = ToxicityModel(lexicon, trees)
    if size["calibration"] == 2:
        held = model.raw(ready.where(folds["calibration"])).select("raw", "label").coalesce(6)
        model.calibration = IsotonicRegression(
            featuresCol="raw", labelCol="label", predictionCol="calibrated"
        ).fit(held)
    return model
