"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

The trees are trained from labelled URLs. Where no labels are given, the URLs that a rule
decides are the labelled ones. Features are counted by column functions; the trees are
Spark's own, fitted on a sample of labelled rows of documented size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flatcel.llm.common import bounded_sample


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``/`` + ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


# Fixed values.
RULES = (
    Rule("allow", "org", ""),
    Rule("block", "example.org", "es/"),
    Rule("block", "example.org", "en/1"),
    Rule("allow", "com", "fr/"),
    Rule("block", "com", "de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# At most about this many labelled URLs are used to fit the trees.
MAX_TRAIN_ROWS = 20_000
FEATURES = (
    "url_length host_length path_length depth host_parts digits host_digits hyphens upper entropy "
    "params query_length fragment secure www extension suffix_length suffix_rows suffix_blocked"
).split()


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to the first of ``/?#``, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to the first of ``?#``; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest rule that fits (ties: the later listed), else null. Every rule path
    starts with ``/``, so an empty path fits none."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith("/" + r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    cases = F.lit(None).cast("string")
    for r in rules:
        cases = F.when(rule == r.name, F.lit(r.verdict)).otherwise(cases)
    return cases


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda d: d == c)) / n,
    )
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def with_features(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id, url, host, path, suffix and the features that need one row only. Only the host's last
    label is used as suffix, so that its statistics stay small."""
    url = F.coalesce("url", F.lit(""))
    cut = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda n, of: F.when(F.length(of) > 0, n / F.length(of)).otherwise(0.0)
    number = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"),
        "host_parts": F.when(F.col("host") == "", 0).otherwise(_count(F.col("host"), ".") + 1),
        "digits": share(_count(F.col("path"), "0-9"), F.col("path")),
        "host_digits": share(_count(F.col("host"), "0-9"), F.col("host")),
        "hyphens": _count(F.col("host"), "-"),
        "upper": share(_count(url, "A-Z"), url),
        "entropy": entropy(F.col("host")),
        "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query),
        "fragment": url.contains("#").cast("int"),
        "secure": F.lower(url).startswith("https:").cast("int"),
        "www": F.col("host").startswith("www.").cast("int"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "suffix_length": F.length(F.substring_index("host", ".", -1)),
    }
    return cut.select(
        "id", "url", "host", "path", F.substring_index("host", ".", -1).alias("suffix"),
        *[c.cast("double").alias(n) for n, c in number.items()],
    )


def suffix_statistics(labelled: DataFrame, total: int, smoothing: float = 10.0) -> DataFrame:
    """(suffix, suffix_rows, suffix_blocked): share of the labelled rows and smoothed block rate."""
    return labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")).select(
        "suffix",
        (F.col("n") / max(total, 1)).alias("suffix_rows"),
        ((F.col("b") + 0.5 * smoothing) / (F.col("n") + smoothing)).alias("suffix_blocked"),
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_train_rows: int = MAX_TRAIN_ROWS,
    rounds: int = 12,
    depth: int = 4,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) for every row of ``pages``.

    ``labels`` (url, blocked 0/1) are labelled URLs; without them those that a rule
    decides are used. A null URL and one without ``://`` have empty host and path, fit no
    rule and are scored like any other; repeated rows get equal results, null ids stay;
    other columns are not looked at. With no labelled URL, or labels of one class only,
    the score is the share of blocked labels (0 without any). An empty table gives an
    empty result.
    """
    rows = with_features(pages, id_col, url_col)
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    decided = rule_verdict(F.col("rule"), rules)
    if labels is None:
        labelled = rows.where("rule is not null").withColumn("label", (decided == "block").cast("double"))
    else:
        labelled = with_features(labels, "blocked", "url").withColumn("label", F.col("id").cast("double")).drop("id")
    counts = {r["label"]: r["count"] for r in labelled.where("label is not null").groupBy("label").count().collect()}
    total = sum(counts.values())
    stats = suffix_statistics(labelled, total)
    prior = counts.get(1.0, 0) / total if total else 0.0

    def complete(df: DataFrame) -> DataFrame:
        return df.join(stats, "suffix", "left").fillna({"suffix_rows": 0.0, "suffix_blocked": prior})

    if len(counts) < 2:
        scored = rows.withColumn("block_score", F.lit(prior))
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        sample = bounded_sample(labelled.where("label is not null"), "url", max_train_rows)
        train = assembler.transform(complete(sample)).select("features", "label").coalesce(6)
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxMemoryInMB=64)
        model = trees.fit(train)
        scored = model.transform(assembler.transform(complete(rows))).withColumn(
            "block_score", vector_to_array("probability")[1]
        )
    by_method = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(decided, by_method).alias("verdict"),
        "block_score",
    )

