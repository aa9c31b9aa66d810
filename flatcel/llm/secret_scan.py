"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by the SHA-256 of its content. The
ledger holds one row per (blob, rule, rule version) scanned so far, with the spans
found. A run scans only pairs that the ledger lacks, once per distinct blob however
many paths share it, and joins the findings of the ledger and of the run back to all
paths. Raising a rule's version makes its pairs unseen again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.llm.spans import count_kind, joined, matches
from flatcel.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, the least length of a match (or of the part that
    ``value`` captures) and a cheap condition that every text with a match fulfils."""

    name: str
    version: int
    pattern: str
    least: int = 0
    value: str = ""
    needs: str = "true"


# Fixed values. Unbounded repeats are possessive where nothing later could take characters
# back, so long runs cost no backtracking.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]++", 8, f"^{_ASSIGN}([A-Za-z0-9+/_.=-]+)$"),
    Rule("access", 1, r"AKIA[A-Z0-9]++", 16, needs="contains(text, 'AKIA')"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs="contains(text, '-----BEGIN ')"),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}+", needs="contains(text, 'gh')"),
    Rule("slack", 1, r"(?<![A-Za-z0-9_])xox[abposr]-[A-Za-z0-9-]{10,}+", needs="contains(text, 'xox')"),
    Rule(
        "jwt",
        1,
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        needs="contains(text, 'eyJ')",
    ),
)
RULES = BASE_RULES + EXTRA_RULES

SPAN = "struct<s:int,e:int>"
LEDGER_SCHEMA = f"blob string, rule string, version int, spans array<{SPAN}>"


def content_address(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 content; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules=RULES, text_col: str = "text") -> DataFrame:
    """(blob, text, todo) for each distinct content that lacks a (rule, version) in ``ledger``;
    ``todo`` lists the names of the rules to run."""
    blobs = (
        versions.select(content_address(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", names)
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    done = (
        ledger.where(F.col("version") == F.element_at(current, F.col("rule")))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("done"))  # one entry per rule at most
    )
    return (
        blobs.join(done, "blob", "left")
        .select("blob", "text", F.array_except(names, F.coalesce("done", F.expr("array()"))).alias("todo"))
        .where(F.size("todo") > 0)
    )


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the blobs of ``unseen_blobs``; a pair
    without findings has an empty array."""
    found = []
    for r in rules:
        wanted = F.array_contains("todo", r.name) & F.expr(r.needs)
        kept = F.filter(matches(F.col("text"), r.pattern, wanted), _long_enough(r))
        found.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.version).alias("version"),
                F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"),
            )
        )
    return blobs.select("blob", "todo", F.explode(F.array(*found)).alias("f")).where(
        F.array_contains("todo", F.col("f.rule"))
    ).select("blob", "f.rule", "f.version", "f.spans")


def _long_enough(rule: Rule):
    return lambda x: F.length(F.regexp_extract(x["hit"], rule.value, 1) if rule.value else x["hit"]) >= rule.least


def findings(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules=RULES,
    path_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(spans of every path, new ledger rows).

    New ledger rows are written to the shared checkpoint folder as they are found. The first
    frame has one row per row of ``versions``: the path and ``found``, an array
    of (s, kind order, kind, e) ordered by start, then kind. The second is to be appended
    to the ledger. Null and empty texts are one blob without findings; repeated rows and
    null paths get the findings of their content; other columns are not looked at; an
    empty table gives empty frames.
    """
    fresh = cut_lineage(scan(unseen_blobs(versions, ledger, rules, text_col), rules))
    known = fresh
    if ledger is not None:
        current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
        known = fresh.unionByName(ledger.where(F.col("version") == F.element_at(current, F.col("rule"))))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    by_blob = (
        known.where(F.size("spans") > 0)
        .select("blob", "rule", F.element_at(place, F.col("rule")).alias("i"), F.explode("spans").alias("x"))
        .groupBy("blob")
        .agg(  # bounded by the length of one text
            F.sort_array(
                F.collect_list(F.struct(F.col("x.s").alias("s"), "i", F.col("rule").alias("kind"), F.col("x.e").alias("e")))
            ).alias("found")
        )
    )
    paths = versions.select(path_col, content_address(F.col(text_col)).alias("blob"))
    # Written, so that the join is one of two plain shuffles and Spark may split a blob that
    # very many paths share.
    out = paths.join(cut_lineage(by_blob), "blob", "left").select(path_col, "blob", "found")
    return out, fresh


def secret_report(versions: DataFrame, rules=RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans, per path."""
    spans, _ = findings(versions, None, rules, path_col, text_col)
    found = F.coalesce("found", F.expr("cast(array() as array<struct<s:int,i:int,kind:string,e:int>>)"))
    base = F.filter("found", lambda x: x["i"] < len(BASE_RULES))
    return spans.withColumn("found", found).select(
        path_col,
        *[count_kind("found", r.name) for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
