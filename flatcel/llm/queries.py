"""Registered queries of the training-data operators, and SQL where SQL can say them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flatcel.llm import (
    decontam,
    exact_dedup,
    lexical_search,
    license_scan,
    mixing,
    pii,
    quality,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)
from flatcel.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Weights learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 3) != 1)
    return quality.train(docs, labels)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_weights(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (crc_remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 4) != 2)
    scored = toxicity.train(docs, labels).score(docs)
    return scored.select(
        "doc_id",
        (crc_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)
"""


def _span_sql(kinds: list[tuple[str, str, str]], base: list[str], order: str) -> str:
    """SQL of a span report: kinds are (name, pattern, condition on `hit`)."""
    parts = ["WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for i, (name, pattern, accept) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"""h{i} AS (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps
  FROM d WHERE regexp_matches(t, '{p}')),
k{i} AS (SELECT doc_id, t, {i} AS i, '{name}' AS kind, hit,
    list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, t, hits, gaps, unnest(hits) AS hit, generate_subscripts(hits, 1) AS j FROM h{i})),
f{i} AS (SELECT doc_id, i, kind, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e FROM k{i} WHERE {accept})"""
        )
    parts.append("f AS (" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(kinds))) + ")")
    counts = ", ".join(
        f"(count(f.kind) FILTER (f.kind = '{b}'))::BIGINT AS n_{b}" for b in base
    )
    text = "kind || ':' || s || ':' || e"
    return (
        ",\n".join(parts)
        + f"""
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' ORDER BY {order}) FILTER (i < {len(base)}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY {order}), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
    )


_WORD_CASES = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _WORD_CASES + r"""["']?\x20*[:=]\x20*["']?"""
ORACLES["op2_secret_scan"] = _span_sql(
    [
        ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", "length(regexp_replace(hit, '^" + _ASSIGN.replace("'", "''") + "', '')) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(hit) >= 16"),
        ("hex", "[0-9a-f]{32,}", "true"),
        ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
        ("github", r"\bgh[opsur]_[A-Za-z0-9]{36,}", "true"),
        ("slack", r"\bxox[abposr]-[A-Za-z0-9-]{10,}", "true"),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ],
    ["assign", "access", "hex"],
    "s, i",
)

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda p:
  CASE WHEN (length({_DIGITS}) - p) % 2 = 0 THEN CAST({_DIGITS}[p] AS INTEGER)
       ELSE (2 * CAST({_DIGITS}[p] AS INTEGER)) % 10 + (2 * CAST({_DIGITS}[p] AS INTEGER)) // 10 END)) % 10 = 0"""
_IBAN = "(replace(hit, ' ', '')[5:] || replace(hit, ' ', '')[1:4])"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split({_IBAN}, ''), lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda acc, v: (acc * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"""
ORACLES["op6_pii"] = _span_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        (
            "ip",
            r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
            "len(list_filter(string_split(hit, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0",
        ),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97),
        (
            "ssn",
            r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
            "NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') AND regexp_matches("
            "substr(t, greatest(s - 39, 1)::BIGINT, least(s, 40)::BIGINT), '(?i)ssn|social security|sozialversicherung')",
        ),
    ],
    ["email", "ip", "card", "phone"],
    "i, s",
)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontamination"] = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS words FROM
        (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(words) AS n FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hits AS (SELECT doc_id, i, n, item_id FROM
         (SELECT doc_id, n, i, w[i:i + n - 1] AS words FROM
          (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
         JOIN win USING (words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
            (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM
          (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
places AS (SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
df AS (SELECT t, count(*) AS c FROM places GROUP BY t),
anchor AS (SELECT words, t, o FROM (SELECT words, words[o] AS t, o FROM
             (SELECT words, unnest(range(1, len(words) + 1)) AS o FROM (SELECT DISTINCT words FROM win))) JOIN df USING (t)
           QUALIFY row_number() OVER (PARTITION BY words ORDER BY c, o) = 1),
met AS (SELECT doc_id, words, w[greatest(p - 13, 1):p + 13] AS a, least(p, 14) - o AS s
        FROM anchor JOIN places USING (t) JOIN d USING (doc_id)),
near AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met JOIN win USING (words)
         WHERE list_has_all(a, words) AND len(list_filter(range(-2, 3), lambda x: len(list_filter(range(1, len(words) + 1), lambda k:
           list_contains(a[greatest(s + x + k - 2, 1):greatest(s + x + k + 2, 0)], words[k]))) = len(words))) > 0),
nears AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS list FROM near GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated,
       coalesce(m.n_near, 0)::BIGINT AS n_near, sha256(coalesce(m.list, '')) AS near_sha256
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN nears m USING (doc_id)
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT r, item_id, t, count(*) AS reps FROM
      (SELECT r, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
a AS (SELECT count(*) FILTER (len(w) > 0) AS nn, sum(len(w))::BIGINT AS ll FROM d),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM p, a GROUP BY t, nn),
s AS (SELECT q.r AS qr, item_id, p.r, doc_id,
        sum(reps * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
      FROM p JOIN q USING (t) JOIN f USING (t), a GROUP BY q.r, item_id, p.r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def _wording(template: str) -> str:
    """A template as a pattern over words that each follow a space."""
    out = []
    for part in re.findall(r"<<.*?>>|[^<\s]+", template):
        mark = part.strip("<>").split()
        if part == "<<opt>>":
            out.append("(?:")
        elif part == "<</opt>>":
            out.append(")?")
        elif part.startswith("<<var"):
            out.append(f"(?: [^ ]+){{{mark[1]},{mark[2]}}}")
        elif part.startswith("<<one"):
            out.append(" (?:" + "|".join(mark[2:]) + ")")
        else:
            out.append(" " + part)
    return "".join(out) + " "


def _evidence(template: str) -> str:
    """m / (m + 4), m the words outside of optional and replaceable regions."""
    bare = re.sub(r"<<var[^>]*>>", "", template)
    while "<<opt>>" in bare:
        bare = re.sub(r"<<opt>>(?:(?!<<opt>>).)*?<</opt>>", "", bare, count=1, flags=re.S)
    m = len(re.sub(r"<<one[^>]*>>", "x", bare).split())
    return f"{m}::DOUBLE / {m + 4}"


_PLACES = " || ".join(
    f"""list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(words.split()) - 1}] = {words.split()!r}), lambda i: i - 1)"""
    for words in license_scan.BASE.values()
)
_FOUND = ", ".join(
    f"CASE WHEN regexp_matches(s, '{_wording(t)}') THEN {{'l': '{n}', 'e': {_evidence(t)}, 'b': {n in license_scan.BASE}}} END"
    for n, t in (license_scan.BASE | license_scan.TEMPLATES).items()
)
ORACLES["op13_license_scan"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, {_PLACES} AS places, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
f AS (SELECT *, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_transform(list_filter(found, lambda x: x.b), lambda x: x.l)), ',') AS base_labels,
  array_to_string(list_sort(list_transform(found, lambda x: x.l)), ',') AS labels,
  coalesce(list_max(list_transform(found, lambda x: x.e)), 0.0)::DOUBLE AS score
FROM f
"""
