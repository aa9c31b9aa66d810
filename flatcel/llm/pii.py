"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. Every pattern match is a proposal with the score of its kind;
a validator (Luhn, mod 97, value ranges) drops proposals that cannot be what they look
like; a context word in the characters before a span raises the score. Spans that reach
the threshold are reported. The four base kinds carry scores above the threshold, so
their confirmed spans always stay; the added kinds (IBAN, social security number) need
their checksum or their context.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flatcel.llm.spans import bind, count_kind, joined, matches, pieces, text_before

THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35
# Texts are cut into pieces of this length, so that a context is read near its span.
PIECE_CHARS = 1024


@dataclass(frozen=True)
class Kind:
    """``needs``: a character every match contains; ``context``: words that raise the score."""

    name: str
    pattern: str
    score: float
    needs: str
    context: str


# Fixed values. Unbounded repeats are possessive where nothing later could take characters
# back, and a run is entered at its start only, so a long run costs linear time.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.6,
        "@",
        "mail|contact|kontakt|correo|courriel",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.55, ".", "ip|host|server|addr"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.6, "", "card|visa|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.55, "+", "tel|phone|call|mobil|fax"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        0.55,
        "",
        "iban|account|konto|cuenta|compte",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3,
        "-",
        "ssn|social security|sozialversicherung",
    ),
)
BASE = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    return F.call_function("luhn_check", digits)


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN without spaces: country and check digits go last, letters
    count 10 to 35, the remainder is taken digit by digit."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    values = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55),
    )
    rest = F.aggregate(
        F.filter(values, lambda v: v.isNotNull()),
        F.lit(0),
        lambda acc, v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int"),
    )
    return rest == 1


def confirmed(kind: str, hit: Column) -> Column:
    """Whether a proposed span can be what its kind says."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        parts = F.split(hit, r"\.")
        value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(parts, lambda p: (F.length(value(p)) <= 3) & (F.lpad(value(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans_of(i: int, kind: Kind, text: Column, threshold: float) -> Column:
    """Confirmed and scored spans of one kind."""
    wanted = text.contains(kind.needs) if kind.needs else F.lit(True)
    proposed = F.filter(matches(text, kind.pattern, wanted), lambda x: confirmed(kind.name, x["hit"]))

    def scored(x: Column, cut: Column) -> Column:
        near = text_before(cut, PIECE_CHARS, x["s"], CONTEXT_CHARS).rlike(f"(?i)(?:{kind.context})")
        return F.struct(
            F.lit(i).alias("i"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.lit(kind.name).alias("kind"),
            (F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"),
        )

    # The text is cut only where there is something to score.
    every = bind(
        proposed,
        lambda spans: F.when(
            F.size(spans) > 0,
            bind(pieces(text, PIECE_CHARS), lambda cut: F.transform(spans, lambda x: scored(x, cut))),
        ).otherwise(F.expr("cast(array() as array<struct<i:int,s:int,e:int,kind:string,score:double>>)")),
    )
    return F.filter(every, lambda x: x["score"] >= threshold)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, found) per row; found is an array of (i, s, e, kind, score), ordered by kind as
    listed, then start; offsets in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows get equal results, null ids stay.
    Other columns are not looked at. An empty table gives an empty result.
    """
    text = F.col("text")
    per_kind = [_spans_of(i, k, text, threshold) for i, k in enumerate(KINDS)]
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(text_col, F.lit("")).alias("text")).select(
        id_col, F.concat(*per_kind).alias("found")
    )


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans, per row."""
    base = F.filter("found", lambda x: x["i"] < len(BASE))
    return find_pii(docs, id_col, text_col).select(
        id_col,
        *[count_kind("found", n) for n in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
