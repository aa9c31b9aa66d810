"""Differences between table snapshots, as patches.

A snapshot is a table of leaves: doc_id, path (array of text; an array index is
written ``[3]``) and value (text). Patches have doc_id, op (set, setNull, delete,
setLength), path, value, length. Ops are per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _index(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, r"^\[([0-9]+)\]$", 1), F.lit("")).cast("int")


def _lengths(leaves: DataFrame) -> DataFrame:
    """Length of each array: largest index among its elements plus one."""
    levels = leaves.select("doc_id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"))
    items = levels.select(
        "doc_id", F.slice("path", F.lit(1), F.col("k") - 1).alias("path"), _index(F.get("path", F.col("k") - 1)).alias("i")
    )
    return items.where("i is not null").groupBy("doc_id", "path").agg((F.max("i") + 1).alias("length"))


def diff_tables(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(undo, redo) patches between two snapshots.

    A leaf with a null value is a leaf; only one without a row is missing. Empty
    arrays and objects are leaves with the text ``[]`` or ``{}``. A leaf missing on
    one side is deleted from objects; in arrays its slot is emptied (set without a
    value) and the array length is set; a null leaf is put there by setNull. NaN
    equals NaN, as values are compared as text."""
    a = before.select("doc_id", "path", F.col("value").alias("__a"), F.lit(True).alias("__in_a"))
    b = after.select("doc_id", "path", F.col("value").alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, ["doc_id", "path"], "full").where(
        F.col("__in_a").isNull() | F.col("__in_b").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))
    )
    in_array = _index(F.element_at("path", -1)).isNotNull()
    la, lb = _lengths(before), _lengths(after).withColumnRenamed("length", "__lb")
    sizes = la.join(lb, ["doc_id", "path"], "full").where(~F.col("length").eqNullSafe(F.col("__lb")))

    def patch(value: str, present: str, length: str) -> DataFrame:
        gone = F.col(present).isNull()
        changes = both.select(
            "doc_id",
            F.when(gone & ~in_array, "delete")
            .when(~gone & F.col(value).isNull(), "setNull")
            .otherwise("set")
            .alias("op"),
            "path",
            F.col(value).alias("value"),
            F.lit(None).cast("int").alias("length"),
        )
        return changes.unionByName(
            sizes.select(
                "doc_id", F.lit("setLength").alias("op"), "path", F.lit(None).cast("string").alias("value"),
                F.coalesce(F.col(length), F.lit(0)).alias("length"),
            )
        )

    return patch("__a", "__in_a", "length"), patch("__b", "__in_b", "__lb")


def apply_patch(leaves: DataFrame, patch: DataFrame) -> DataFrame:
    """Snapshot after a patch: touched leaves are replaced (by null too) or dropped,
    array elements from the new length on are dropped."""
    touched = patch.where("op in ('set', 'setNull', 'delete')").select("doc_id", "path")
    kept = leaves.join(touched, ["doc_id", "path"], "left_anti")
    placed = patch.where("op = 'set' and value is not null or op = 'setNull'").select("doc_id", "path", "value")
    rows = kept.unionByName(placed).withColumns(
        {"__parent": F.slice("path", F.lit(1), F.size("path") - 1), "__i": _index(F.element_at("path", -1))}
    )
    cuts = patch.where("op = 'setLength'").select("doc_id", F.col("path").alias("__parent"), F.col("length").alias("__len"))
    return (
        rows.join(cuts, ["doc_id", "__parent"], "left")
        .where("__i is null or __len is null or __i < __len")
        .select("doc_id", "path", "value")
    )


def validate_document(derived: DataFrame, stored: DataFrame, fields: list[str], key: str = "project_id") -> DataFrame:
    """Names of the fields whose JSON differs between two documents."""
    def text(side: str, f: str) -> Column:
        return F.to_json(F.struct(F.col(f"{side}.{f}").alias("v")), {"ignoreNullFields": "false"})

    joined = derived.alias("d").join(stored.alias("s"), key, "left")
    wrong = F.array_compact(F.array(*[F.when(text("d", f) != text("s", f), F.lit(f)) for f in fields]))
    return joined.select(key, wrong.alias("mismatches"), (F.size(wrong) == 0).alias("ok"))
