"""The first ordered difference of two outputs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import kind, ordered_keys
from ..functions.identity import row_text
from ..functions.pointer import escape


def first_difference(left: Any, right: Any, path: str = "") -> dict[str, str] | None:
    """{path, reason}, or None when equal: kinds first, then shape, then contents in order."""
    a, b = kind(left), kind(right)
    if a != b:
        return {"path": path, "reason": "type"}
    if a == "array":
        if len(left) != len(right):
            return {"path": path, "reason": "array_length"}
        steps = [(str(i), x, y) for i, (x, y) in enumerate(zip(left, right))]
    elif a == "object":
        names = ordered_keys(list(left))
        if set(left) != set(right):
            return {"path": path, "reason": "object_keys"}
        if names != ordered_keys(list(right)):
            return {"path": path, "reason": "object_order"}
        steps = [(k, left[k], right[k]) for k in names]
    else:
        return None if left == right else {"path": path, "reason": "value"}
    for name, x, y in steps:
        if found := first_difference(x, y, f"{path}/{escape(name)}"):
            return found
    return None


def first_table_difference(left: DataFrame, right: DataFrame, order: list[str] | None = None) -> dict[str, str] | None:
    """The same for tables: schema, then rows by key, or as bags where there is no order.

    Rows meet in one full outer join on the key (or on the row's hash with its
    count) and the least differing one comes back.
    """
    if left.schema != right.schema:
        return {"path": "", "reason": "schema"}
    if order:
        rest = [c for c in left.columns if c not in order]
        sides = [d.select(*order, F.struct(F.lit(1).alias("there"), *rest).alias(n)) for d, n in ((left, "l"), (right, "r"))]
        both = sides[0].join(sides[1], order, "full").where(~F.col("l").eqNullSafe(F.col("r")))
        both = both.withColumn("field", F.when(F.col("l").isNull() | F.col("r").isNull(), "").otherwise(F.get(F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in rest])), F.lit(0))))
        row = both.orderBy(*order).select(F.to_json(F.struct(*order)).alias("key"), "field").first()
        return None if row is None else {"path": f"/{row.key}/{escape(row.field)}" if row.field else f"/{row.key}", "reason": "value" if row.field else "row"}
    bags = [d.select(F.sha2(row_text(d), 256).alias("h")).groupBy("h").agg(F.count("*").alias(n)) for d, n in ((left, "nl"), (right, "nr"))]
    row = bags[0].join(bags[1], "h", "full").where(~F.col("nl").eqNullSafe(F.col("nr"))).orderBy("h").first()
    return None if row is None else {"path": f"/{row.h}", "reason": "row"}
