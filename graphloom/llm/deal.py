"""Joins of a table with another that has one row for each key, when some keys are hot."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No (key, part) of a join has more rows than this share of the table; so no more than this many keys are hot.
HOTS = 2048
#: Nor is a key hot that has fewer rows.
FEW = 4096


def dealt(many: DataFrame, one: DataFrame, on: list[str], n: str, total: int, how: str = "inner", once: bool = False) -> DataFrame:
    """many.join(one, on, how) by a shuffle of both, with the rows of hot keys dealt into parts.

    one: a written table with one row for each key, of which the column `n` has the number of
    rows in `many`, whose columns must not clash but for `on`; total: rows of `many`. The list
    of hot keys is broadcast: at most HOTS rows, whatever the data. once: whether to return only
    distinct rows; equal ones meet in a part, so this needs no other shuffle.
    """
    most = max(FEW, -(-total // HOTS))
    parts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = one.where(F.col(n) > most).select(*on, parts.alias("_parts"))
    left = many.join(F.broadcast(hot), on, "left")
    rest = [c for c in many.columns if c not in on] or on
    null = reduce(or_, (F.col(c).isNull() for c in on))  # finds no partner: anywhere will do
    left = left.withColumn("_part", F.pmod(F.xxhash64(*rest), F.when(null, F.lit(HOTS)).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")).drop("_parts")
    right = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col(n) > most, parts).otherwise(1) - 1))))
    made = left.join(right.hint("merge"), [*on, "_part"], how)
    return (made.distinct() if once else made).drop("_part")
