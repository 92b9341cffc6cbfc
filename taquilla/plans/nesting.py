"""Child rows beside their parent: one row per child, in one shape whatever their number.

Nested documents of the original come as rows. A parent that owns a large share of the whole
child table has that many rows, spread over tasks; nothing builds an array of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """A row per child with its parent's columns; a parent without children is one row.

    Not a left join: of an inner join the children of a hot parent can be split over tasks.
    """
    known = children.select(key).distinct()
    childless = parents.join(known, key, "left_anti")
    return parents.join(children, key).unionByName(childless, allowMissingColumns=True)


def with_totals(children: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Children with aggregates over all children of the same keys; keys may be NULL.

    The second key is 0 on every row. It makes Spark shuffle the folded totals for the join
    by themselves, so that the children of a hot key can be split over tasks.
    """
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    folded = (
        children.groupBy(*keys)
        .agg(*[total.alias(name) for name, total in totals.items()])
        .select(*[F.col(k).alias(f"of_{k}") for k in keys], *totals)
        .withColumn("of_zero", F.pmod(F.xxhash64(*[f"of_{k}" for k in keys]), F.lit(1)))
    )
    same = F.col("zero") == F.col("of_zero")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return (
        children.withColumn("zero", zero)
        .join(folded, same)
        .drop("zero", "of_zero", *[f"of_{k}" for k in keys])
    )
