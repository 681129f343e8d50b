"""Adding computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def settle(df: DataFrame, kept: list[str], new: dict[str, Column]) -> DataFrame:
    """Keep some columns and add new ones that are computed exactly once.

    Spark moves a filter on a computed column below the projection and then
    evaluates the expression again for it, patterns included; over several steps
    that multiplies. Output of a generator is not moved, and a generator over a
    one-element array costs next to nothing.

    The values are computed by a projection below the generator: projections are
    compiled and share what their expressions have in common, generators are
    interpreted where the fused code is too large to be compiled.
    """
    held = {name: f"_settled_{i}_{name}" for i, name in enumerate(new)}
    df = df.select(*kept, *[value.alias(held[name]) for name, value in new.items()])
    row = F.struct(*[F.col(f"`{held[name]}`").alias(name) for name in new])
    return df.select(*kept, F.inline(F.array(row)))


def settle_present(df: DataFrame, kept: list[str], out: str, items: list[Column], dtype: T.StructType) -> DataFrame:
    """Keep some columns and add the array of those items that are not null, in order.

    Leaving out nulls is a function that Spark interprets, with all that its argument holds; so
    the items are computed by a projection, and only their columns are looked at above it."""
    names = [f"_item_{i}" for i in range(len(items))]
    df = df.select(*kept, *[item.cast(dtype).alias(name) for item, name in zip(items, names)])
    found = F.array_compact(F.array(*names)) if names else F.array().cast(T.ArrayType(dtype))
    return df.select(*kept, F.inline(F.array(F.struct(found.alias(out)))))
