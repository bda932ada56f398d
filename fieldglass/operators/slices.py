"""Ordered work inside groups without giving a whole group to one task.

A group (one API key, one execution, one document type) may hold a large share of
all rows, and a plain window over it runs in a single task. These operators cut
each group into consecutive slices of its own order (a second, an hour, a block of
ids), work inside the slices, and connect the slices through a small per-slice
summary. The result is the same as that of the plain window.

Group keys and slice travel as one struct, ``__at``. Structs with null members
compare as equal, so null keys form a group like any other, and because the
aggregate, the join and the window all hash the same column, the rows are shuffled
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = "__at"


def place(df: DataFrame, keys: list[str], slice_by: Column) -> DataFrame:
    """Adds the struct of group keys and slice."""
    return df.withColumn(AT, F.struct(*[F.col(k).alias(k) for k in keys], slice_by.alias("slice")))


def group_of(keys: list[str]) -> list[Column]:
    return [F.col(f"{AT}.{k}") for k in keys]


def attach_summary(rows: DataFrame, summary: DataFrame, values: list[str], how: str = "left") -> DataFrame:
    """Join per-slice values to the rows of their slice."""
    return rows.join(summary.select(AT, *values), AT, how)


def ordinal_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    name: str = "ordinal",
) -> DataFrame:
    """``row_number`` over (keys order by order), computed slice by slice.

    ``slice_by`` must not decrease along ``order`` inside a group. The per-slice
    counts are aggregated map-side first; only they are seen per group.
    """
    placed = place(df, keys, slice_by)
    counts = placed.groupBy(AT).agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy(*group_of(keys))
        .orderBy(f"{AT}.slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    local = Window.partitionBy(AT).orderBy(*order)
    return (
        attach_summary(placed, offsets, ["__before"])
        .withColumn(name, F.col("__before") + F.row_number().over(local))
        .drop("__before", AT)
    )


def lag_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    value: str,
    name: str = "previous",
) -> DataFrame:
    """``lag(value)`` over (keys order by order), computed slice by slice.

    Adds ``name`` and the flag ``has_previous``, which tells a null value from no row.
    """
    placed = place(df, keys, slice_by)
    boxed = F.struct(F.col(value).alias("v"))
    last = placed.groupBy(AT).agg(F.max_by(boxed, F.struct(*order)).alias("__last"))
    by_slice = Window.partitionBy(*group_of(keys)).orderBy(f"{AT}.slice")
    carried = last.withColumn("__carry", F.lag("__last").over(by_slice))
    local = Window.partitionBy(AT).orderBy(*order)
    return (
        attach_summary(placed, carried, ["__carry"])
        .withColumn("__prev", F.coalesce(F.lag(boxed).over(local), F.col("__carry")))
        .withColumn(name, F.col("__prev")["v"])
        .withColumn("has_previous", F.col("__prev").isNotNull())
        .drop("__prev", "__carry", AT)
    )


def header_and_items(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    totals: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A list per group as two tables: one header per group, one row per item.

    Headers hold ``items``, the number of items, and the given totals; item rows have their
    ``position`` from 1. What a row means does not depend on how long a list is.
    """
    summed = {"items": F.count(F.lit(1)), **(totals or {})}
    header = df.groupBy(*keys).agg(*[v.alias(n) for n, v in summed.items()])
    return header, ordinal_in_group(df, keys, order, slice_by, "position")


def chunked_lists(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    item: Column,
    name: str,
    chunk_rows: int = 1000,
) -> DataFrame:
    """Ordered list of ``item`` per group, in chunks of at most ``chunk_rows``.

    Rows are (keys, chunk, name). A group that fits has exactly one row with chunk
    0; concatenating the chunks in order gives the whole list of a larger one.
    """
    numbered = ordinal_in_group(df.withColumn("__item", item), keys, order, slice_by, "__n")
    chunk = F.floor((F.col("__n") - 1) / chunk_rows).cast("int")
    lists = numbered.groupBy(*keys, chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("__n", "__item"))).alias("__list")
    )
    return lists.select(
        *keys, "chunk", F.transform("__list", lambda e: e["__item"]).alias(name)
    )


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (middle value, or mean of the two middle values).

    Works on the histogram of distinct values, which shrinks map-side. Values are
    cut into narrow bands by a monotone function; the bands that hold the middle
    ranks are found from band counts, and only those bands are ordered.
    """
    hist = place(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n")),
        keys,
        F.floor(F.signum("__v") * F.log1p(F.abs("__v")) * 256),
    )
    bands = hist.groupBy(AT).agg(F.sum("__n").alias("__bn"))
    ordered = Window.partitionBy(*group_of(keys)).orderBy(f"{AT}.slice")
    whole = Window.partitionBy(*group_of(keys))
    wanted = (
        bands.withColumn("__upto", F.sum("__bn").over(ordered))
        .withColumn("__total", F.sum("__bn").over(whole))
        .withColumn("__before", F.col("__upto") - F.col("__bn"))
        .withColumn("__lo", F.floor((F.col("__total") + 1) / 2))
        .withColumn("__hi", F.floor(F.col("__total") / 2) + 1)
        .filter((F.col("__before") < F.col("__hi")) & (F.col("__upto") >= F.col("__lo")))
    )
    inside = attach_summary(hist, wanted, ["__before", "__lo", "__hi"], "inner")
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(AT).orderBy("__v"))
    ranked = inside.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__n"))

    def holds(rank: str) -> Column:
        return (F.col("__from") < F.col(rank)) & (F.col("__upto") >= F.col(rank))

    low = F.max(F.when(holds("__lo"), F.col("__v")))
    high = F.max(F.when(holds("__hi"), F.col("__v")))
    return ranked.groupBy(*keys).agg(((low + high) / 2).alias(name))


def join_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Left outer join of parents with many children each.

    The plan of an outer join cannot split a busy key on its null-supplying side,
    that of an inner join can. So matching rows come from an inner join, and parents
    without children are added from an anti join against the distinct child keys.
    The narrow sides, parents and distinct keys, are hashed, so no task sorts its children:
    its memory follows the parents in a partition, and busy keys can still be split.
    """
    keyed = children.withColumnRenamed(child_key, "__child")
    hashed = parents.hint("shuffle_hash")
    matched = hashed.join(keyed, parents[parent_key] == keyed["__child"]).drop("__child")
    seen = keyed.select("__child").distinct().hint("shuffle_hash")
    alone = parents.join(seen, parents[parent_key] == seen["__child"], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
