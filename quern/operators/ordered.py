"""Order-dependent operators for keys of any size.

A window over a key runs each key in one task. Here the rows of a key are first spread by range over
partitions, so a key that holds a third of the table becomes many fragments; the windows run inside a
fragment, and only one row per fragment is exchanged to join the fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quern.session import cut_lineage, estimated_bytes

FRAGMENT = "__fragment"
#: Bytes of a result that one fragment should hold.
FRAGMENT_BYTES = 128 << 20


#: So many keys at most are sent to every task.
SENT_KEYS = 1_000_000


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per key. Only rows whose key comes more than once are moved; all others stay where and in the order they lie.

    Should more than ``SENT_KEYS`` keys come more than once, they are joined by a shuffle instead of being sent
    to the tasks. Rows without a key are one row, as ``dropDuplicates`` has it.
    """
    again = cut_lineage(rows.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__again")))
    again = F.broadcast(again) if again.count() <= SENT_KEYS else again
    same = rows[key].eqNullSafe(again["__again"])
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key]))


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows with a table that has one row per key, where a key may hold a third of the rows.

    The rows of a key are spread over ``salts`` tasks by their content, and its one row is sent to each.
    """
    own = [f.name for f in rows.schema.fields if f.name not in keys and not isinstance(f.dataType, t.MapType)]
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in own]), F.lit(salts)).cast("int"))
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def hot_join(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", share: float = 0.001) -> DataFrame:
    """Join rows with a large table that has one row per key, where a key may hold a third of the rows.

    Keys with more than ``share`` of the rows, at most ``1 / share`` of them, are sent to the rows; the others
    are shuffled. ``how`` is inner or left.
    """
    counts = cut_lineage(rows.groupBy(*keys).count())
    least = share * (counts.agg(F.sum("count")).first()[0] or 0)
    hot = F.broadcast(per_key.join(F.broadcast(counts.filter(F.col("count") > least).select(*keys)), keys, "left_semi"))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(per_key, keys, how)
    return rows.join(hot, keys).unionByName(cold)


def fragment(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Add the number of the range fragment of every row and fix it.

    Fragment numbers rise with (keys, order). The result is cut from its lineage, because range bounds
    are sampled and a second evaluation could place rows differently. Their number grows with the estimated size.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(least, -(-(estimated_bytes(df) or 0) // FRAGMENT_BYTES))
    spread = df.repartitionByRange(n, *[F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]])
    return cut_lineage(spread.withColumn(FRAGMENT, F.spark_partition_id()))


def lag_rows(fragmented: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the preceding row of the same key in ``order``, or null for the first row.

    Takes the output of ``fragment``. Ties in ``order`` are the caller's to break. A null key is a key.
    """
    inside = Window.partitionBy(FRAGMENT, *keys).orderBy(*order)
    rows = fragmented.withColumn("__v", F.struct(value.alias("v"))).withColumn(name, F.lag("__v").over(inside))
    tails = fragmented.groupBy(FRAGMENT, *keys).agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("__tail"))
    along = Window.partitionBy(*keys).orderBy(FRAGMENT)
    heads = tails.select(FRAGMENT, *keys, F.lag("__tail").over(along).alias("__before")).filter("__before is not null")
    match = [F.col(f"r.{FRAGMENT}") == F.col(f"h.{FRAGMENT}"), *[F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys]]
    joined = rows.alias("r").join(heads.alias("h"), match, "left")
    return joined.select(
        *[F.col(f"r.`{c}`") for c in fragmented.columns],
        F.coalesce(F.col(f"r.`{name}`"), F.col("h.__before"))["v"].alias(name),
    )


def rank_rows(fragmented: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of every row within its key in ``order``, for keys of any size."""
    inside = Window.partitionBy(FRAGMENT, *keys).orderBy(*order)
    sizes = fragmented.groupBy(FRAGMENT, *keys).count()
    along = Window.partitionBy(*keys).orderBy(FRAGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(FRAGMENT, *keys, F.coalesce(F.sum("count").over(along), F.lit(0)).alias("__start"))
    match = [F.col(f"r.{FRAGMENT}") == F.col(f"h.{FRAGMENT}"), *[F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys]]
    rows = fragmented.withColumn("__in", F.row_number().over(inside) - 1)
    return rows.alias("r").join(starts.alias("h"), match).select(
        *[F.col(f"r.`{c}`") for c in fragmented.columns], (F.col("h.__start") + F.col("r.__in")).alias(name)
    )


def carry_rows(fragmented: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last ``value`` that is not null in the rows before, or null; an as-of look back for keys of any size."""
    inside = Window.partitionBy(FRAGMENT, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = fragmented.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    tails = fragmented.groupBy(FRAGMENT, *keys).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("__tail"))
    along = Window.partitionBy(*keys).orderBy(FRAGMENT).rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(FRAGMENT, *keys, F.last("__tail", ignorenulls=True).over(along).alias("__before")).filter("__before is not null")
    match = [F.col(f"r.{FRAGMENT}") == F.col(f"h.{FRAGMENT}"), *[F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys]]
    joined = rows.alias("r").join(heads.alias("h"), match, "left")
    return joined.select(*[F.col(f"r.`{c}`") for c in fragmented.columns], F.coalesce(F.col(f"r.`{name}`"), F.col("h.__before")).alias(name))


def trailing_rows(ranked: DataFrame, keys: list[str], rank: str, value: Column, size: int, name: str, block: int = 4096) -> DataFrame:
    """Values of the ``size`` rows up to and with each row, oldest first, for keys of any size.

    ``ranked`` has the 0-based position of each row in its key (``rank_rows``). Keys are cut into blocks
    of rows; the last ``size - 1`` rows of a block are also sent to the next as its context.
    """
    own = F.floor(F.col(rank) / block)
    lends = (F.col(rank) % block) > block - size
    blocks = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    spread = ranked.withColumn("__own", own).withColumn("__v", F.struct(value.alias("v"))).withColumn("__block", F.explode(blocks))
    frame = Window.partitionBy(*keys, "__block").orderBy(rank).rowsBetween(-(size - 1), 0)
    filled = spread.withColumn(name, F.collect_list("__v").over(frame)).filter("__block = __own")
    return filled.select(*ranked.columns, F.col(name)["v"].alias(name))


def group_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Count, mean and exact percentiles by linear interpolation, for groups of any size.

    Values are ranked by range instead of being gathered in one task. Null values are left out; a group
    without values has no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    ranked = rank_rows(fragment(rows, keys, ["__x"]), keys, ["__x"], "__rank")
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.avg("__x").alias("mean"))
    match = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys] or [F.lit(True)]
    both = ranked.alias("r").join(F.broadcast(totals.alias("t")) if not keys else totals.alias("t"), match)
    both = both.select(*[F.col(f"t.`{k}`") for k in keys], "__n", "mean", "__x", "__rank")
    parts = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * F.lit(share)
        low, weight = F.floor(at), at - F.floor(at)
        high = F.least(low + 1, F.col("__n") - 1)
        lower = F.max(F.when(F.col("__rank") == low, F.col("__x")))
        upper = F.max(F.when(F.col("__rank") == high, F.col("__x")))
        parts.append((lower + (upper - lower) * F.max(weight)).alias(name))
    return both.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("mean").alias("mean"), *parts)
