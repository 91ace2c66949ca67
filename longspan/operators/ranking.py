"""Running sums, quantiles and ranks over a whole table without one task per table.

A window with no partition key, or with a key that holds a third of the rows, would send them to one
task. Here rows are dealt into ranges of (key, order) and written once with their range; sums within
a range are a window per range, and what lies before a range is carried over from the ranges' totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from longspan.sources.stages import stage

HASH_BUCKET_DIGITS = 4


def in_ranges(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows dealt into ranges of `columns`, written once with the number of their range, `_part`.

    Ranges come from Spark's sample of the columns, so they are of about equal size and a key may
    reach over several. `parts` defaults to the session's shuffle partitions.
    """
    dealt = df.repartitionByRange(*([parts] if parts else []), *columns)
    return stage(dealt.withColumn("_part", F.spark_partition_id()), "ranged")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    sums: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """For rows unique by (keys, order): `<s>_before`, `<s>_total` and, for one order column, `next_<order>`.

    `<s>_before` sums the rows with a smaller order value. The totals are one row for each range and
    key in it, so they number the keys plus the ranges at most. Nulls order first; keys are not null.
    """
    keys, orders = list(keys), [order] if isinstance(order, str) else list(order)
    following = isinstance(order, str)
    placed = in_ranges(df, [*keys, *orders], parts)
    place = [*keys, "_part"]
    totals = placed.groupBy(*place).agg(F.min(orders[0]).alias("_low"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    across, whole = W.partitionBy(*keys).orderBy("_part"), W.partitionBy(*keys)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *place,
        F.lead("_low").over(across).alias("_next_low"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    within = W.partitionBy(*place).orderBy(*orders)
    before = within.rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns({f"_in_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
    if following:
        local = local.withColumn("_next_in", F.lead(order).over(within))
    out = local.join(offsets, place).withColumns({f"{s}_before": F.col(f"_in_{s}") + F.col(f"_off_{s}") for s in sums})
    if following:
        out = out.withColumn(f"next_{order}", F.coalesce("_next_in", "_next_low"))
    return out.drop(
        "_part", "_next_in", "_next_low", *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums]
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, one row per key.

    Gives an array column `quantiles`. Equal values are counted first, so the work after the
    shuffle is per distinct value.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n")
    )
    ranked = running_sums(counts, keys, value, ["_n"])
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    picks, aggregates = [], []
    for p in probabilities:
        place = (F.col("_n_total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        value_low = F.max(F.when((low >= first) & (low <= last), F.col(value)))
        value_high = F.max(F.when((high >= first) & (high <= last), F.col(value)))
        part = F.max(place - low)
        aggregates.append((value_low, value_high, part))
    for k, (a, b, part) in enumerate(aggregates):
        picks += [a.alias(f"_a{k}"), b.alias(f"_b{k}"), part.alias(f"_p{k}")]
    row = ranked.groupBy(*keys).agg(*picks)
    values = [
        F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * F.col(f"_p{k}")
        for k in range(len(probabilities))
    ]
    return row.select(*keys, F.array(*[v.cast("double") for v in values]).alias("quantiles"))


def hash_sample(df: DataFrame, key: str, seed: int, fraction: float, name: str) -> DataFrame:
    """Mark rint(fraction * rows) rows as picked, in column `name`.

    Rows are ranked by the md5 of a unique key and the seed, so the pick depends on these only and
    not on partitions, run order or engine. The leading digits form even buckets; their counts
    tell in which bucket the quota runs out, only that bucket is sorted, and the rows themselves
    are marked where they are by comparing with the last picked hash.
    """
    code = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    bucket = F.substring(code, 1, HASH_BUCKET_DIGITS)
    hashed = df.select(code.alias("_hash"), F.col(key).alias("_key"), bucket.alias("_bucket"))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # At most 16**HASH_BUCKET_DIGITS rows, so one window over all of them is bounded.
    running = F.sum("_rows").over(W.orderBy("_bucket"))
    quota = F.rint(F.sum("_rows").over(W.partitionBy()) * F.lit(float(fraction)))
    last = (
        counts.select("_bucket", "_rows", running.alias("_upto"), quota.alias("_quota"))
        .where((F.col("_quota") <= F.col("_upto")) & (F.col("_quota") > F.col("_upto") - F.col("_rows")))
        .select("_bucket", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_need"))
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", "_key"))
    edge = (
        hashed.join(F.broadcast(last), "_bucket")
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_need"))
        .agg(F.max(F.struct("_bucket", "_hash", "_key")))
    )
    mine = F.struct(bucket, code, F.col(key))
    return df.withColumn(name, F.coalesce(mine <= edge.scalar(), F.lit(False)))


def dense_ids(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Ids 1..n in the order of a unique key.

    Rows are dealt into ranges of the key and written once with their range; they are numbered
    within it, and the ranges' counts, one row for each task, give the offsets.
    """
    ranged = in_ranges(df, [key])
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = counts.select(
        "_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before")
    )
    within = W.partitionBy("_part").orderBy(key)
    return (
        ranged.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_place")).cast("int"))
        .drop("_part", "_place", "_before")
    )
