"""Ordering, ranking and neighbour lookups that never put one key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task, so a key
that holds a third of the table becomes the job.  The helpers here split every
key into ordered buckets: the work inside a bucket is a small window, and only
one summary row per bucket takes part in the per-key step.  A NULL key is a
key like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _window(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which NULL equals NULL; the keys appear once, as the left side has them."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, met, how).drop(*[f"_right_{k}" for k in keys])


def order_bucket(value: Column, resolution: int = 256) -> Column:
    """Order-preserving bucket number of a numeric value.

    Square roots and products are correctly rounded, hence monotone, so a larger
    value never falls into a smaller bucket.  The fourth root keeps the number of
    buckets small for wide ranges.
    """
    v = value.cast("double")
    return F.floor(F.signum(v) * F.sqrt(F.sqrt(F.abs(v))) * resolution).cast("long")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    """One row per distinct value of each key: its count, how many rows are smaller, n, and the key's value span.

    Counting comes first (map-side combine), so copies of a value cost one row.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("_bucket", order_bucket(F.col(value)) if bucket is None else bucket)
    )
    per_bucket = counted.groupBy(*keys, "_bucket").agg(
        F.sum("cnt").alias("_in_bucket"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    prefix = per_bucket.select(
        *keys,
        "_bucket",
        (F.sum("_in_bucket").over(_window(keys).orderBy("_bucket")) - F.col("_in_bucket")).alias("_ahead"),
        F.sum("_in_bucket").over(_window(keys)).alias("n"),
        (F.max("_high").over(_window(keys)) - F.min("_low").over(_window(keys))).alias("span"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return join_on(counted, prefix, [*keys, "_bucket"]).select(
        *keys,
        value,
        "cnt",
        (F.col("_ahead") + F.sum("cnt").over(inside) - F.col("cnt")).alias("before"),
        "n",
        "span",
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], bucket: Column | None = None
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, named by ``wanted``; also ``n``."""
    ranked = value_ranks(df, keys, value, bucket)
    start, stop = F.col("before"), F.col("before") + F.col("cnt")
    aggregates = []
    for name, p in wanted.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        v_low = F.max(F.when((start <= low) & (low < stop), F.col(value)))
        v_high = F.max(F.when((start <= high) & (high < stop), F.col(value)))
        aggregates.append((v_low + (v_high - v_low) * F.max(at - low)).alias(name))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggregates)


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach the tie-averaged rank (1-based) of ``value`` inside each key, with ``<name>_n`` and ``<name>_span``."""
    rank = F.col("before") + (F.col("cnt") + 1) / 2
    ranks = value_ranks(df, keys, value).select(
        *keys, value, rank.alias(name), F.col("n").alias(f"{name}_n"), F.col("span").alias(f"{name}_span")
    )
    return join_on(df, ranks, [*keys, value], "left")


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "pos", total: str | None = None
) -> DataFrame:
    """0-based dense position of each row of a key in a total order.

    ``bucket`` must not decrease along ``order`` (a day for timestamps, a range
    for numbers); only bucket counts are ordered per key.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    prefix = counts.select(
        *keys,
        "_bucket",
        (F.sum("_in_bucket").over(_window(keys).orderBy("_bucket")) - F.col("_in_bucket")).alias("_ahead"),
        *([F.sum("_in_bucket").over(_window(keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        join_on(tagged, prefix, [*keys, "_bucket"])
        .withColumn(name, (F.col("_ahead") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_ahead")
    )


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Join per-key aggregates back to the rows.

    Pre-aggregated (map-side combine) and joined, instead of a whole-key window;
    the adaptive planner broadcasts the result or splits a skewed key by measured size.
    """
    return join_on(df, df.groupBy(*keys).agg(*aggregates), list(keys))


def at_offsets(
    df: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str], offsets: Iterable[int], block: int = BLOCK
) -> DataFrame:
    """Attach ``n<offset>`` structs holding ``payload`` of the row numbered ``pos + offset``.

    The row is found by number, so a numbering break gives NULL.  Keys are cut
    into blocks of ``block`` positions; rows near an edge are copied to the next
    block, so a task sees at most ``block + 2 * reach`` positions of a key.
    """
    offsets = sorted(set(offsets))
    reach = max(abs(o) for o in offsets)
    home = F.floor(F.col(pos) / block)
    spread = df.withColumn(
        "_block",
        F.explode(
            F.array_distinct(
                F.array(home, F.floor((F.col(pos) - reach) / block), F.floor((F.col(pos) + reach) / block))
            )
        ),
    )
    order = Window.partitionBy(*keys, "_block").orderBy(pos)
    item = F.struct(*payload)
    found = [F.max(item).over(order.rangeBetween(o, o)).alias(offset_name(o)) for o in offsets]
    return spread.select(*df.columns, "_block", *found).where(F.col("_block") == home).drop("_block")


def offset_name(offset: int) -> str:
    return f"n{'m' if offset < 0 else 'p'}{abs(offset)}"


def nearest(
    df: DataFrame, keys: Sequence[str], pos: str, hit: Column, payload: Sequence[str] = (), block: int = BLOCK,
    before: str = "prev", after: str = "next",
) -> DataFrame:
    """Attach the closest earlier and later rows of the same key that satisfy ``hit``.

    Each is a struct ``(at, *payload)`` or NULL.  One summary row per block carries
    the search across blocks.
    """
    keys = list(keys)
    cut = df.withColumn("_block", F.floor(F.col(pos) / block)).withColumn(
        "_item", F.when(hit, F.struct(F.col(pos).alias("at"), *payload))
    )
    summary = cut.groupBy(*keys, "_block").agg(F.max("_item").alias("_last"), F.min("_item").alias("_first"))
    up = _window(keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    down = _window(keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        "_block",
        F.last("_last", True).over(up).alias("_carry_up"),
        F.last("_first", True).over(down).alias("_carry_down"),
    )
    inside = Window.partitionBy(*keys, "_block")
    up_in = inside.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    down_in = inside.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on(cut, carry, [*keys, "_block"])
        .withColumn(before, F.coalesce(F.last("_item", True).over(up_in), F.col("_carry_up")))
        .withColumn(after, F.coalesce(F.last("_item", True).over(down_in), F.col("_carry_down")))
        .drop("_block", "_item", "_carry_up", "_carry_down")
    )


def spread(key: Column | str, buckets: int, *by: Column | str) -> Column:
    """Deterministic salt for a hot key, from the columns that differ inside it."""
    return F.pmod(F.xxhash64(key, *by), F.lit(buckets)).cast("int")


def over_range(
    df: DataFrame, keys: Sequence[str], pos: str, aggregates: Mapping[str, Column], low: int, high: int, block: int = BLOCK
) -> DataFrame:
    """Aggregates over the rows numbered ``pos + low`` to ``pos + high`` of the same key, in blocks with edges copied."""
    home = F.floor(F.col(pos) / block)
    # A row is needed by the blocks of the rows whose range covers it.
    first, last = F.floor((F.col(pos) - max(high, 0)) / block), F.floor((F.col(pos) - min(low, 0)) / block)
    cut = df.withColumn("_block", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(low, high)
    computed = [a.over(frame).alias(name) for name, a in aggregates.items()]
    return cut.select(*df.columns, "_block", *computed).where(F.col("_block") == home).drop("_block")


def bounded_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The rows unchanged, unless a key holds more than ``limit`` of them: then the job fails.

    The check is a map-side combined count, so an oversized key is found without being gathered.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fits = F.when(F.col("_n") > limit, F.raise_error(F.lit(f"a group holds more than {limit} rows")).cast("long")).otherwise(F.col("_n"))
    return join_on(df, sizes.select(*keys, fits.alias("_n")), list(keys)).where(F.col("_n") > 0).drop("_n")
