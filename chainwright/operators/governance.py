"""Leakage audits, ledgers, cohort freezes and fingerprints, all as issue or evidence frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainwright.functions.sequence import date_gate, seq_digest
from chainwright.operators.filters import violations
from chainwright.operators.joins import join_1to1


def exposure_ledger(events: DataFrame, key: str, reason: str, flags: dict[str, Column]) -> DataFrame:
    """Per id: every flag OR-ed, the sorted reasons and the number of events."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.bool_or(c).alias(n) for n, c in flags.items()],
        F.array_join(F.array_sort(F.collect_set(reason)), "|").alias("reasons"),
    )


def audit_predictions(predictions: DataFrame, targets: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """How each prediction is out of fold: by date, by an exclusion list, or a violation."""
    listed = exclusions.select("model", key).distinct().withColumn("_listed", F.lit(True))
    joined = predictions.join(targets, key, "left").join(listed, ["model", key], "left")
    dated = date_gate(F.col("training_cutoff"), F.col("target_date"))
    return joined.withColumn("mode", F.when(dated, "date").when(F.col("_listed"), "explicit_exclusion").otherwise("violation")).drop("_listed")


def audit_templates(templates: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Each template's status: released before its target and not of the target's own entry."""
    joined = templates.join(targets, key, "left")
    safe = date_gate(F.col("release_date"), F.col("target_date"))
    own = F.upper("entry") == F.upper("own_entry")
    return joined.withColumn("status", F.when(~safe, "not_temporal").when(own, "direct_self").otherwise("ok"))


def freeze_cohort(manifest: DataFrame, status: DataFrame, key: str, seq: str, digest: str, length: str) -> DataFrame:
    """Issues of a final cohort: status, and re-verified digest and length, after a one-to-one join."""
    joined = join_1to1(manifest, status, [key])
    return violations(
        joined,
        [key],
        {
            "status": F.col("status") == "PASS",
            "digest": F.col(digest) == seq_digest(F.col(seq)),
            "length": F.col(length) == F.length(seq),
        },
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint of a frame: rows and two wrapped sums of row hashes."""
    row = F.xxhash64(*df.columns)
    again = F.xxhash64(F.lit(1), *df.columns)
    wrapped = lambda c: F.sum(F.pmod(c, F.lit(2**31 - 1)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(wrapped(row), F.lit(0)).alias("sum_a"), F.coalesce(wrapped(again), F.lit(0)).alias("sum_b"))


def verify(df: DataFrame, receipt: DataFrame) -> DataFrame:
    """Compare a frame's fingerprint with an earlier one."""
    now = fingerprint(df).withColumn("_r", receipt.select(F.struct("rows", "sum_a", "sum_b")).scalar())
    same = (F.col("rows") == F.col("_r.rows")) & (F.col("sum_a") == F.col("_r.sum_a")) & (F.col("sum_b") == F.col("_r.sum_b"))
    return now.select("rows", F.col("_r.rows").alias("receipt_rows"), same.alias("matches"))


def library_manifest(points: DataFrame, chain: str, expected: DataFrame) -> DataFrame:
    """Per chain: points, resolved points, an order-independent digest and whether the length fits.

    Each point is hashed with its position, so the sum needs no ordered collection.
    """
    micro = lambda c: F.coalesce(F.round(F.col(c) * 1000).cast("long").cast("string"), F.lit("-"))
    mark = F.md5(F.concat_ws("|", F.col("pos").cast("string"), micro("x"), micro("y"), micro("z")))
    summary = points.groupBy(chain).agg(
        F.count(F.lit(1)).alias("points"), F.count("x").alias("resolved"), F.sum(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")).alias("digest")
    )
    return summary.join(expected, chain, "left").withColumn("length_ok", F.col("points") == F.col("length")).drop("length")


def flatten(df: DataFrame, key: str) -> DataFrame:
    """(path, number, text) per scalar field; the path starts with the key."""
    fields = [
        F.struct(
            F.concat(F.col(key).cast("string"), F.lit(f".{n}")).alias("path"),
            (F.lit(None).cast("double") if t == "string" else F.col(n).cast("double")).alias("number"),
            F.col(n).cast("string").alias("text"),
        )
        for n, t in df.dtypes
        if n != key
    ]
    return df.select(F.inline(F.array(*fields)))


def diff(a: DataFrame, b: DataFrame, tolerance: float, ignore: Sequence[str] = ()) -> DataFrame:
    """Paths that differ between two flattened results: kind and absolute error."""
    skip = lambda df: df.where(~F.substring_index("path", ".", -1).isin(*ignore)) if ignore else df
    left = skip(a).select("path", F.col("number").alias("_na"), F.col("text").alias("_ta"), F.lit(True).alias("_a"))
    right = skip(b).select("path", F.col("number").alias("_nb"), F.col("text").alias("_tb"), F.lit(True).alias("_b"))
    joined = left.join(right, "path", "full")
    error = F.abs(F.col("_na") - F.col("_nb"))
    kind = (
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "added")
        .when(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), F.when(error > tolerance, "number"))
        .when(~F.col("_ta").eqNullSafe(F.col("_tb")), "value")
    )
    return joined.select("path", kind.alias("kind"), error.alias("error")).where(F.col("kind").isNotNull())


def check_split(df: DataFrame, target: str, split: str, date: str, group: str, order: Sequence[str]) -> DataFrame:
    """Violations of a split: repeated targets, groups across splits, dates out of order."""
    repeated = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.lit("repeated target").alias("rule"), F.col(target).cast("string").alias("subject"))
    spans = df.groupBy(group).agg(F.min(split).alias("_l"), F.max(split).alias("_h")).where(F.col("_l") != F.col("_h")).select(F.lit("group spans splits").alias("rule"), F.col(group).cast("string").alias("subject"))
    ranges = df.groupBy(split).agg(F.min(date).alias("_min"), F.max(date).alias("_max"))
    wide = ranges.agg(*[F.max(F.when(F.col(split) == s, F.col(f"_{e}"))).alias(f"{s}_{e}") for s in order for e in ("min", "max")])
    checks = F.array(*[F.struct(F.lit("date order").alias("rule"), F.lit(f"{a}>{b}").alias("subject"), (F.col(f"{a}_max") >= F.col(f"{b}_min")).alias("bad")) for a, b in zip(order, order[1:])])
    dates = wide.select(F.inline(checks)).where("bad").drop("bad")
    return repeated.unionByName(spans).unionByName(dates)


def dedup_score(df: DataFrame, digest: Column, inputs: Sequence[str], score) -> DataFrame:
    """Score each distinct input once and join the value back to every row.

    ``score`` maps a frame (digest, *inputs) to (digest, value).
    """
    tagged = df.withColumn("_digest", digest)
    distinct = tagged.groupBy("_digest").agg(*[F.any_value(c).alias(c) for c in inputs])
    return tagged.join(score(distinct).select("_digest", "value"), "_digest").drop("_digest")
