"""Ranking, selection, allocation and routing.

``row_number() <= n`` over a key is planned as a group limit on both sides of the
shuffle: a task forwards at most n rows of a key, so a hot key is cut down where
it is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainwright.operators import order as ordering


def topn(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def best_per(df: DataFrame, keys: Sequence[str], preference: Column) -> DataFrame:
    """The row with the smallest preference per key, by aggregation (map-side combine), not by window."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), preference).alias("_r"))
    return chosen.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def gated_hits(hits: DataFrame, query: str, entry: str, bits: str, gate: Column, n: int = 40) -> DataFrame:
    """Best hit per (query, entry), gate applied before ranking, then the first n."""
    best = hits.where(gate).groupBy(query, entry).agg(F.max(bits).alias(bits))
    return topn(best, [query], [F.desc(bits), F.col(entry)], n, rank="rank")


def distinct_topn(df: DataFrame, keys: Sequence[str], entity: str, score: str, key: str, n: int, rank: str = "rank") -> DataFrame:
    """Best row of n distinct entities, then leftovers in rank order until n are found.

    One read of the input: at most n rows of an entity and n rows of a key leave a task.
    """
    by_score = [F.desc(score), F.col(key)]
    by_entity = topn(df, [*keys, entity], by_score, n, rank="_e")
    return topn(by_entity, keys, [F.col("_e") > 1, *by_score], n, rank=rank).drop("_e")


def percentile_cap(df: DataFrame, keys: Sequence[str], score: str, key: str, p: float = 0.8, many: int = 10, cap: int = 50) -> DataFrame:
    """Positive scores; with more than ``many`` only those at or above the percentile; best ``cap``."""
    positive = df.where(F.col(score) > 0)
    cut = ordering.percentiles(positive, keys, score, {"_cut": p}).withColumnRenamed("n", "_n")
    kept = positive.join(cut, list(keys)).where((F.col("_n") <= many) | (F.col(score) >= F.col("_cut"))).drop("_cut", "_n")
    return topn(kept, keys, [F.desc(score), F.col(key)], cap, rank="rank")


def round_robin(df: DataFrame, keys: Sequence[str], source: str, score: str, key: str, preferred: str, n: int) -> DataFrame:
    """Take sources in turn, the preferred one first, each in its own rank order."""
    by_source = topn(df, [*keys, source], [F.desc(score), F.col(key)], n, rank="_depth")
    return topn(by_source, keys, [F.col("_depth"), F.col(source) != preferred, F.col(source)], n, rank="rank").drop("_depth")


def allocate(df: DataFrame, keys: Sequence[str], source: str, score: str, key: str, n_t: int, m_d: int) -> DataFrame:
    """n of source T and m of D per key; missing D slots go to the next T; completeness is marked."""
    keys = list(keys)
    ranked = topn(df.where(F.col(source).isin("T", "D")), [*keys, source], [F.desc(score), F.col(key)], n_t + m_d, rank="_r")
    # At most 2 (n + m) rows per key are left here.
    per_key = Window.partitionBy(*keys)
    have_d = F.least(F.count_if(F.col(source) == "D").over(per_key), F.lit(m_d))
    chosen = ranked.withColumn("_d", have_d).where(
        ((F.col(source) == "D") & (F.col("_r") <= m_d)) | ((F.col(source) == "T") & (F.col("_r") <= n_t + m_d - F.col("_d")))
    )
    return (
        chosen.withColumn("realized_t", F.count_if(F.col(source) == "T").over(per_key))
        .withColumn("realized_d", F.col("_d").cast("long"))
        .withColumn("complete", F.col("realized_t") + F.col("realized_d") == n_t + m_d)
        .withColumnRenamed("_r", "source_rank")
        .drop("_d")
    )


def lock_reference(scores: DataFrame, target: Sequence[str], setting: str, raw: str, reference: str, value: str) -> DataFrame:
    """The reference with the best raw score per target (first of equals), used for every setting."""
    chosen = (
        scores.where(F.col(setting) == raw)
        .groupBy(*target)
        .agg(F.max_by(reference, F.struct(F.col(value), (-F.col(reference)).alias("r"))).alias(reference))
    )
    return scores.join(chosen, [*target, reference])


def order_like(df: DataFrame, sample: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows of ``df`` in the sample's order; the job fails unless both hold the same ids once.

    The ordinal comes with the sample, so no global numbering is needed.
    """
    left = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[c for c in df.columns if c != key])).alias("_r"))
    joined = left.join(sample.select(key, ordinal), key, "full")
    wrong = F.col("_n").isNull() | F.col(ordinal).isNull() | (F.col("_n") > 1)
    checked = joined.withColumn(
        ordinal, F.when(wrong, F.raise_error(F.lit("ids differ from the sample or repeat")).cast("long")).otherwise(F.col(ordinal))
    )
    return checked.select(key, *[F.col("_r")[c].alias(c) for c in df.columns if c != key], ordinal).orderBy(ordinal)


def select_config(summary: DataFrame, keys: Sequence[str], gate: Column, preference: Sequence[Column], name: str) -> DataFrame:
    """Best gated configuration, or the best of all when none passes the gate."""
    flag = F.coalesce(gate, F.lit(False))
    chosen = summary.groupBy(*keys).agg(
        F.min_by(F.col(name), F.struct((~flag).alias("g"), *[p.alias(f"p{i}") for i, p in enumerate(preference)], F.col(name).alias("n"))).alias(name),
        F.bool_or(flag).alias("gate_passed"),
    )
    return chosen


def pad_bank(df: DataFrame, keys: Sequence[str], rank: str, cid: str, n: int) -> DataFrame:
    """Exactly n slots per key: the last member repeats, and repeated slots are marked.

    Works on ranked banks (at most n rows per key take part).
    """
    bank = df.where(F.col(rank) <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(cid)))).alias("_b"))
    slot = F.explode(F.sequence(F.lit(1), F.lit(n)))
    return bank.select(*keys, "_b", slot.alias("slot")).select(
        *keys,
        "slot",
        F.element_at("_b", F.least(F.col("slot"), F.size("_b")))[cid].alias(cid),
        (F.col("slot") > F.size("_b")).alias("padded"),
    )


def route(df: DataFrame, index: Column, total: Column, elapsed: Column, limit: float, available: Column) -> DataFrame:
    """Requested and executed source with the reason of a fallback."""
    first = F.when(total > 15, 14).otherwise(0)
    last = F.when(total > 15, total - 1).otherwise(0)
    wanted = index.between(first, last) & (elapsed < limit)
    reason = (
        F.when(wanted & available, F.lit(None).cast("string"))
        .when(wanted, F.lit("predictor_unavailable"))
        .when(elapsed >= limit, F.lit("time_limit"))
        .otherwise(F.lit("index_outside_range"))
    )
    return df.withColumns(
        {
            "requested": F.when(wanted, F.lit("predictor")).otherwise(F.lit("template")),
            "executed": F.when(wanted & available, F.lit("predictor")).otherwise(F.lit("template")),
            "reason": reason,
        }
    )


def mixed_pairs(df: DataFrame, target: Sequence[str], cluster: str, kind: str, quality: str, cid: str, first: str, second: str, n: int) -> DataFrame:
    """Best pair of both kinds in each mixed cluster; clusters by size, quality, id."""
    top = lambda k: F.max_by(cid, F.when(F.col(kind) == k, F.struct(F.col(quality), F.col(cid))))
    grouped = df.groupBy(*target, cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.max(quality).alias("best_quality"),
        F.count_if(F.col(kind) == first).alias("_f"),
        F.count_if(F.col(kind) == second).alias("_s"),
        top(first).alias(f"{first}_id"),
        top(second).alias(f"{second}_id"),
    )
    mixed = grouped.where((F.col("_f") > 0) & (F.col("_s") > 0)).drop("_f", "_s")
    return topn(mixed, target, [F.desc("size"), F.desc("best_quality"), F.col(cluster)], n, rank="rank")


# ---------------------------------------------------------------- diversity
#
# The pools below come from ``percentile_cap`` (at most 50 rows per key), which bounds each group.


def farthest_first(pool: DataFrame, keys: Sequence[str], cid: str, score: str, features: str, n: int) -> DataFrame:
    """Spread n centres over a capped pool, assign every row to the closest, and take each group's best."""
    return _clustered_pick(pool, keys, cid, score, features, n, refine=0)


def kmeans_pick(pool: DataFrame, keys: Sequence[str], cid: str, score: str, features: str, n: int, rounds: int = 25) -> DataFrame:
    """As ``farthest_first`` with centres refined as means; for pools of fifteen rows or more."""
    return _clustered_pick(pool, keys, cid, score, features, n, refine=rounds)


def _clustered_pick(pool: DataFrame, keys: Sequence[str], cid: str, score: str, features: str, n: int, refine: int) -> DataFrame:
    keys = list(keys)

    def pick(frame):
        import numpy as np

        frame = frame.sort_values([score, cid], ascending=[False, True]).reset_index(drop=True)
        data = np.stack(frame[features].to_numpy()).astype(float)
        chosen = [0]
        gap = np.linalg.norm(data - data[0], axis=1)
        while len(chosen) < min(n, len(frame)):
            gap[chosen] = -1.0
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(data - data[chosen[-1]], axis=1))
        centres = data[chosen]
        for _ in range(refine if len(frame) >= 15 else 0):
            label = np.linalg.norm(data[:, None] - centres[None], axis=2).argmin(axis=1)
            moved = np.stack([data[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centres)])
            if np.allclose(moved, centres):
                break
            centres = moved
        label = np.linalg.norm(data[:, None] - centres[None], axis=2).argmin(axis=1)
        return frame.assign(cluster=label.astype("int64")).groupby("cluster", sort=True).head(1)[[*keys, cid, score, "cluster"]]

    types = dict(pool.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, cid, score)] + ["cluster long"])
    return pool.select(*keys, cid, score, features).groupBy(*keys).applyInPandas(pick, schema)


def mmr_select(
    candidates: DataFrame, keys: Sequence[str], cid: str, quality: str, cluster: str, vector: str, n: int,
    diversity: float = 0.25, bonus: float = 0.20, support: float = 0.10,
) -> DataFrame:
    """Greedy quality-diversity choice: n rounds, each an aggregation and a join over all keys at once.

    Only the similarity to the row just chosen is computed in a round, so no pair
    matrix exists and a key of any size is handled by many tasks.
    """
    from chainwright.functions.sequence import cosine
    from chainwright.session import durable

    keys = list(keys)
    sizes = candidates.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("_size"))
    biggest = sizes.groupBy(*keys).agg(F.max("_size").alias("_most"))
    state = candidates.join(sizes.join(biggest, keys), [*keys, cluster]).select(
        *keys, cid, quality, cluster, vector, (F.col("_size") / F.col("_most")).alias("_support"), F.lit(0.0).alias("_redundant"), F.lit(False).alias("_used")
    )
    state = durable(state)
    picked = None
    for step in range(1, n + 1):
        value = F.col(quality) + support * F.col("_support") + F.when(F.col("_used"), 0.0).otherwise(bonus) - diversity * F.col("_redundant")
        order = F.struct((-value).alias("v"), (-F.col(quality)).alias("q"), F.col(cid).alias("i"))
        won = state.groupBy(*keys).agg(F.min_by(F.struct(F.col(cid).alias("_id"), F.col(cluster).alias("_c"), F.col(vector).alias("_vec")), order).alias("_w"))
        won = durable(won.select(*keys, "_w._id", "_w._c", "_w._vec"))
        chosen = won.select(*keys, F.col("_id").alias(cid), F.col("_c").alias(cluster), F.lit(step).alias("rank"))
        picked = chosen if picked is None else picked.unionByName(chosen)
        near = cosine(F.col(vector), F.col("_vec"))
        # The first choice sets the redundancy, later ones can only raise it.
        raised = near if step == 1 else F.greatest("_redundant", near)
        state = durable(
            state.join(won, keys)
            .where(F.col(cid) != F.col("_id"))
            .select(*keys, cid, quality, cluster, vector, "_support", raised.alias("_redundant"), (F.col("_used") | (F.col(cluster) == F.col("_c"))).alias("_used"))
        )
    return picked
