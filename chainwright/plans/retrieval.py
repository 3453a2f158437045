"""Registered queries: joins, selection and the retrieval chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions import sequence as S
from chainwright.operators import joins, sets, text, topk
from chainwright.plans.fixtures import PANEL, PTS, SEQS, norm_sql, panel, sequences, structure_points
from chainwright.plans.registry import query

# ------------------------------------------------------------------ queries x library on orders


def library(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("family"))
    return t.orders.join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("entry"),
        F.col("o_custkey").alias("entity"),
        "family",
        F.to_date("o_orderdate").alias("released"),
        F.col("o_totalprice").alias("length"),
        (F.lit(1.0) - F.substring("o_orderpriority", 1, 1).cast("int") / 10.0).alias("coverage"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.9).otherwise(0.8).alias("completeness"),
    )


def searches(t):
    n = F.col("n_nationkey").cast("long")
    return t.nation.select(
        n.alias("query"),
        n.alias("own"),
        F.date_add(F.lit("1996-01-01").cast("date"), (n * 60).cast("int")).alias("cutoff"),
        (F.lit(60000.0) + n * 12000).alias("q_length"),
    )


def scored_pairs(t):
    pairs = joins.gated_pairs(searches(t), library(t))
    identity = 1 - F.abs(F.col("q_length") - F.col("length")) / F.greatest("q_length", "length")
    return pairs.withColumn("score", S.template_confidence(identity, F.col("coverage"), F.col("completeness"))["conf_full"])


SCORED = """lib AS (SELECT o_orderkey AS entry, o_custkey AS entity, CAST(c_nationkey AS BIGINT) AS family, CAST(o_orderdate AS DATE) AS released, o_totalprice AS length,
  1 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)/CAST(10 AS DOUBLE) AS coverage, CASE o_orderstatus WHEN 'F' THEN CAST(1.0 AS DOUBLE) WHEN 'O' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS completeness
  FROM orders JOIN customer ON c_custkey = o_custkey),
 searches AS (SELECT CAST(n_nationkey AS BIGINT) AS query, CAST(DATE '1996-01-01' + CAST(n_nationkey*60 AS INTEGER) AS DATE) AS cutoff, CAST(60000 + n_nationkey*12000 AS DOUBLE) AS q_length FROM nation),
 scored AS (SELECT *, (1 - abs(q_length - length)/greatest(q_length, length)) * coverage * completeness AS score FROM searches JOIN lib ON released < cutoff AND family <> query
  AND abs(q_length - length)/greatest(q_length, length) <= CASE WHEN least(q_length, length) < 50 THEN 0.6 WHEN greatest(q_length, length) > 1000 THEN 0.2 ELSE 0.4 END)"""


@query("jn01_gated_pairs", f"WITH {SCORED} SELECT query, entry, score FROM scored")
def _(t):
    return scored_pairs(t).select("query", "entry", "score")


@query(
    "tk03_distinct_topn",
    f"""WITH {SCORED}, e AS (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY score DESC, entry) AS e FROM scored),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY e > 1, score DESC, entry) AS rank FROM e) SELECT query, entry, entity, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def _(t):
    return topk.distinct_topn(scored_pairs(t), ["query"], "entity", "score", "entry", 5).select("query", "entry", "entity", "score", "rank")


@query(
    "tk01_topn",
    f"WITH {PANEL} SELECT target, setting, candidate, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, setting, candidate) AS r FROM panel) WHERE r <= 5",
)
def _(t):
    return topk.topn(panel(t), ["target"], [F.desc("score"), F.col("setting"), F.col("candidate")], 5, rank="rank").select(
        "target", "setting", "candidate", "score", "rank"
    )


@query(
    "tk02_gated_hits",
    """WITH h AS (SELECT CAST(o_orderkey % 50 AS BIGINT) AS query, o_custkey AS entry, max(o_totalprice) AS bits FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-06-01' AND o_custkey % 50 <> o_orderkey % 50 GROUP BY 1, 2)
 SELECT query, entry, bits, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, entry) AS r FROM h) WHERE r <= 40""",
)
def _(t):
    hits = t.orders.select(
        (F.col("o_orderkey") % 50).alias("query"), F.col("o_custkey").alias("entry"), F.col("o_totalprice").alias("bits"), F.to_date("o_orderdate").alias("released")
    )
    gate = S.date_gate(F.col("released"), F.lit("1998-06-01").cast("date")) & (F.col("entry") % 50 != F.col("query"))
    return topk.gated_hits(hits, "query", "entry", "bits", gate, 40)


@query(
    "tk04_percentile_cap",
    f"""WITH {PANEL}, p AS (SELECT cluster, target*100+candidate*10+ascii(setting)%10 AS id, score - 35000 AS s FROM panel), c AS (SELECT cluster, quantile_cont(s, 0.8) AS cut, count(*) AS n FROM p WHERE s > 0 GROUP BY 1)
 SELECT cluster, CAST(id AS BIGINT) AS id, round(s, 6) AS s, CAST(r AS INTEGER) AS rank FROM (SELECT p.*, row_number() OVER (PARTITION BY p.cluster ORDER BY s DESC, id) AS r FROM p JOIN c ON c.cluster = p.cluster WHERE s > 0 AND (n <= 10 OR s >= cut)) WHERE r <= 50""",
)
def _(t):
    rows = panel(t).select(
        "cluster", (F.col("target") * 100 + F.col("candidate") * 10 + F.ascii("setting") % 10).alias("id"), (F.col("score") - 35000).alias("s")
    )
    return topk.percentile_cap(rows, ["cluster"], "s", "id").select("cluster", "id", F.round("s", 6).alias("s"), "rank")


@query(
    "tk07_round_robin",
    f"""WITH {PANEL}, d AS (SELECT *, row_number() OVER (PARTITION BY target, setting ORDER BY score DESC, candidate) AS depth FROM panel)
 SELECT target, setting, candidate, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, setting <> 'R', setting) AS r FROM d) WHERE r <= 5""",
)
def _(t):
    return topk.round_robin(panel(t), ["target"], "setting", "score", "candidate", "R", 5).select("target", "setting", "candidate", "rank")


_TD = """td AS (SELECT target, CASE WHEN setting = 'A' THEN 'D' ELSE 'T' END AS source, candidate*10 + ascii(setting)%10 AS id, score FROM panel)"""


def _td(t):
    source = F.when(F.col("setting") == "A", "D").otherwise("T").alias("source")
    return panel(t).select("target", source, (F.col("candidate") * 10 + F.ascii("setting") % 10).alias("id"), "score")


@query(
    "tk08_allocate",
    f"""WITH {PANEL}, {_TD}, r AS (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY score DESC, id) AS r FROM td), d AS (SELECT target, CAST(least(count(CASE WHEN source = 'D' THEN 1 END), 2) AS BIGINT) AS nd FROM td GROUP BY 1),
 c AS (SELECT r.*, nd FROM r JOIN d USING (target) WHERE (source = 'D' AND r <= 2) OR (source = 'T' AND r <= 5 - nd))
 SELECT target, source, id, CAST(r AS INTEGER) AS source_rank, CAST(count(CASE WHEN source = 'T' THEN 1 END) OVER (PARTITION BY target) AS BIGINT) AS realized_t, nd AS realized_d,
 count(*) OVER (PARTITION BY target) = 5 AS complete FROM c""",
)
def _(t):
    return topk.allocate(_td(t), ["target"], "source", "score", "id", 3, 2).select(
        "target", "source", "id", "source_rank", "realized_t", "realized_d", "complete"
    )


@query(
    "tk10_lock_reference",
    f"""WITH {PANEL}, k AS (SELECT target, candidate FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, candidate) AS r FROM panel WHERE setting = 'N') WHERE r = 1)
 SELECT p.target, p.setting, p.candidate, p.score FROM panel p JOIN k ON p.target = k.target AND p.candidate = k.candidate""",
)
def _(t):
    return topk.lock_reference(panel(t), ["target"], "setting", "N", "candidate", "score").select("target", "setting", "candidate", "score")


@query(
    "tk11_order_like",
    "SELECT o_orderkey, o_custkey, CAST((o_orderkey * 7919) % 1000003 AS BIGINT) AS ordinal FROM orders ORDER BY 3",
)
def _(t):
    sample = t.orders.select("o_orderkey", ((F.col("o_orderkey") * 7919) % 1000003).alias("ordinal"))
    return topk.order_like(t.orders.select("o_orderkey", "o_custkey"), sample, "o_orderkey", "ordinal")


@query(
    "tk12_select_config",
    f"""WITH {PANEL}, s AS (SELECT cluster, setting, round(avg(score), 6) AS m, round(avg(error), 6) AS e FROM panel GROUP BY 1, 2), g AS (SELECT *, e < 0.05 AS ok FROM s)
 SELECT cluster, setting, gate_passed FROM (SELECT *, bool_or(ok) OVER (PARTITION BY cluster) AS gate_passed, row_number() OVER (PARTITION BY cluster ORDER BY NOT ok, -m, e, setting) AS r FROM g) WHERE r = 1""",
)
def _(t):
    summary = panel(t).groupBy("cluster", "setting").agg(F.round(F.avg("score"), 6).alias("m"), F.round(F.avg("error"), 6).alias("e"))
    return topk.select_config(summary, ["cluster"], F.col("e") < 0.05, [-F.col("m"), F.col("e")], "setting")


@query(
    "tk13_pad_bank",
    f"""WITH {PANEL}, {_TD}, r AS (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY score DESC, id) AS r FROM td WHERE source = 'D'), n AS (SELECT target, max(r) AS n FROM r WHERE r <= 5 GROUP BY 1)
 SELECT n.target, CAST(slot AS INTEGER) AS slot, id, slot > n AS padded FROM n, range(1, 6) AS s(slot), r WHERE r.target = n.target AND r.r = least(slot, n)""",
)
def _(t):
    bank = topk.topn(_td(t).where(F.col("source") == "D"), ["target"], [F.desc("score"), F.col("id")], 5, rank="rank")
    return topk.pad_bank(bank, ["target"], "rank", "id", 5)


@query(
    "tk14_route",
    """WITH v AS (SELECT event_id, event_id % 40 AS i, CASE WHEN user_id % 5 = 0 THEN 12 ELSE 30 END AS total, value AS el, event_type <> 'error' AS av FROM events), w AS (SELECT *, i BETWEEN CASE WHEN total > 15 THEN 14 ELSE 0 END AND CASE WHEN total > 15 THEN total - 1 ELSE 0 END AND el < 80 AS want FROM v)
 SELECT event_id, CASE WHEN want THEN 'predictor' ELSE 'template' END AS requested, CASE WHEN want AND av THEN 'predictor' ELSE 'template' END AS executed,
 CASE WHEN want AND av THEN NULL WHEN want THEN 'predictor_unavailable' WHEN el >= 80 THEN 'time_limit' ELSE 'index_outside_range' END AS reason FROM w""",
)
def _(t):
    total = F.when(F.col("user_id") % 5 == 0, 12).otherwise(30)
    return topk.route(t.events, F.col("event_id") % 40, total, F.col("value"), 80.0, F.col("event_type") != "error").select(
        "event_id", "requested", "executed", "reason"
    )


_BANK = """bank AS (SELECT CAST(label AS BIGINT) AS target, vec_id // 20 AS cluster, CASE WHEN vec_id % 3 = 0 THEN 'template' ELSE 'pretrained' END AS kind, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS quality FROM embeddings)"""


def _bank(t):
    v = F.col("vec_id")
    return t.embeddings.select(
        F.col("label").cast("long").alias("target"),
        F.floor(v / 20).alias("cluster"),
        F.when(v % 3 == 0, "template").otherwise("pretrained").alias("kind"),
        v.alias("id"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("quality"),
    )


@query(
    "tk15_mixed_pairs",
    f"""WITH {_BANK}, r AS (SELECT *, row_number() OVER (PARTITION BY target, cluster, kind ORDER BY quality DESC, id DESC) AS k FROM bank),
 g AS (SELECT target, cluster, CAST(count(*) AS BIGINT) AS size, max(quality) AS best_quality, max(CASE WHEN kind = 'template' AND k = 1 THEN id END) AS template_id, max(CASE WHEN kind = 'pretrained' AND k = 1 THEN id END) AS pretrained_id FROM r GROUP BY 1, 2)
 SELECT target, cluster, size, best_quality, template_id, pretrained_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY size DESC, best_quality DESC, cluster) AS n FROM g WHERE template_id IS NOT NULL AND pretrained_id IS NOT NULL) WHERE n <= 3""",
)
def _(t):
    return topk.mixed_pairs(_bank(t), ["target"], "cluster", "kind", "quality", "id", "template", "pretrained", 3)


@query(
    "jn11_source_pairs",
    f"""WITH {_BANK}, r AS (SELECT *, row_number() OVER (PARTITION BY target, kind ORDER BY quality DESC, id) AS k FROM bank)
 SELECT a.target, a.id AS template_id, b.id AS pretrained_id FROM r a JOIN r b ON a.target = b.target AND a.kind = 'template' AND b.kind = 'pretrained' AND a.k <= 3 AND b.k <= 2""",
)
def _(t):
    return joins.source_pairs(_bank(t), "target", "kind", "quality", "id", "template", "pretrained", 3, 2)


@query(
    "tk16_build_candidates",
    f"""WITH {SCORED}, hits AS (SELECT query, entry, entity, score * 0.9 AS score, 1 AS prio FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY length DESC, entry) AS h FROM scored) WHERE h <= 40),
 comp AS (SELECT query, entry, entity, score, 2 AS prio FROM scored), u AS (SELECT * FROM hits UNION ALL SELECT * FROM comp),
 d AS (SELECT *, row_number() OVER (PARTITION BY query, entry ORDER BY prio) AS k FROM u), e AS (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY score DESC, entry) AS e FROM d WHERE k = 1)
 SELECT query, entry, entity, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY e > 1, score DESC, entry) AS rank FROM e) WHERE rank <= 5""",
)
def _(t):
    """Hits are the first 40 by length that pass the gates; the scan has every pair."""
    pairs = scored_pairs(t).select("query", "entry", "entity", "length", "score")
    hits = topk.topn(pairs, ["query"], [F.desc("length"), F.col("entry")], 40).withColumn("score", F.col("score") * 0.9).drop("length")
    merged = sets.union_dedup([hits, pairs.drop("length")], ["query", "entry"])
    return topk.distinct_topn(merged, ["query"], "entity", "score", "entry", 5).select(
        "query", "entry", "entity", F.round("score", 6).alias("score"), "rank"
    )


@query(
    "sx24_leakage_regimes",
    f"""WITH {SCORED}, free AS (SELECT *, released < cutoff AS dated, family <> query AS other, (1 - abs(q_length - length)/greatest(q_length, length)) * coverage * completeness AS score FROM searches JOIN lib
  ON abs(q_length - length)/greatest(q_length, length) <= CASE WHEN least(q_length, length) < 50 THEN 0.6 WHEN greatest(q_length, length) > 1000 THEN 0.2 ELSE 0.4 END),
 b AS (SELECT query, max(CASE WHEN dated AND other THEN score END) AS safe, max(CASE WHEN other THEN score END) AS no_date, max(score) AS oracle FROM free GROUP BY 1)
 SELECT round(avg(safe), 6) AS safe, round(avg(no_date), 6) AS no_date, round(avg(oracle), 6) AS oracle, round(avg(no_date) - avg(safe), 6) AS date_leak, round(avg(oracle) - avg(safe), 6) AS full_leak, CAST(count(*) AS BIGINT) AS targets FROM b""",
)
def _(t):
    open_pairs = joins.length_pairs(searches(t), library(t))
    identity = 1 - F.abs(F.col("q_length") - F.col("length")) / F.greatest("q_length", "length")
    scored = open_pairs.withColumn("score", S.template_confidence(identity, F.col("coverage"), F.col("completeness"))["conf_full"])
    return joins.leakage_regimes(scored, "query", "score", S.date_gate(F.col("released"), F.col("cutoff")), F.col("family") != F.col("own")).select(
        *[F.round(c, 6).alias(c) for c in ("safe", "no_date", "oracle", "date_leak", "full_leak")], "targets"
    )


# ------------------------------------------------------------------ keyed joins


@query(
    "jn06_join_1to1",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM (SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey) LEFT JOIN customer ON c_custkey = o_custkey",
)
def _(t):
    latest = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.join_1to1(latest, t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"]).select(
        "o_orderkey", "o_custkey", "c_mktsegment"
    )


@query(
    "jn07_extend_by_key",
    """WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus, 1 AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'), b AS (SELECT DISTINCT o_custkey, o_orderstatus, 2 AS origin FROM orders)
 SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus)""",
)
def _(t):
    keys = ["o_custkey", "o_orderstatus"]
    first = t.orders.where(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz")).select(*keys).distinct().withColumn("origin", F.lit(1))
    second = t.orders.select(*keys).distinct().withColumn("origin", F.lit(2))
    return joins.extend_by_key(first, second, keys)


@query(
    "jn08_pair_settings",
    f"""WITH {PANEL} SELECT a.target, a.candidate, a.score AS score_a, b.score AS score_b, a.error AS error_a, b.error AS error_b FROM panel a JOIN panel b
 ON a.target = b.target AND a.candidate = b.candidate AND a.setting = 'A' AND b.setting = 'R'""",
)
def _(t):
    return joins.pair_settings(panel(t), ["target", "candidate"], "setting", "A", "R", ["score", "error"])


@query("jn12_restrict", "SELECT CAST(count(*) AS BIGINT) AS n, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 2")
def _(t):
    wanted = t.supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.restrict(t.lineitem, wanted, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


_COHORT = """full_rows AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice) AS BIGINT) AS len, o_orderpriority AS split, concat(o_orderpriority, '/', o_custkey) AS family FROM orders),
 cohort AS (SELECT * FROM full_rows WHERE id % 3 = 0), failed AS (SELECT split, max(id) AS id FROM cohort GROUP BY 1)"""


@query(
    "jn13_replace_failed",
    f"""WITH {_COHORT}, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY date, len, id) AS pos FROM full_rows), f AS (SELECT p.split, p.pos FROM p JOIN failed USING (id)),
 c AS (SELECT p.*, row_number() OVER (PARTITION BY p.split ORDER BY p.pos < f.pos, abs(p.pos - f.pos)) AS r FROM p JOIN f ON f.split = p.split WHERE p.id NOT IN (SELECT id FROM cohort))
 SELECT id, date, len, split, family, FALSE AS replacement FROM cohort WHERE id NOT IN (SELECT id FROM failed) UNION ALL SELECT id, date, len, split, family, TRUE FROM c WHERE r = 1""",
)
def _(t):
    full = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.floor("o_totalprice").alias("len"),
        F.col("o_orderpriority").alias("split"),
        F.concat("o_orderpriority", F.lit("/"), "o_custkey").alias("family"),
    )
    cohort = full.where(F.col("id") % 3 == 0)
    failed = cohort.groupBy("split").agg(F.max("id").alias("id")).select("id")
    return joins.replace_failed(full, cohort, failed, "split", "id", "date", ["len", "id"], "family")


@query(
    "jn14_coverage_check",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
 SELECT CAST(count(a.k) AS BIGINT) AS n_a, CAST(count(b.k) AS BIGINT) AS n_b, CAST(count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS BIGINT) AS both, CAST(count(CASE WHEN b.k IS NULL THEN 1 END) AS BIGINT) AS only_a,
 CAST(count(CASE WHEN a.k IS NULL THEN 1 END) AS BIGINT) AS only_b, round(100.0 * count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) / count(a.k), 6) AS pct_a_covered FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t):
    report = joins.coverage_check(
        t.customer.select(F.col("c_custkey").alias("k")), t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("k")), ["k"]
    )
    return report.withColumn("pct_a_covered", F.round("pct_a_covered", 6))


_NEAR = 12.0


@query(
    "jn09_radius_pairs",
    f"""WITH {PTS} SELECT a.structure, a.pos AS i, b.pos AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS distance FROM pts a JOIN pts b ON a.structure = b.structure AND b.pos - a.pos >= 1
 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= {_NEAR}""",
)
def _(t):
    points = structure_points(t)
    return joins.radius_pairs(points, points, ["structure"], _NEAR).withColumn("distance", F.round("distance", 6))


@query(
    "jn10_nearest_nonadjacent",
    f"""WITH {PTS} SELECT a.structure, a.pos, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS nearest FROM pts a JOIN pts b ON a.structure = b.structure AND abs(b.pos - a.pos) >= 2
 WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return joins.nearest_nonadjacent(structure_points(t), ["structure"], 10.0).select("structure", "pos", F.round("nearest", 6).alias("nearest"))


@query(
    "jn16_allocation_grid",
    """WITH a AS (SELECT CAST(label AS BIGINT) AS target, CAST(count(CASE WHEN vec_id % 3 = 0 THEN 1 END) AS BIGINT) AS available_t, CAST(count(CASE WHEN vec_id % 53 = 0 THEN 1 END) AS BIGINT) AS available_d FROM embeddings GROUP BY 1)
 SELECT target, available_t, available_d, n_t, n_d, setting FROM a, (VALUES (5, 0), (4, 1), (3, 2), (3, 0), (2, 1), (0, 5)) AS g(n_t, n_d), (VALUES ('off'), ('on')) AS s(setting) WHERE n_t <= available_t AND n_d <= available_d""",
)
def _(t):
    targets = t.embeddings.groupBy(F.col("label").cast("long").alias("target")).agg(
        F.count_if(F.col("vec_id") % 3 == 0).alias("available_t"), F.count_if(F.col("vec_id") % 53 == 0).alias("available_d")
    )
    return joins.allocation_grid(targets, [(5, 0), (4, 1), (3, 2), (3, 0), (2, 1), (0, 5)], ["off", "on"])
