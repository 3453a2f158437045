"""Registered queries: grouped summaries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions import sequence as S
from chainwright.operators import aggs, joins, sets, windows
from chainwright.plans.fixtures import (
    CHAIN, PANEL, PTS, SEQS, panel, sequences, structure_points,
)
from chainwright.plans.registry import query


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "ag01_resolved_stats",
    f"""WITH {CHAIN}, g AS (SELECT chain, CAST(count(*) AS BIGINT) AS residues, CAST(count(CASE WHEN ok THEN 1 END) AS BIGINT) AS resolved FROM chain GROUP BY 1)
 SELECT chain, residues, resolved, round(resolved / CAST(residues AS DOUBLE), 6) AS resolved_fraction, resolved >= 3 AND resolved / CAST(residues AS DOUBLE) >= 0.8 AS valid FROM g""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("chain"), (F.col("event_type") != "error").alias("ok"))
    return rounded(aggs.resolved_stats(rows, ["chain"], F.col("ok")), "resolved_fraction")


@query(
    "ag02_metric_means",
    f"""WITH {PANEL} SELECT cluster, setting, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score, round(avg(error), 6) AS mean_error FROM panel GROUP BY GROUPING SETS ((cluster, setting), (setting), ())""",
)
def _(t):
    return rounded(aggs.metric_means(panel(t), [["cluster", "setting"], ["setting"], []], ["score", "error"]), "mean_score", "mean_error")


@query(
    "ag03_best_of",
    """WITH b AS (SELECT l_suppkey AS target, l_returnflag AS setting, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2) SELECT setting, round(avg(best), 6) AS mean_best, CAST(count(*) AS BIGINT) AS targets FROM b GROUP BY 1""",
)
def _(t):
    best = aggs.best_of(t.lineitem.select(F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("setting"), "l_extendedprice"), ["target", "setting"], "l_extendedprice")
    return best.groupBy("setting").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.count(F.lit(1)).alias("targets"))


@query(
    "ag04_two_level_mean",
    """SELECT l_returnflag, round(avg(v), 6) AS mean, CAST(count(v) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return rounded(aggs.two_level_mean(t.lineitem, ["l_returnflag", "l_suppkey"], ["l_returnflag"], "l_extendedprice"), "mean")


@query(
    "ag05_mean_std_count",
    f"WITH {PANEL} SELECT cluster, setting, round(avg(score), 6) AS mean, round(stddev_samp(score), 4) AS std, CAST(count(score) AS BIGINT) AS count FROM panel GROUP BY 1, 2",
)
def _(t):
    return rounded(rounded(aggs.mean_std_count(panel(t), ["cluster", "setting"], "score"), "mean"), "std", digits=4)


@query(
    "ag06_pivot_delta",
    f"""WITH {PANEL} SELECT target, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM (SELECT target, avg(CASE WHEN setting = 'A' THEN score END) AS a, avg(CASE WHEN setting = 'R' THEN score END) AS b FROM panel GROUP BY 1)""",
)
def _(t):
    return rounded(aggs.pivot_delta(panel(t), ["target"], "setting", "score", "A", "R"), "a", "b", "delta")


@query(
    "ag07_describe_cohort",
    """SELECT o_orderpriority AS split, CAST(count(*) AS BIGINT) AS targets, min(o_totalprice) AS min_length, max(o_totalprice) AS max_length, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
 CAST(count(DISTINCT o_custkey) AS BIGINT) AS families, round(quantile_cont(o_totalprice, 0.5), 6) AS median_length FROM orders GROUP BY 1""",
)
def _(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("split"), "o_totalprice", F.to_date("o_orderdate").alias("date"), "o_custkey")
    return rounded(aggs.describe_cohort(rows, ["split"], "o_totalprice", "date", "o_custkey"), "median_length")


@query(
    "ag08_profile",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT source) AS BIGINT) AS targets, CAST(sum(n_chars) AS BIGINT) AS residues, min(n_chars) AS min_length, round(avg(n_chars), 6) AS mean_length, max(n_chars) AS max_length, round(quantile_cont(n_chars, 0.5), 6) AS median_length FROM documents""",
)
def _(t):
    return rounded(aggs.profile(t.documents, "source", "n_chars"), "mean_length", "median_length")


@query("ag09_value_counts", "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, lang, source LIMIT 15")
def _(t):
    return aggs.value_counts(t.documents, ["lang", "source"], 15)


@query(
    "ag10_funnel",
    """WITH f AS (SELECT o_custkey AS c, TRUE AS s1, o_orderdate >= TIMESTAMP '1996-01-01' AS s2, o_totalprice > 50000 AS s3, o_orderstatus <> 'P' AS s4 FROM orders),
 d AS (SELECT c, CASE WHEN NOT s1 THEN 0 WHEN NOT s2 THEN 1 WHEN NOT s3 THEN 2 WHEN NOT s4 THEN 3 ELSE 4 END AS d FROM f)
 SELECT stage, name, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT c) AS BIGINT) AS clusters FROM (VALUES (1, 'all'), (2, 'dated'), (3, 'long'), (4, 'closed')) AS v(stage, name) JOIN d ON d.d >= stage GROUP BY 1, 2""",
)
def _(t):
    stages = {
        "all": F.lit(True),
        "dated": F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"),
        "long": F.col("o_totalprice") > 50000,
        "closed": F.col("o_orderstatus") != "P",
    }
    return aggs.funnel(t.orders, stages, "o_custkey")


_REGRET = """sel AS (SELECT target, CASE WHEN setting = 'A' THEN 'P' ELSE 'T' END AS kind, candidate, score FROM panel),
 rt AS (SELECT target, max(CASE WHEN kind = 'T' AND candidate <= 3 THEN score END) AS selected_best, max(CASE WHEN kind = 'T' THEN score END) AS first_oracle, max(CASE WHEN kind = 'P' THEN score END) AS second_oracle, max(score) AS union_oracle FROM sel GROUP BY 1)"""


def _regret(t):
    rows = panel(t).withColumn("kind", F.when(F.col("setting") == "A", "P").otherwise("T"))
    return aggs.oracle_regret(rows, "target", "kind", "score", F.col("candidate") <= 3, "T", "P")


@query(
    "ag11_oracle_regret",
    f"WITH {PANEL}, {_REGRET} SELECT *, round(union_oracle - first_oracle, 6) AS gain, round(union_oracle - selected_best, 6) AS regret FROM rt",
)
def _(t):
    return rounded(_regret(t), "gain", "regret")


@query(
    "ag11_regret_summary",
    f"""WITH {PANEL}, {_REGRET} SELECT CAST(count(*) AS BIGINT) AS targets, round(avg(selected_best), 4) AS mean_selected, round(avg(union_oracle), 4) AS mean_oracle, round(avg(union_oracle - first_oracle), 4) AS mean_gain,
 round(avg(union_oracle - selected_best), 4) AS mean_regret, CAST(count(CASE WHEN union_oracle - first_oracle > 1e-8 THEN 1 END) AS BIGINT) AS improved, CAST(count(CASE WHEN abs(union_oracle - first_oracle) <= 1e-8 THEN 1 END) AS BIGINT) AS tied FROM rt""",
)
def _(t):
    return rounded(aggs.regret_summary(_regret(t)), "mean_selected", "mean_oracle", "mean_gain", "mean_regret", digits=4)


@query(
    "ag12_source_oracle",
    f"""WITH {PANEL}, b AS (SELECT target, max(CASE WHEN setting = 'A' THEN score END) AS "best_A", max(CASE WHEN setting = 'N' THEN score END) AS "best_N", max(CASE WHEN setting = 'R' THEN score END) AS "best_R" FROM panel GROUP BY 1),
 u AS (SELECT *, greatest("best_A", "best_N", "best_R") AS union_best FROM b) SELECT *, CASE WHEN "best_A" = union_best THEN 'A' WHEN "best_N" = union_best THEN 'N' ELSE 'R' END AS winner FROM u""",
)
def _(t):
    return aggs.source_oracle(panel(t), "target", "setting", "score", ["A", "N", "R"])


@query(
    "ag12_winner_counts",
    f"""WITH {PANEL}, b AS (SELECT target, max(CASE WHEN setting = 'A' THEN score END) AS a, max(CASE WHEN setting = 'N' THEN score END) AS n, max(CASE WHEN setting = 'R' THEN score END) AS r FROM panel GROUP BY 1)
 SELECT CASE WHEN a = greatest(a, n, r) THEN 'A' WHEN n = greatest(a, n, r) THEN 'N' ELSE 'R' END AS winner, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""",
)
def _(t):
    return aggs.value_counts(aggs.source_oracle(panel(t), "target", "setting", "score", ["A", "N", "R"]), ["winner"], 3)


@query(
    "ag13_bank_diversity",
    """WITH p AS (SELECT CAST(a.label AS BIGINT) AS target, a.vec_id // 20 AS bank, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 20 = b.vec_id // 20 AND a.vec_id < b.vec_id)
 SELECT target, bank, CAST(count(*) AS BIGINT) AS pairs, round(avg(s), 6) AS mean_similarity, round(count(CASE WHEN s >= 0.5 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS near_duplicate_fraction FROM p GROUP BY 1, 2""",
)
def _(t):
    vectors = t.embeddings.select(F.col("label").cast("long").alias("target"), F.floor(F.col("vec_id") / 20).alias("bank"), "vec_id", "embedding")
    table = aggs.bank_diversity(vectors, ["target", "bank"], "vec_id", "embedding", S.cosine(F.col("va"), F.col("vb")), near=0.5)
    return rounded(table, "mean_similarity", "near_duplicate_fraction")


@query(
    "ag14_stratify",
    f"""WITH {PANEL} SELECT CASE WHEN size <= 200 THEN 'short' WHEN size <= 300 THEN 'medium' ELSE 'long' END AS bin, CASE WHEN size <= 200 THEN 1 WHEN size <= 300 THEN 2 ELSE 3 END AS bin_order, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score, round(avg(error), 6) AS mean_error FROM panel GROUP BY 1, 2""",
)
def _(t):
    label = S.bins(F.col("size"), [200, 300], ["short", "medium", "long"])
    number = F.when(F.col("size") <= 200, 1).when(F.col("size") <= 300, 2).otherwise(3)
    return rounded(aggs.stratify(panel(t), label, number, ["score", "error"]), "mean_score", "mean_error")


@query("ag15_reason_set", "SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS reasons FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(t):
    return aggs.reason_set(t.events, ["user_id"], "event_type")


@query(
    "ag16_power_law_fit",
    """SELECT round(exp(regr_intercept(ln(y), ln(x))), 6) AS a, round(regr_slope(ln(y), ln(x)), 6) AS b, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) WHERE x >= 5 AND y > 0""",
)
def _(t):
    return rounded(aggs.power_law_fit(t.lineitem, "l_quantity", "l_extendedprice"), "a", "b")


_ADJ = """adj AS (SELECT d FROM (SELECT sqrt((x-lx)*(x-lx)+(y-ly)*(y-ly)+(z-lz)*(z-lz)) AS d FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz FROM pts WINDOW w AS (PARTITION BY structure ORDER BY pos))) WHERE d IS NOT NULL)"""


@query(
    "ag17_trimmed_stats",
    f"""WITH {PTS}, {_ADJ}, o AS (SELECT quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.99) AS hi, quantile_cont(d, 0.05) AS p05, quantile_cont(d, 0.95) AS p95 FROM adj)
 SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, CAST(count(*) AS BIGINT) AS n, round(max(p05), 6) AS p05, round(max(p95), 6) AS p95, round(quantile_cont(d, 0.5), 6) AS median FROM adj, o WHERE d BETWEEN lo AND hi""",
)
def _(t):
    distances = windows.adjacent_distance(structure_points(t), ["structure"], "pos")
    return rounded(aggs.trimmed_stats(distances, "distance"), "mean", "std", "p05", "p95", "median")


@query(
    "ag17_clash_radius",
    f"""WITH {PTS}, nn AS (SELECT a.structure, a.pos, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM pts a JOIN pts b ON a.structure = b.structure AND abs(b.pos - a.pos) >= 2 WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2)
 SELECT round(greatest(4.0, quantile_cont(d, 0.01)), 6) AS r_min, CAST(count(*) AS BIGINT) AS n FROM nn WHERE d >= 4""",
)
def _(t):
    nearest = joins.nearest_nonadjacent(structure_points(t), ["structure"], 10.0)
    return rounded(aggs.clash_radius(nearest, "nearest", 4.0), "r_min")


@query(
    "ag18_binned_median",
    """WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS bin, l_extendedprice AS v FROM lineitem)
 SELECT bin, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(v, 0.5), 6) AS median FROM b GROUP BY 1 HAVING count(*) >= 3""",
)
def _(t):
    q = F.col("l_quantity")
    return rounded(aggs.binned_median(t.lineitem, F.when(q < 10, 1).when(q < 20, 2).when(q < 40, 3).otherwise(4), "l_extendedprice"), "median")


@query("ag19_radius_of_gyration", f"WITH {PTS} SELECT structure, CAST(count(*) AS BIGINT) AS n, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg FROM pts WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return rounded(aggs.radius_of_gyration(structure_points(t), ["structure"]), "rg")


@query(
    "ag22_retrieval_quality",
    f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY error DESC, setting, candidate) AS rank FROM panel)
 SELECT target, max(CASE WHEN rank = 1 THEN score END) AS top1, max(CASE WHEN rank <= 5 THEN score END) AS best5, bool_or(rank <= 5 AND score >= 38500) AS useful_hit,
 round(CAST(count(CASE WHEN rank <= 5 AND score >= 38500 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN score >= 38500 THEN 1 END), 0), 6) AS useful_recall, CAST(count(DISTINCT CASE WHEN rank <= 5 THEN setting END) AS BIGINT) AS entities, round(avg(CASE WHEN rank <= 5 THEN error END), 6) AS mean_coverage FROM r GROUP BY 1""",
)
def _(t):
    table = aggs.retrieval_quality(panel(t), ["target"], [F.desc("error"), F.col("setting"), F.col("candidate")], "score", "setting", "error", 38500)
    return rounded(table, "useful_recall", "mean_coverage")


@query(
    "ag23_audit_rollup",
    """WITH r AS (SELECT o_orderpriority AS split, o_orderstatus <> 'P' AS ok, o_orderstatus = 'F' AS ready, CASE WHEN o_orderstatus = 'P' THEN concat('pending ', o_orderkey) END AS error FROM orders),
 e AS (SELECT split, error, row_number() OVER (PARTITION BY split ORDER BY error) AS k FROM (SELECT DISTINCT split, error FROM r WHERE error IS NOT NULL))
 SELECT split, CAST(count(*) AS BIGINT) AS targets, CAST(count(CASE WHEN ok THEN 1 END) AS BIGINT) AS ok, CAST(count(CASE WHEN ready THEN 1 END) AS BIGINT) AS ready,
 (SELECT string_agg(error, ' | ' ORDER BY error) FROM e WHERE e.split = r.split AND k <= 3) AS errors FROM r GROUP BY 1""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_orderpriority").alias("split"), "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("pending "), "o_orderkey")).alias("error")
    )
    return aggs.audit_rollup(rows, ["split"], F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F", "error")


# ------------------------------------------------------------------ set operations


@query(
    "so01_union_dedup",
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), p AS (SELECT o_custkey AS k, max(o_totalprice) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
 u AS (SELECT k, c, 1 AS origin FROM a UNION ALL SELECT k, c, 2 FROM b UNION ALL SELECT k, c, 3 FROM p) SELECT f.k, f.c AS first_c, f.origin AS first_origin, g.c AS best_c, g.origin AS best_origin
 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY origin) AS r FROM u) f JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, origin) AS r FROM u) g ON f.k = g.k AND f.r = 1 AND g.r = 1""",
)
def _(t):
    side = lambda status, n: t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("c")).withColumn("origin", F.lit(n))
    frames = [side("F", 1), side("O", 2), side("P", 3)]
    first = sets.union_dedup(frames, ["k"]).withColumnsRenamed({"c": "first_c", "origin": "first_origin"})
    best = sets.union_dedup(frames, ["k"], confidence="c").withColumnsRenamed({"c": "best_c", "origin": "best_origin"})
    return first.join(best, "k")


_SUB = """truth AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, unnest(range(1, len(string_split(seq, '')) + 1)) AS i FROM seqs WHERE seq <> ''),
 sub AS (SELECT concat(doc_id, '_', CASE WHEN i % 997 = 3 THEN i + 1 ELSE i END) AS "ID", CASE WHEN i % 1009 = 5 THEN '?' ELSE c END AS resname, CASE WHEN i % 1013 = 7 THEN i + 2 ELSE i END AS resid, CASE WHEN i % 991 = 2 THEN NULL ELSE i * 1.0 END AS x FROM truth),
 got AS (SELECT "ID", count(*) AS n, min(resname) AS resname, min(resid) AS resid, bool_or(x IS NULL) AS hole FROM sub GROUP BY 1), want AS (SELECT concat(doc_id, '_', i) AS "ID", c AS want, i AS want_no FROM truth),
 j AS (SELECT coalesce(got."ID", want."ID") AS "ID", n, resname, resid, hole, want, want_no FROM got FULL JOIN want ON got."ID" = want."ID"),
 iss AS (SELECT "ID", 'NULL coordinates' AS issue FROM j WHERE n IS NOT NULL AND hole UNION ALL SELECT "ID", 'duplicate IDs' FROM j WHERE n > 1 UNION ALL SELECT "ID", 'missing IDs' FROM j WHERE n IS NULL
  UNION ALL SELECT "ID", 'extra IDs' FROM j WHERE want IS NULL UNION ALL SELECT "ID", 'residue number' FROM j WHERE n IS NOT NULL AND want IS NOT NULL AND (resid <> want_no OR resid <> CAST(regexp_extract("ID", '_([0-9]+)$', 1) AS BIGINT))
  UNION ALL SELECT "ID", 'residue name' FROM j WHERE n IS NOT NULL AND want IS NOT NULL AND resname <> want)"""


@query(
    "so02_validate_submission",
    f"""WITH {SEQS}, {_SUB} SELECT issue, CAST(count(*) AS BIGINT) AS n, string_agg(CASE WHEN r <= 5 THEN "ID" END, ',' ORDER BY "ID") AS detail FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY "ID") AS r FROM iss) GROUP BY 1""",
)
def _(t):
    docs = sequences(t).select("doc_id", "seq")
    letters = docs.select("doc_id", F.posexplode(F.split("seq", "")).alias("_i", "c")).where(F.length("c") > 0).select("doc_id", (F.col("_i") + 1).alias("i"), "c")
    i = F.col("i")
    sub = letters.select(
        F.concat("doc_id", F.lit("_"), F.when(i % 997 == 3, i + 1).otherwise(i)).alias("ID"),
        F.when(i % 1009 == 5, "?").otherwise(F.col("c")).alias("resname"),
        F.when(i % 1013 == 7, i + 2).otherwise(i).alias("resid"),
        F.when(i % 991 != 2, i * 1.0).alias("x"),
    )
    return sets.validate_submission(sub, docs, "doc_id", "seq", ["x"])


@query(
    "so03_same_rows",
    "SELECT CAST(count(CASE WHEN o_orderkey % 100 = 0 THEN 1 END) AS BIGINT) AS only_a, CAST(count(CASE WHEN o_orderkey % 100 = 0 THEN 1 END) AS BIGINT) AS only_b, FALSE AS same FROM orders",
)
def _(t):
    a = t.orders.select("o_orderkey", "o_orderstatus")
    b = a.select("o_orderkey", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return sets.same_rows(a, b)


@query(
    "so04_concat",
    """SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(count(extra) AS BIGINT) AS extra FROM (SELECT 'customer' AS origin, CAST(NULL AS BIGINT) AS extra FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY 1""",
)
def _(t):
    frames = [t.customer.select(F.lit("customer").alias("origin")), t.supplier.select(F.col("s_suppkey").alias("extra"), F.lit("supplier").alias("origin"))]
    return sets.concat(frames).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extra"))


@query(
    "so05_id_set_report",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0),
 c AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared)
 SELECT n_a, n_b, shared, n_a - shared AS a_only, n_b - shared AS b_only, n_a = shared AS a_in_b, n_b = shared AS b_in_a FROM c""",
)
def _(t):
    return sets.id_set_report(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k")), "k")


@query(
    "so06_exclude_clusters",
    f"""WITH {SEQS}, g AS (SELECT doc_id, substr(sha256(seq), 1, 16) AS grp FROM seqs) SELECT doc_id, grp FROM g WHERE grp NOT IN (SELECT grp FROM g WHERE doc_id % 7 = 0)""",
)
def _(t):
    groups = sequences(t).select("doc_id", S.seq_digest(F.col("seq"), 16).alias("grp"))
    exposed = t.documents.where(F.col("doc_id") % 7 == 0).select("doc_id")
    return sets.exclude_clusters(groups, exposed, "doc_id", "grp")
