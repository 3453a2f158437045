"""Registered queries: paired effects, resampling, correlation and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions import sequence as S
from chainwright.operators import stats
from chainwright.plans.fixtures import PANEL, ROWS, TARGETS, classifier_rows, panel, target_settings
from chainwright.plans.registry import query
from chainwright.plans.summaries import rounded

SEED = 2025
B = 200
DRAW = "(('0x' || substr(md5(concat_ws('|', '{seed}', {a}, {b})), 1, 8))::BIGINT)"


def draw_sql(a: str, b: str) -> str:
    return DRAW.format(seed=SEED, a=a, b=b)


def summary_sql(source: str, delta: str, keys: str = "", tie: str = "1e-12", strict: bool = False, digits: int = 6) -> str:
    tied = f"abs({delta}) {'<' if strict else '<='} {tie}"
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}CAST(count(*) AS BIGINT) AS targets, round(avg({delta}), {digits}) AS mean_delta, CAST(count(CASE WHEN {delta} > {tie} THEN 1 END) AS BIGINT) AS improved, CAST(count(CASE WHEN {tied} THEN 1 END) AS BIGINT) AS tied,
 CAST(count(CASE WHEN {delta} < -{tie} THEN 1 END) AS BIGINT) AS regressed, round(quantile_cont({delta}, 0.5), {digits}) AS median_delta FROM {source} WHERE {delta} IS NOT NULL{tail}"""


def boot_sql(source: str, unit: str, value: str, name: str = "bt", keys: str = "", order: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    match = f"{name}_d.ordinal = {name}_u.ordinal" + "".join(f" AND {name}_d.{k} = {name}_u.{k}" for k in keys.replace(" ", "").split(",") if k)
    keyed = "".join(f"{name}_u.{k}, " for k in keys.replace(" ", "").split(",") if k)
    return f"""{name}_u AS (SELECT *, row_number() OVER ({part} ORDER BY {order or unit}) - 1 AS ordinal, count(*) OVER ({part}) AS units FROM (SELECT {lead}{unit}, sum({value}) AS total, count({value}) AS size FROM {source} GROUP BY ALL)),
 {name}_d AS (SELECT {lead}r AS replicate, {draw_sql('r', 'ordinal')} % units AS ordinal FROM {name}_u, range({B}) AS g(r)),
 {name} AS (SELECT {keyed}replicate, sum(total) / sum(size) AS mean FROM {name}_d JOIN {name}_u ON {match} GROUP BY ALL)"""


def summary_rounded(df, *more):
    return rounded(df, "mean_delta", "median_delta", *more)


def untied(df):
    """Means of values with two decimals often end in 5 exactly; a small step makes both engines round them up."""
    return df.withColumn("mean", F.round(F.col("mean") + 1e-8, 5))


@query("sx01_paired_summary", f"WITH {TARGETS} {summary_sql('targets', 'delta', 'cluster')}")
def _(t):
    return summary_rounded(stats.paired_summary(target_settings(t).withColumn("zero", F.lit(0.0)), ["cluster"], "zero", "delta"))


@query("sx02_bootstrap_ci", f"WITH {TARGETS}, {boot_sql('targets', 'target', 'delta')} SELECT round(quantile_cont(mean, 0.025), 5) AS ci_low, round(quantile_cont(mean, 0.975), 5) AS ci_high FROM bt")
def _(t):
    return rounded(stats.interval(stats.bootstrap(target_settings(t), [], "target", "delta", B, SEED), []), "ci_low", "ci_high", digits=5)


@query("sx03_cluster_bootstrap", f"WITH {TARGETS}, {boot_sql('targets', 'cluster', 'delta')} SELECT CAST(replicate AS INTEGER) AS replicate, round(mean + 1e-8, 5) AS mean FROM bt")
def _(t):
    return untied(stats.bootstrap(target_settings(t), [], "cluster", "delta", B, SEED))


_TEXT = "named AS (SELECT *, 'unit-' || cluster AS label FROM targets)"


@query(
    "sx03_text_clusters",
    f"""WITH {TARGETS}, {_TEXT}, {boot_sql('named', 'label', 'delta', order='md5(label)')} SELECT CAST(replicate AS INTEGER) AS replicate, round(mean + 1e-8, 5) AS mean FROM bt""",
)
def _(t):
    named = target_settings(t).withColumn("label", F.concat(F.lit("unit-"), F.col("cluster").cast("string")))
    return untied(stats.bootstrap(named, [], "label", "delta", B, SEED))


_FLIP = f"""fu AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS ordinal FROM (SELECT cluster, sum(delta) AS total FROM targets GROUP BY 1)), fo AS (SELECT avg(delta) AS o, count(delta) AS n FROM targets),
 fn AS (SELECT p, sum(total * (1 - 2 * ({draw_sql('p', 'ordinal')} % 2))) AS t FROM fu, range(499) AS g(p) GROUP BY 1), fp AS (SELECT max(o) AS observed, (1 + count(CASE WHEN t / n >= o - 1e-9 THEN 1 END)) / CAST(500 AS DOUBLE) AS p_value FROM fn, fo)"""


@query("sx04_sign_flip", f"WITH {TARGETS}, {_FLIP} SELECT round(observed, 6) AS observed, round(p_value, 6) AS p_value FROM fp")
def _(t):
    return rounded(stats.sign_flip(target_settings(t), "cluster", "delta", 499, SEED, slack=1e-9), "observed", "p_value")


@query(
    "sx05_exact_sign_flip",
    f"""WITH {TARGETS}, u AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT cluster % 10 AS c, sum(delta) AS total FROM targets GROUP BY 1)), k AS (SELECT count(*) AS units FROM u), o AS (SELECT avg(delta) AS o, count(delta) AS n FROM targets),
 f AS (SELECT m, sum(total * (1 - 2 * ((m >> i) & 1))) AS t FROM u, (SELECT unnest(range(CAST(power(2, units) AS BIGINT))) AS m FROM k) GROUP BY 1) SELECT round(max(o), 6) AS observed, CAST(max(n) AS BIGINT) AS targets, CAST(max(units) AS BIGINT) AS units, CAST(count(*) AS BIGINT) AS permutations,
 round(avg(CASE WHEN abs(t/n) >= abs(o) - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS two_sided_p, round(avg(CASE WHEN t/n >= o - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS greater_p FROM f, o, k""",
)
def _(t):
    rows = target_settings(t).withColumn("c", F.col("cluster") % 10)
    return rounded(stats.exact_sign_flip(rows, "c", "delta", slack=1e-9), "observed", "two_sided_p", "greater_p")


@query(
    "sx06_primary_inference",
    f"""WITH {TARGETS}, {boot_sql('targets', 'cluster', 'delta')}, {_FLIP}, s AS ({summary_sql('targets', 'delta', tie='1e-6', strict=True)})
 SELECT targets, (SELECT CAST(count(DISTINCT cluster) AS BIGINT) FROM targets) AS clusters, mean_delta, median_delta, (SELECT round(quantile_cont(mean, 0.025), 5) FROM bt) AS ci_low, (SELECT round(quantile_cont(mean, 0.975), 5) FROM bt) AS ci_high, (SELECT round(p_value, 6) FROM fp) AS p_value, improved, tied, regressed FROM s""",
)
def _(t):
    row = stats.primary_inference(target_settings(t), "target", "cluster", "delta", B, 499, SEED, slack=1e-9)
    return rounded(summary_rounded(row, "p_value"), "ci_low", "ci_high", digits=5)


@query(
    "sx07_holm",
    f"""WITH {TARGETS}, p AS (SELECT cluster, target, (CAST(floor(a) AS BIGINT) % 1000) / CAST(20000 AS DOUBLE) AS p FROM targets), r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY cluster) - row_number() OVER w + 1 AS m FROM p WINDOW w AS (PARTITION BY cluster ORDER BY p, target))
 SELECT cluster, target, p, CAST(rank AS INTEGER) AS rank, round(0.05 / CAST(m AS DOUBLE), 6) AS threshold, round(least(1.0, max(m * p) OVER w), 6) AS adjusted, min(CASE WHEN p <= CAST(0.05 AS DOUBLE) / m THEN 1 ELSE 0 END) OVER w = 1 AS reject FROM r WINDOW w AS (PARTITION BY cluster ORDER BY rank)""",
)
def _(t):
    rows = target_settings(t).select("cluster", "target", (F.floor("a") % 1000 / 20000.0).alias("p"))
    return rounded(stats.holm(rows, ["cluster"], "target", "p"), "threshold", "adjusted")


@query(
    "sx08_stratified_effects",
    f"""WITH {TARGETS}, m AS (SELECT CASE WHEN size <= 15000 THEN 'short' WHEN size <= 15500 THEN 'medium' ELSE 'long' END AS stratum, target, a, b, b - a AS d FROM targets), {boot_sql('m', 'target', 'd', keys='stratum')},
 s AS ({summary_sql('m', 'd', 'stratum')}), c AS (SELECT stratum, round(quantile_cont(mean, 0.025), 5) AS ci_low, round(quantile_cont(mean, 0.975), 5) AS ci_high FROM bt GROUP BY 1) SELECT * FROM s JOIN c USING (stratum)""",
)
def _(t):
    rows = target_settings(t).withColumn("stratum", S.bins(F.col("size"), [15000, 15500], ["short", "medium", "long"]))
    return rounded(summary_rounded(stats.stratified_effects(rows, "stratum", "target", "a", "b", B, SEED)), "ci_low", "ci_high", digits=5)


_FACT = """fr AS (SELECT target, CASE WHEN candidate % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, setting, score FROM panel)"""


def _factorial(t):
    rows = panel(t).withColumn("parity", F.when(F.col("candidate") % 2 == 0, "even").otherwise("odd"))
    return stats.factorial(rows, "target", "parity", "setting", ("odd", "even"), ("A", "R"), "score")


@query("sx09_factorial_cells", f"WITH {PANEL}, {_FACT} SELECT parity, setting, round(avg(score), 6) AS mean, round(stddev_samp(score), 4) AS std, CAST(count(*) AS BIGINT) AS count FROM fr WHERE setting IN ('A', 'R') GROUP BY 1, 2")
def _(t):
    return rounded(rounded(_factorial(t)[0], "mean"), "std", digits=4)


@query(
    "sx09_factorial_effects",
    f"""WITH {PANEL}, {_FACT}, w AS (SELECT target, avg(CASE WHEN parity = 'odd' AND setting = 'A' THEN score END) AS a, avg(CASE WHEN parity = 'odd' AND setting = 'R' THEN score END) AS b, avg(CASE WHEN parity = 'even' AND setting = 'A' THEN score END) AS c, avg(CASE WHEN parity = 'even' AND setting = 'R' THEN score END) AS d FROM fr GROUP BY 1),
 e AS (SELECT 'row_effect_first' AS effect, c - a AS delta FROM w UNION ALL SELECT 'row_effect_second', d - b FROM w UNION ALL SELECT 'column_effect_first', b - a FROM w UNION ALL SELECT 'column_effect_second', d - c FROM w UNION ALL SELECT 'interaction', (d - c) - (b - a) FROM w) {summary_sql('e', 'delta', 'effect')}""",
)
def _(t):
    return summary_rounded(_factorial(t)[1])


_STAGES = [("start_to_middle", "N", "A"), ("middle_to_end", "A", "R"), ("whole", "N", "R")]


def _staged_sql(value: str = "score", keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    wide = f"sw AS (SELECT {lead}target, avg(CASE WHEN setting = 'N' THEN {value} END) AS vn, avg(CASE WHEN setting = 'A' THEN {value} END) AS va, avg(CASE WHEN setting = 'R' THEN {value} END) AS vr FROM {'lg' if keys else 'panel'} GROUP BY ALL)"
    pick = {"N": "vn", "A": "va", "R": "vr"}
    rows = " UNION ALL ".join(f"SELECT {lead}target, '{n}' AS comparison, {pick[b]} - {pick[a]} AS delta FROM sw" for n, a, b in _STAGES)
    return f"{wide}, se AS ({rows})"


@query("sx10_staged_effects", f"WITH {PANEL}, {_staged_sql()} {summary_sql('se', 'delta', 'comparison')}")
def _(t):
    staged = stats.compare_stages(panel(t), "target", "setting", "score", _STAGES)
    return summary_rounded(stats.paired_summary(staged, ["comparison"], "baseline", "method"))


@query(
    "sx11_effect_grid",
    f"""WITH {PANEL}, lg AS (SELECT target, cluster, setting, 'score' AS metric, score AS v FROM panel UNION ALL SELECT target, cluster, setting, 'error', -error FROM panel), {_staged_sql('v', 'cluster, metric')}, {boot_sql('se', 'cluster', 'delta', keys='comparison, metric')},
 s AS ({summary_sql('se', 'delta', 'comparison, metric', digits=5)}), c AS (SELECT comparison, metric, round(quantile_cont(mean, 0.025), 5) AS ci_low, round(quantile_cont(mean, 0.975), 5) AS ci_high FROM bt GROUP BY 1, 2) SELECT * FROM s JOIN c USING (comparison, metric)""",
)
def _(t):
    grid = stats.effect_grid(panel(t), "target", "cluster", "setting", {"score": True, "error": False}, _STAGES, B, SEED)
    return rounded(grid, "mean_delta", "median_delta", "ci_low", "ci_high", digits=5)


@query(
    "sx12_decide",
    f"""WITH {TARGETS}, {boot_sql('targets', 'target', 'delta', keys='cluster')}, c AS (SELECT cluster, quantile_cont(mean, 0.025) AS lo FROM bt GROUP BY 1), m AS (SELECT cluster, avg(delta) AS e FROM targets GROUP BY 1)
 SELECT cluster, lo > 0 AS superior, lo > -800 AS non_inferior, lo > -800 AND e > 0 AS accepted FROM c JOIN m USING (cluster)""",
)
def _(t):
    rows = target_settings(t)
    table = stats.interval(stats.bootstrap(rows, ["cluster"], "target", "delta", B, SEED), ["cluster"]).join(rows.groupBy("cluster").agg(F.avg("delta").alias("e")), "cluster")
    return stats.decide(table, "ci_low", "e", 800).select("cluster", "superior", "non_inferior", "accepted")


@query("sx13_relative_change", f"WITH {TARGETS} SELECT target, round(100.0 * (b - a) / nullif(abs(a), 0), 6) AS change_pct FROM targets")
def _(t):
    return target_settings(t).select("target", F.round(stats.relative_change(F.col("a"), F.col("b")), 6).alias("change_pct"))


def _rank(column: str, part: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    ties = f"PARTITION BY {part + ', ' if part else ''}{column}"
    return f"rank() OVER ({over}ORDER BY {column}) + (count(*) OVER ({ties}) - 1) / CAST(2 AS DOUBLE)"


_CENTRE = "pc AS (SELECT *, round(size - avg(size) OVER (PARTITION BY target), 9) AS cx, round(score - avg(score) OVER (PARTITION BY target), 9) AS cy FROM panel)"


@query(
    "sx14_spearman",
    f"""WITH {PANEL}, {_CENTRE}, r AS (SELECT target, {_rank('size')} AS rx, {_rank('score')} AS ry, {_rank('cx')} AS kx, {_rank('cy')} AS ky, {_rank('size', 'target')} AS tx, {_rank('score', 'target')} AS ty FROM pc), w AS (SELECT corr(tx, ty) AS c FROM r GROUP BY target HAVING count(DISTINCT tx) > 1 AND count(DISTINCT ty) > 1)
 SELECT CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS pooled_rho, round(corr(kx, ky), 6) AS centred_rho, (SELECT round(avg(c), 6) FROM w) AS mean_within_rho, (SELECT CAST(count(*) AS BIGINT) FROM w) AS groups_within FROM r""",
)
def _(t):
    return rounded(stats.spearman_report(panel(t), "target", "size", "score"), "pooled_rho", "centred_rho", "mean_within_rho")


@query(
    "sx15_spearman_by",
    f"""WITH {PANEL}, c AS (SELECT *, round(size - avg(size) OVER (PARTITION BY setting, target), 9) AS cx, round(score - avg(score) OVER (PARTITION BY setting, target), 9) AS cy FROM panel),
 r AS (SELECT setting, {_rank('size', 'setting')} AS rx, {_rank('score', 'setting')} AS ry, {_rank('cx', 'setting')} AS kx, {_rank('cy', 'setting')} AS ky FROM c) SELECT setting, CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS pooled_rho, round(corr(kx, ky), 6) AS centred_rho FROM r GROUP BY 1 HAVING count(*) >= 5""",
)
def _(t):
    return rounded(stats.spearman_by(panel(t), "setting", "target", "size", "score"), "pooled_rho", "centred_rho")


_ADV = {"price": "l_extendedprice / 1000 - 38", "discount": "l_discount * 100 - 5", "quantity": "l_quantity - 25"}


def _advantages(t):
    rows = t.lineitem.select("l_suppkey", *[F.expr(e).alias(n) for n, e in _ADV.items()])
    return rows.withColumns({n: F.round(n, 6) for n in _ADV})


def _agreement_sql() -> str:
    names = list(_ADV)
    base = "l AS (SELECT l_suppkey, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _ADV.items()) + " FROM lineitem), c AS (SELECT *, " + ", ".join(f"round({n} - avg({n}) OVER (PARTITION BY l_suppkey), 9) AS c_{n}" for n in names) + " FROM l), r AS (SELECT *, " + ", ".join(f"{_rank(n)} AS r_{n}, {_rank('c_' + n)} AS k_{n}" for n in names) + " FROM c)"
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS label_a, '{b}' AS label_b, round(avg(CASE WHEN ({a} > 0) = ({b} > 0) THEN 1.0 ELSE 0.0 END), 6) AS decision_agreement, CAST(count(*) AS BIGINT) AS n, round(corr(r_{a}, r_{b}), 6) AS pooled_rho, round(corr(k_{a}, k_{b}), 6) AS centred_rho FROM r"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )
    return f"WITH {base} {rows}"


@query("sx16_label_agreement", _agreement_sql())
def _(t):
    return rounded(stats.label_agreement(_advantages(t), "l_suppkey", list(_ADV)), "decision_agreement", "pooled_rho", "centred_rho")


@query(
    "sx17_source_quality",
    """WITH l AS (SELECT l_returnflag AS split, l_suppkey, 'rate' AS label, 'lower' AS direction, l_discount AS a, l_tax AS b, l_tax < l_discount AS w FROM lineitem UNION ALL SELECT l_returnflag, l_suppkey, 'volume', 'higher', l_quantity * 1500, l_extendedprice, l_extendedprice > l_quantity * 1500 FROM lineitem)
 SELECT split, label, direction, round(avg(a), 6) AS first_mean, round(avg(b), 6) AS second_mean, round(avg(CASE WHEN w THEN 1.0 ELSE 0.0 END), 6) AS second_better, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS targets, CAST(count(*) AS BIGINT) AS rows FROM l GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.lineitem.withColumnRenamed("l_returnflag", "split").withColumn("scaled", F.col("l_quantity") * 1500)
    labels = {"rate": ("l_discount", "l_tax", "lower"), "volume": ("scaled", "l_extendedprice", "higher")}
    return rounded(stats.source_quality(rows, "split", "l_suppkey", labels), "first_mean", "second_mean", "second_better")


@query(
    "sx18_calibrate_threshold",
    f"""WITH {ROWS}, g AS (SELECT CAST(0.05 AS DOUBLE) + (CAST(0.95 AS DOUBLE) - CAST(0.05 AS DOUBLE)) * i / 36 AS threshold FROM range(37) AS r(i)), m AS (SELECT threshold, grp, avg(CASE WHEN p >= threshold THEN error_b ELSE error_a END) AS m FROM cls, g GROUP BY 1, 2),
 s AS (SELECT threshold, round(avg(m), 9) AS e FROM m GROUP BY 1) SELECT round(threshold, 6) AS threshold, round(e, 6) AS target_mean_error FROM s ORDER BY e, round(abs(threshold - 0.5), 9), threshold LIMIT 1""",
)
def _(t):
    return rounded(stats.calibrate_threshold(classifier_rows(t)), "threshold", "target_mean_error")


@query(
    "sx19_classification_metrics",
    f"""WITH {ROWS}, b AS (SELECT grp, least(floor(p * 10), 9) AS bin, abs(sum(p) - sum(y)) AS gap FROM cls GROUP BY 1, 2), e AS (SELECT grp, sum(gap) AS gap FROM b GROUP BY 1), r AS (SELECT *, {_rank('p', 'grp')} AS k FROM cls),
 a AS (SELECT grp, count(*) AS n, sum(y) AS pos, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc, count(CASE WHEN y = 1 AND p >= 0.5 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND p < 0.5 THEN 1 END) AS tn, sum(CASE WHEN y = 1 THEN k END) AS ks, avg((p-y)*(p-y)) AS brier, avg(-(y*ln(p)+(1-y)*ln(1-p))*weight) AS bce FROM r GROUP BY 1)
 SELECT grp, CAST(n AS BIGINT) AS rows, round(acc, 6) AS accuracy, round((tp/nullif(CAST(pos AS DOUBLE), 0) + tn/nullif(CAST(n-pos AS DOUBLE), 0))/2, 6) AS balanced_accuracy, round((ks - pos*(pos+1)/2)/nullif(pos*(n-pos), 0), 6) AS auc, round(brier, 6) AS brier, round(gap/n, 6) AS ece, round(bce, 6) AS weighted_bce FROM a JOIN e USING (grp)""",
)
def _(t):
    return rounded(stats.classification_metrics(classifier_rows(t), ["grp"]), "accuracy", "balanced_accuracy", "auc", "brier", "ece", "weighted_bce")


_RULES = """rules AS (SELECT rule, grp, d, CASE WHEN d THEN error_b ELSE error_a END AS e FROM (SELECT *, unnest(['always_first', 'always_second', 'gap_rule', 'confidence_rule', 'oracle']) AS rule, unnest([FALSE, TRUE, gap >= 1, p > 0.5, error_b < error_a]) AS d FROM cls)),
 rb AS (SELECT rule, avg(m) AS te, sum(s)/sum(n) AS re, sum(u)/sum(n) AS sf, count(*) AS targets, sum(n) AS rows FROM (SELECT rule, grp, avg(e) AS m, sum(e) AS s, sum(CASE WHEN d THEN 1.0 ELSE 0.0 END) AS u, count(*) AS n FROM rules GROUP BY 1, 2) GROUP BY 1)"""


@query("sx20_rule_baselines", f"WITH {ROWS}, {_RULES} SELECT rule, round(te, 6) AS target_mean_error, round(re, 6) AS row_mean_error, round(sf, 6) AS second_fraction, CAST(targets AS BIGINT) AS targets, CAST(rows AS BIGINT) AS rows FROM rb")
def _(t):
    return rounded(stats.rule_baselines(classifier_rows(t)), "target_mean_error", "row_mean_error", "second_fraction")


@query(
    "sx21_beats_all",
    f"""WITH {ROWS}, {_RULES}, l AS (SELECT avg(m) AS e FROM (SELECT grp, avg(CASE WHEN p >= 0.3 THEN error_b ELSE error_a END) AS m FROM cls GROUP BY 1)), b AS (SELECT min(te) AS b FROM rb WHERE rule <> 'oracle') SELECT round(e, 6) AS learned_error, round(b, 6) AS best_baseline, e < b AS passes FROM l, b""",
)
def _(t):
    rows = classifier_rows(t)
    learned = stats.decision_errors(rows, {"learned": F.col("p") >= 0.3})
    return rounded(stats.beats_all(learned, stats.rule_baselines(rows), "target_mean_error"), "learned_error", "best_baseline")


@query("sx22_fit_router")
def _(t):
    rows = classifier_rows(t).withColumn("z", F.col("error_a") - F.col("error_b"))
    train, calibration = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    return rounded(stats.choose_router(stats.fit_router(train, calibration, ["p", "error_a", "gap"])), "threshold", "error")


@query(
    "sx23_standardize",
    f"""WITH {ROWS}, m AS (SELECT avg(p) AS mp, greatest(stddev_pop(p), 1e-6) AS sp, avg(error_a) AS me, greatest(stddev_pop(error_a), 1e-6) AS se FROM cls) SELECT doc_id, round((p-mp)/sp, 6) AS z_p, round((error_a-me)/se, 6) AS z_error_a FROM cls, m""",
)
def _(t):
    return rounded(stats.standardize(classifier_rows(t), ["p", "error_a"]).select("doc_id", "z_p", "z_error_a"), "z_p", "z_error_a")
