"""Stand-in frames on the driver tables, each with the matching SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwright.functions.sequence import normalize_seq
from chainwright.operators import order

SENTINEL = -1.0e18  # fixed value: marker of an unresolved coordinate
RESOLVED_ABOVE = -1.0e17  # fixed value: anything below is the marker

# ---------------------------------------------------------------- embeddings as point chains


def structure_points(t) -> DataFrame:
    """target, structure, pos 0..20, x, y, z; unresolved coordinates are NULL."""
    at = lambda i, k: F.get("embedding", i * 3 + k).cast("double") * 50
    gone = lambda i: F.pmod(F.col("vec_id") + i, F.lit(11)) == 0
    point = lambda i: F.struct(
        i.cast("long").alias("pos"),
        *[F.when(~gone(i), at(i, k)).alias(axis) for k, axis in enumerate("xyz")],
    )
    return t.embeddings.select(
        F.col("label").cast("long").alias("target"),
        F.col("vec_id").alias("structure"),
        F.inline(F.transform(F.sequence(F.lit(0), F.lit(20)), point)),
    )


def dense_points(t) -> DataFrame:
    """The same chains with every coordinate present."""
    at = lambda i, k: F.get("embedding", i * 3 + k).cast("double") * 50
    point = lambda i: F.struct(i.cast("long").alias("pos"), *[at(i, k).alias(a) for k, a in enumerate("xyz")])
    return t.embeddings.select(
        F.col("label").cast("long").alias("target"),
        F.col("vec_id").alias("structure"),
        F.inline(F.transform(F.sequence(F.lit(0), F.lit(20)), point)),
    )


_AXES = [f"CAST(embedding[3*p+{k + 1}] AS DOUBLE)*50" for k in range(3)]
PTS = "pts AS (SELECT CAST(label AS BIGINT) AS target, vec_id AS structure, CAST(p AS BIGINT) AS pos, " + ", ".join(
    f"CASE WHEN (vec_id+p)%11<>0 THEN {e} END AS {a}" for e, a in zip(_AXES, "xyz")
) + " FROM embeddings, range(21) AS r(p))"
DENSE = "dense AS (SELECT CAST(label AS BIGINT) AS target, vec_id AS structure, CAST(p AS BIGINT) AS pos, " + ", ".join(
    f"{e} AS {a}" for e, a in zip(_AXES, "xyz")
) + " FROM embeddings, range(21) AS r(p))"


def reference_pairs(t) -> DataFrame:
    """Every structure beside its target's reference (smallest id): px..pz and qx..qz per position."""
    points = structure_points(t)
    chosen = t.embeddings.groupBy(F.col("label").cast("long").alias("target")).agg(F.min("vec_id").alias("reference"))
    reference = points.join(chosen, (points.structure == chosen.reference) & (points.target == chosen.target)).select(
        chosen.target, "pos", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")
    )
    return points.withColumnsRenamed({"x": "px", "y": "py", "z": "pz"}).join(reference, ["target", "pos"])


PAIRS = (
    PTS
    + """, ref AS (SELECT CAST(label AS BIGINT) AS target, min(vec_id) AS reference FROM embeddings GROUP BY 1),
pairs AS (SELECT p.target, p.structure, p.pos, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz
 FROM pts p JOIN ref r ON p.target = r.target JOIN pts q ON q.structure = r.reference AND q.pos = p.pos)"""
)

# ---------------------------------------------------------------- events as ordered chains


def event_chain(t) -> DataFrame:
    """chain, pos, ok, x, y, z and event columns; 'error' rows are unresolved (NULL)."""
    ordered = order.positions(t.events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), total="length")
    ok = F.col("event_type") != "error"
    return ordered.select(
        F.col("user_id").alias("chain"),
        "pos",
        "length",
        ok.alias("ok"),
        F.when(ok, F.col("value")).alias("x"),
        F.when(ok, (F.col("event_id") % 97).cast("double")).alias("y"),
        F.when(ok, F.col("pos") * F.lit(5.9)).alias("z"),
        "event_id",
        "event_type",
        "value",
        "props",
    )


CHAIN = """chain AS (SELECT user_id AS chain, pos, length, ok,
 CASE WHEN ok THEN value END AS x, CASE WHEN ok THEN CAST(event_id % 97 AS DOUBLE) END AS y,
 CASE WHEN ok THEN pos * CAST(5.9 AS DOUBLE) END AS z, event_id, event_type, value, props
 FROM (SELECT *, event_type <> 'error' AS ok, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
  CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS length FROM events))"""

# ---------------------------------------------------------------- documents as sequences


def sequences(t) -> DataFrame:
    """doc_id, seq (normalised), plus the document columns."""
    return t.documents.withColumn("seq", normalize_seq(F.col("text")))


_NORM = "translate(regexp_replace(upper(replace({c}, 'ß', 'ss')), '[\\s-]', '', 'g'), 'T', 'U')"
SEQS = "seqs AS (SELECT doc_id, text, lang, source, n_chars, " + _NORM.format(c="text") + " AS seq FROM documents)"


def norm_sql(column: str) -> str:
    return _NORM.format(c=column)


# ---------------------------------------------------------------- lineitem as a score panel


def panel(t) -> DataFrame:
    """One row per target x setting x candidate: mean scores, with the target's cluster."""
    scores = t.lineitem.groupBy(
        F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("setting"), F.col("l_linenumber").alias("candidate")
    ).agg(
        F.round(F.avg("l_extendedprice"), 6).alias("score"),
        F.round(F.avg("l_discount"), 6).alias("error"),
        F.round(F.sum("l_quantity"), 6).alias("size"),
    )
    clusters = t.supplier.select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("cluster"))
    return scores.join(clusters, "target")


PANEL = """panel AS (SELECT target, setting, candidate, score, error, size, s_nationkey AS cluster FROM (
 SELECT l_suppkey AS target, l_returnflag AS setting, l_linenumber AS candidate, round(avg(l_extendedprice), 6) AS score,
  round(avg(l_discount), 6) AS error, round(sum(l_quantity), 6) AS size FROM lineitem GROUP BY 1, 2, 3)
 JOIN supplier ON s_suppkey = target)"""


def target_settings(t) -> DataFrame:
    """One row per target: the mean score of settings A and R, their delta, cluster and size."""
    means = (
        panel(t)
        .groupBy("target", "cluster")
        .agg(
            F.round(F.avg(F.when(F.col("setting") == "A", F.col("score"))), 6).alias("a"),
            F.round(F.avg(F.when(F.col("setting") == "R", F.col("score"))), 6).alias("b"),
            F.sum("size").alias("size"),
        )
    )
    return means.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


TARGETS = (
    PANEL
    + """, targets AS (SELECT *, round(b - a, 6) AS delta FROM (SELECT target, cluster,
 round(avg(CASE WHEN setting = 'A' THEN score END), 6) AS a, round(avg(CASE WHEN setting = 'R' THEN score END), 6) AS b, sum(size) AS size
 FROM panel GROUP BY 1, 2))"""
)

# ---------------------------------------------------------------- labels joined to documents as classifier rows


def classifier_rows(t) -> DataFrame:
    """doc_id, grp, y (0/1), p in (0,1), weight, and two source errors."""
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id",
        F.col("lang").alias("grp"),
        F.col("quality").cast("int").alias("y"),
        ((F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(97)) + 1) / 98.0).alias("p"),
        (0.25 + F.pmod(F.col("n_chars"), F.lit(8)) / 8.0).alias("weight"),
        (F.pmod(F.col("doc_id") * 13, F.lit(101)) / 10.0).alias("error_a"),
        (F.pmod(F.col("n_chars") * 7, F.lit(103)) / 10.0).alias("error_b"),
        F.col("toxic").cast("int").alias("gap"),
    )


ROWS = """cls AS (SELECT l.doc_id, lang AS grp, CAST(quality AS INTEGER) AS y, ((l.doc_id*37+n_chars)%97 + 1)/CAST(98 AS DOUBLE) AS p,
 0.25 + (n_chars%8)/CAST(8 AS DOUBLE) AS weight, (l.doc_id*13%101)/CAST(10 AS DOUBLE) AS error_a, (n_chars*7%103)/CAST(10 AS DOUBLE) AS error_b,
 CAST(toxic AS INTEGER) AS gap FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
