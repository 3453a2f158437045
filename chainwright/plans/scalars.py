"""Registered queries: row predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions import sequence as S
from chainwright.operators import filters, text
from chainwright.plans.fixtures import CHAIN, PTS, SEQS, event_chain, norm_sql, sequences, structure_points
from chainwright.plans.registry import query


@query(
    "flt01_split_row_id",
    """SELECT target, CAST(count(*) AS BIGINT) AS n, CAST(max(resid) AS BIGINT) AS max_resid, min(short_target) AS short_target FROM (
 SELECT regexp_extract(rid, '^(.*)_([0-9]+)$', 1) AS target, CAST(regexp_extract(rid, '^(.*)_([0-9]+)$', 2) AS BIGINT) AS resid, split_part(rid, '_', 1) AS short_target
 FROM (SELECT concat('R', l_suppkey, '_', l_returnflag, '_', l_linenumber) AS rid FROM lineitem)) GROUP BY 1""",
)
def _(t):
    rid = F.concat(F.lit("R"), "l_suppkey", F.lit("_"), "l_returnflag", F.lit("_"), "l_linenumber")
    target, resid = S.split_row_id(F.col("rid"))
    return (
        t.lineitem.select(rid.alias("rid"))
        .select(target.alias("target"), resid.alias("resid"), S.first_token_target(F.col("rid")).alias("short_target"))
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"), F.max("resid").alias("max_resid"), F.min("short_target").alias("short_target"))
    )


@query("flt02_normalize_seq", f"WITH {SEQS} SELECT doc_id, seq, CAST(length(seq) AS INTEGER) AS seq_len FROM seqs")
def _(t):
    return sequences(t).select("doc_id", "seq", F.length("seq").alias("seq_len"))


@query(
    "flt03_seq_digest",
    f"""WITH {SEQS} SELECT doc_id, sha256(seq) AS digest, substr(sha256(seq), 1, 16) AS sequence_group,
 concat('C_', substr(sha256(seq), 1, 16)) AS cluster_id FROM seqs""",
)
def _(t):
    return sequences(t).select(
        "doc_id",
        S.seq_digest(F.col("seq")).alias("digest"),
        S.seq_digest(F.col("seq"), 16).alias("sequence_group"),
        S.cluster_id(F.col("seq"), "C_").alias("cluster_id"),
    )


@query(
    "flt04_safe_name",
    """SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM pages""",
)
def _(t):
    return t.pages.select("page_id", S.safe_name(F.col("url")).alias("name"))


@query(
    "flt05_temporal_gate",
    """SELECT o_orderkey, CAST(coalesce(try_cast(raw AS DATE) < DATE '1998-01-01', FALSE) AS BOOLEAN) AS allowed FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)""",
)
def _(t):
    raw = F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", S.temporal_gate(raw, F.lit("1998-01-01")).alias("allowed"))


@query(
    "flt06_exclusions",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(h, '>([0-9][A-Za-z0-9]{3})_', 1), lambda x: upper(x)))), ';') AS header_ids,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(l, '[;,]'), lambda x: upper(trim(x))), lambda x: length(x) > 0))), ';') AS listed,
 NOT list_contains(list_transform(regexp_split_to_array(l, '[;,]'), lambda x: upper(trim(x))), own) AS kept
 FROM (SELECT o_orderkey, concat('>', o_orderkey % 7, 'ab', o_custkey % 5, '_1|A', chr(10), 'ACGU', chr(10), '>', o_custkey % 3, 'cd2_2|B', chr(10), 'GG>', o_orderkey % 7, 'AB', o_custkey % 5, '_3') AS h,
  concat('x', o_custkey % 4, '; Y', o_orderkey % 3, ' ,,x1') AS l, concat('X', o_orderkey % 6) AS own FROM orders)""",
)
def _(t):
    nl = F.lit("\n")
    header = F.concat(
        F.lit(">"), F.col("o_orderkey") % 7, F.lit("ab"), F.col("o_custkey") % 5, F.lit("_1|A"), nl, F.lit("ACGU"), nl, F.lit(">"), F.col("o_custkey") % 3,
        F.lit("cd2_2|B"), nl, F.lit("GG>"), F.col("o_orderkey") % 7, F.lit("AB"), F.col("o_custkey") % 5, F.lit("_3"),
    )
    listed = S.listed_ids(F.concat(F.lit("x"), F.col("o_custkey") % 4, F.lit("; Y"), F.col("o_orderkey") % 3, F.lit(" ,,x1")))
    own = F.concat(F.lit("X"), F.col("o_orderkey") % 6)
    return t.orders.select(
        "o_orderkey",
        F.array_join(S.header_ids(header), ";").alias("header_ids"),
        F.array_join(listed, ";").alias("listed"),
        S.not_excluded(own, listed).alias("kept"),
    )


@query(
    "flt07_length_gate",
    """SELECT a.doc_id, abs(a.n_chars - b.n_chars) / CAST(greatest(a.n_chars, b.n_chars) AS DOUBLE) <= CASE WHEN least(a.n_chars, b.n_chars) < 50 THEN 0.6
 WHEN greatest(a.n_chars, b.n_chars) > 1000 THEN 0.2 ELSE 0.4 END AS near FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""",
)
def _(t):
    following = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("m"))
    return t.documents.select("doc_id", "n_chars").join(following, "doc_id").select(
        "doc_id", S.length_gate(F.col("n_chars"), F.col("m")).alias("near")
    )


_ELIGIBLE = """flags AS (SELECT *, length_ok AND canonical_ok AS structural_ok, in_scope AND length_ok AND canonical_ok AND valid_ok AS eligible FROM (
 SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS released, CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '2000-01-01' AS in_scope,
  o_totalprice BETWEEN 50000 AND 300000 AS length_ok, regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$') AS canonical_ok, o_orderstatus <> 'P' AS valid_ok FROM orders))"""


def _eligible(t):
    orders = t.orders.withColumn("released", F.to_date("o_orderdate"))
    return filters.eligibility(
        orders,
        date=F.col("released"),
        scope_start=F.lit("1996-01-01").cast("date"),
        scope_stop=F.lit("2000-01-01").cast("date"),
        length=F.col("o_totalprice"),
        shortest=50000,
        longest=300000,
        canonical=F.col("o_orderpriority").rlike("^[1-5]-[A-Z]+$"),
        valid=F.col("o_orderstatus") != "P",
    )


@query(
    "flt08_eligibility",
    f"WITH {_ELIGIBLE} SELECT o_orderkey, in_scope, length_ok, canonical_ok, valid_ok, structural_ok, eligible FROM flags",
)
def _(t):
    return _eligible(t).select(
        "o_orderkey", "in_scope", "length_ok", "canonical_ok", "valid_ok", "structural_ok", "eligible"
    )


@query(
    "flt09_candidate_contract",
    f"""WITH {PTS}, p AS (SELECT structure, pos, CASE WHEN structure % 17 = 0 AND pos = 3 THEN NULL ELSE x END AS x, y, z,
  CASE WHEN structure % 19 = 0 AND pos = 4 THEN 1.5 ELSE (pos % 10)/CAST(10 AS DOUBLE) END AS confidence, (structure + pos) % 11 <> 0 OR structure % 23 = 0 AS supported FROM pts),
 s AS (SELECT structure, count(*) AS n, bool_and((x IS NULL) = (y IS NULL) AND (y IS NULL) = (z IS NULL)) AS whole,
  bool_and(NOT supported OR (x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)) AS sup, bool_and(confidence BETWEEN 0 AND 1) AS loc FROM p GROUP BY 1),
 c AS (SELECT vec_id AS structure, CASE WHEN vec_id % 29 = 0 THEN 20 ELSE 21 END AS seq_len, (vec_id % 103)/CAST(100 AS DOUBLE) AS g, CASE WHEN vec_id % 31 = 0 THEN 'other' ELSE 'template' END AS kind FROM embeddings)
 SELECT structure, 'length' AS rule FROM c JOIN s USING (structure) WHERE seq_len <> n
 UNION ALL SELECT structure, 'partial coordinate' FROM s WHERE NOT whole
 UNION ALL SELECT structure, 'support without coordinate' FROM s WHERE NOT sup
 UNION ALL SELECT structure, 'local confidence range' FROM s WHERE NOT loc
 UNION ALL SELECT structure, 'global confidence range' FROM c WHERE NOT g BETWEEN 0 AND 1
 UNION ALL SELECT structure, 'kind' FROM c WHERE kind NOT IN ('template', 'pretrained', 'denovo', 'fused')""",
)
def _(t):
    s, pos = F.col("structure"), F.col("pos")
    points = structure_points(t).select(
        "structure",
        "pos",
        F.when(~((s % 17 == 0) & (pos == 3)), F.col("x")).alias("x"),
        "y",
        "z",
        F.when((s % 19 == 0) & (pos == 4), 1.5).otherwise((pos % 10) / 10.0).alias("confidence"),
        (((s + pos) % 11 != 0) | (s % 23 == 0)).alias("supported"),
    )
    v = F.col("vec_id")
    candidates = t.embeddings.select(
        v.alias("structure"),
        F.when(v % 29 == 0, 20).otherwise(21).alias("seq_len"),
        ((v % 103) / 100.0).alias("global_confidence"),
        F.when(v % 31 == 0, "other").otherwise("template").alias("kind"),
    )
    return filters.candidate_contract(candidates, points, ["structure"], ("template", "pretrained", "denovo", "fused"))


@query(
    "flt10_first_match_state",
    f"""WITH {_ELIGIBLE} SELECT o_orderkey, CASE WHEN NOT length_ok THEN 'EXCLUDED_LENGTH' WHEN NOT canonical_ok THEN 'EXCLUDED_SEQUENCE' WHEN NOT valid_ok THEN 'EXCLUDED_STRUCTURE'
 WHEN NOT in_scope THEN 'DEVELOPMENT_ONLY' ELSE 'ELIGIBLE' END AS state,
 CASE WHEN NOT length_ok THEN 'length outside bounds' WHEN NOT canonical_ok THEN 'non-canonical letters' WHEN NOT valid_ok THEN 'too few resolved points'
 WHEN NOT in_scope THEN 'date outside scope' ELSE 'all checks passed' END AS evidence FROM flags""",
)
def _(t):
    rules = [
        (~F.col("length_ok"), "EXCLUDED_LENGTH", "length outside bounds"),
        (~F.col("canonical_ok"), "EXCLUDED_SEQUENCE", "non-canonical letters"),
        (~F.col("valid_ok"), "EXCLUDED_STRUCTURE", "too few resolved points"),
        (~F.col("in_scope"), "DEVELOPMENT_ONLY", "date outside scope"),
    ]
    return filters.first_match_state(_eligible(t), rules, ("ELIGIBLE", "all checks passed")).select(
        "o_orderkey", "state", "evidence"
    )


def _composition_sql() -> str:
    n = "CAST(greatest(length(seq), 1) AS DOUBLE)"
    count = lambda p: f"((length(seq) - length(replace(seq, '{p}', ''))) / {len(p)})"
    parts = [f"{count(b)} / {n} AS f_{b.lower()}" for b in S.BASES]
    for p in S.DINUCLEOTIDES:
        c = count(p) if p[0] != p[1] else (
            f"({count(p[0])} - (length(regexp_replace(seq, '{p[0]}+', '{p[0]}', 'g')) - length(replace(seq, '{p[0]}', ''))))"
        )
        parts.append(f"CASE WHEN length(seq) > 1 THEN {c} / CAST(length(seq) - 1 AS DOUBLE) ELSE 0 END AS f_{p.lower()}")
    for name, two in (("gc_share", "GC"), ("au_share", "AU"), ("purine", "AG"), ("pyrimidine", "UC")):
        parts.append(f"({count(two[0])} + {count(two[1])}) / {n} AS f_{name}")
    parts.append("least(length(seq) / CAST(1000 AS DOUBLE), 1.0) AS f_length")
    term = lambda b: f"CASE WHEN {count(b)} > 0 THEN ({count(b)}/{n}) * log2({count(b)}/{n}) ELSE 0 END"
    parts.append("-(" + " + ".join(term(b) for b in S.BASES) + ") / 2 AS f_entropy")
    return ", ".join(parts)


_REPEAT = """km AS (SELECT doc_id, i, c[i] || c[i+1] || c[i+2] AS kmer FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT doc_id, string_split(seq, '') AS c FROM seqs WHERE length(seq) >= 6))),
rep AS (SELECT doc_id, sum(CASE WHEN i + 3 <= last THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS f_repeat FROM (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id, kmer) AS last FROM km) GROUP BY 1)"""


@query(
    "sc01_seq_features",
    f"""WITH {SEQS}, {_REPEAT}, f AS (SELECT doc_id, {_composition_sql()} FROM seqs)
 SELECT doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in ["f_a", "f_u", "f_g", "f_c", *[f"f_{d.lower()}" for d in S.DINUCLEOTIDES], "f_gc_share", "f_au_share", "f_purine", "f_pyrimidine", "f_length", "f_entropy"])},
 round(coalesce(f_repeat, 0), 6) AS f_repeat FROM f LEFT JOIN rep USING (doc_id)""",
)
def _(t):
    docs = sequences(t).select("doc_id", "seq")
    features = S.composition(F.col("seq"))
    repeat = text.repeat_share(docs, ["doc_id"], "seq").withColumnRenamed("repeat_share", "f_repeat")
    return (
        docs.select("doc_id", *[F.round(c, 6).alias(n) for n, c in features.items()])
        .join(repeat, "doc_id", "left")
        .withColumn("f_repeat", F.round(F.coalesce("f_repeat", F.lit(0.0)), 6))
    )


@query("sc02_repeat_share", f"WITH {SEQS}, {_REPEAT} SELECT doc_id, round(f_repeat, 6) AS repeat_share FROM rep")
def _(t):
    return text.repeat_share(sequences(t), ["doc_id"], "seq").select("doc_id", F.round("repeat_share", 6).alias("repeat_share"))


@query(
    "sc03_kmer_jaccard",
    f"""WITH {SEQS}, k AS (SELECT DISTINCT doc_id, c[i] || c[i+1] || c[i+2] AS kmer FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT doc_id, string_split(seq, '') AS c FROM seqs WHERE length(seq) >= 3))),
 n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), sh AS (SELECT a.doc_id, count(*) AS shared FROM k a JOIN k b ON b.doc_id = a.doc_id + 1 AND a.kmer = b.kmer GROUP BY 1)
 SELECT a.doc_id, round(coalesce(shared / CAST(na.n + nb.n - shared AS DOUBLE), 0), 6) AS jaccard FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
 LEFT JOIN n na ON na.doc_id = a.doc_id LEFT JOIN n nb ON nb.doc_id = b.doc_id LEFT JOIN sh ON sh.doc_id = a.doc_id""",
)
def _(t):
    docs = sequences(t)
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("other"))
    pairs = docs.select("doc_id", "seq").join(following, "doc_id")
    return text.kmer_jaccard(pairs, ["doc_id"], "seq", "other").select("doc_id", F.round("jaccard", 6).alias("jaccard"))


@query(
    "sc04_cosine",
    """WITH ref AS (SELECT label, min(vec_id) AS r FROM embeddings GROUP BY 1) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
 FROM embeddings e JOIN ref USING (label) JOIN embeddings q ON q.vec_id = r""",
)
def _(t):
    reference = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    return t.embeddings.join(reference, "label").select(
        "vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity")
    )


# Fixed weight families of the composite score: global, local, features, 3-mer.
WEIGHTS = {
    "full": (0.4, 0.3, 0.2, 0.1),
    "global_only": (1.0, 0.0, 0.0, 0.0),
    "local_only": (0.0, 1.0, 0.0, 0.0),
    "features_only": (0.0, 0.0, 1.0, 0.0),
    "kmer_only": (0.0, 0.0, 0.0, 1.0),
}


@query(
    "sc05_composite_score",
    "WITH w(family, a, b, c, d) AS (VALUES "
    + ", ".join(f"('{f}', {', '.join(f'CAST({x} AS DOUBLE)' for x in w)})" for f, w in WEIGHTS.items())
    + """), f AS (SELECT doc_id, n_chars % 100 / CAST(100 AS DOUBLE) AS g, doc_id % 89 / CAST(89 AS DOUBLE) AS l, n_chars % 61 / CAST(61 AS DOUBLE) AS s, doc_id % 53 / CAST(53 AS DOUBLE) AS k FROM documents)
 SELECT family, doc_id, round(a*g + b*l + c*s + d*k, 6) AS composite FROM f, w""",
)
def _(t):
    part = lambda c, m: F.col(c) % m / float(m)
    signals = t.documents.select(
        "doc_id",
        part("n_chars", 100).alias("global"),
        part("doc_id", 89).alias("local"),
        part("n_chars", 61).alias("features"),
        part("doc_id", 53).alias("kmer3"),
    )
    return text.composite_scores(signals, ["global", "local", "features", "kmer3"], WEIGHTS).select(
        "family", "doc_id", F.round("composite", 6).alias("composite")
    )


@query(
    "sc06_template_confidence",
    """SELECT l_suppkey, round(avg(i*c*s), 6) AS conf_full, round(avg(i*c), 6) AS conf_no_completeness, round(avg(i), 6) AS conf_identity, round(avg(c), 6) AS conf_coverage FROM (
 SELECT l_suppkey, 1 - l_discount AS i, l_quantity/50 AS c, 1 - l_tax AS s FROM lineitem) GROUP BY 1""",
)
def _(t):
    parts = S.template_confidence(1 - F.col("l_discount"), F.col("l_quantity") / 50, 1 - F.col("l_tax"))
    return t.lineitem.groupBy("l_suppkey").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in parts.items()])


@query(
    "sc07_stable_seed",
    "SELECT doc_id, CAST(('0x' || substr(sha256(concat_ws('|', lang, source, doc_id)), 1, 8)) AS BIGINT) AS seed FROM documents",
)
def _(t):
    return t.documents.select("doc_id", S.stable_seed(F.col("lang"), F.col("source"), F.col("doc_id")).alias("seed"))


@query(
    "sc09_soft_label",
    """SELECT l_orderkey, l_linenumber, round(1/(1+exp(-least(greatest(d/1.5, -12), 12))), 6) AS label, round(0.25 + least(abs(d)/5, 1), 6) AS weight FROM (
 SELECT l_orderkey, l_linenumber, l_quantity/10 - l_discount*50 AS d FROM lineitem)""",
)
def _(t):
    label, weight = S.soft_label(F.col("l_quantity") / 10, F.col("l_discount") * 50, 1.5, 5.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(label, 6).alias("label"), F.round(weight, 6).alias("weight"))
