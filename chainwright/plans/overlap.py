"""Registered queries: sequence overlap, retrieval, stems, clusters and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions.sequence import normalize_seq
from chainwright.operators import alignment, text, topk
from chainwright.plans.fixtures import SEQS, norm_sql, sequences
from chainwright.plans.registry import query
from chainwright.plans.summaries import rounded
from chainwright.session import stash

K = 13


def items(t):
    return t.benchmark.select("item_id", normalize_seq(F.col("text")).alias("seq"))


def km_sql(name: str, key: str, source: str, k: int = K) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, substr(seq, i, {k}) AS kmer FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM {source} WHERE length(seq) >= {k}))"""


SHARED = f"""{SEQS}, items AS (SELECT item_id, {norm_sql('text')} AS seq FROM benchmark), {km_sql('kd', 'doc_id', 'seqs')}, {km_sql('kq', 'item_id', 'items')},
 nd AS (SELECT doc_id, count(*) AS t_kmers FROM kd GROUP BY 1), nq AS (SELECT item_id, count(*) AS q_kmers FROM kq GROUP BY 1),
 sh AS (SELECT item_id, doc_id, count(*) AS shared FROM kd JOIN kq USING (kmer) GROUP BY 1, 2)"""


@query(
    "jn02_kmer_retrieve",
    f"WITH {SHARED} SELECT item_id, doc_id, CAST(shared AS BIGINT) AS shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM sh) WHERE rank <= 300",
)
def _(t):
    return text.kmer_retrieve(items(t), sequences(t), "item_id", "doc_id", "seq", K, 300).select("item_id", "doc_id", "shared", "rank")


@query(
    "jn03_exact_overlap",
    f"""WITH {SEQS}, d AS (SELECT sha256(seq) AS d, CAST(count(*) AS BIGINT) AS matches, CAST(count(DISTINCT source) AS BIGINT) AS sources, min(doc_id) AS first_id FROM seqs GROUP BY 1) SELECT doc_id AS target, matches, sources, first_id FROM seqs JOIN d ON d = sha256(seq)""",
)
def _(t):
    docs = sequences(t)
    return text.exact_overlap(docs.withColumnRenamed("doc_id", "target"), docs, "target", "doc_id", "source", "seq")


@query("jn03_overlap_targets", f"WITH {SEQS} SELECT doc_id AS target, sha256(seq) AS digest FROM seqs")
def _(t):
    return text.overlap_targets(sequences(t).withColumnRenamed("doc_id", "target"), "target", "seq")


@query("jn03_overlap_matches", f"WITH {SEQS} SELECT sha256(seq) AS digest, doc_id, source FROM seqs WHERE seq IS NOT NULL")
def _(t):
    """All entries behind the counts of ``jn03_exact_overlap``, where every document is a target."""
    docs = sequences(t)
    return text.overlap_matches(docs, docs, "doc_id", "source", "seq")


def _near_sql(coverage: str) -> str:
    return f"""WITH {SHARED}, s AS (SELECT item_id, shared / CAST(q_kmers AS DOUBLE) AS q, shared / CAST(t_kmers AS DOUBLE) AS t FROM sh JOIN nd USING (doc_id) JOIN nq USING (item_id)), g AS (SELECT item_id, count(*) AS hits, max(q) AS mq, max(t) AS mt FROM s WHERE q >= 0.8 AND t >= {coverage} GROUP BY 1)
 SELECT item_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(mq, 6) AS max_query_coverage, round(mt, 6) AS max_target_coverage, CASE WHEN hits > 0 THEN 'EXCLUDE' ELSE 'PASS' END AS status FROM benchmark LEFT JOIN g USING (item_id)"""


@query("jn04_near_overlap", _near_sql("0.8"))
def _(t):
    return rounded(text.near_overlap(items(t), sequences(t), "item_id", "doc_id", "seq"), "max_query_coverage", "max_target_coverage")


@query("jn04_contained_overlap", _near_sql("0"))
def _(t):
    """Items inside longer entries: only the target's own containment counts."""
    return rounded(text.near_overlap(items(t), sequences(t), "item_id", "doc_id", "seq", coverage=0.0), "max_query_coverage", "max_target_coverage")


@query(
    "jn05_mentions",
    """SELECT DISTINCT token, doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) JOIN (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS token FROM benchmark) USING (token) WHERE token <> ''""",
)
def _(t):
    ids = t.benchmark.select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("token")).where(F.col("token") != "").distinct()
    return text.mentions(t.documents, ids, "doc_id", "text", "token", "[a-z]+").select("token", "doc_id")


@query(
    "jn05_mention_audit",
    """WITH ids AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS token FROM benchmark WHERE regexp_extract(lower(text), '[a-z]+') <> ''), m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
 SELECT token, CAST(count(doc_id) AS BIGINT) AS mentions, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CASE WHEN count(doc_id) > 0 THEN 'EXCLUDE' ELSE 'NONE' END AS decision FROM ids LEFT JOIN m USING (token) GROUP BY 1""",
)
def _(t):
    ids = t.benchmark.select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("token")).where(F.col("token") != "").distinct()
    return text.mention_audit(t.documents, ids, "doc_id", "text", "token", "[a-z]+")


@query(
    "jn15_stems",
    f"""WITH {SEQS}, w AS (SELECT doc_id, i, c[i+1] || c[i+2] || c[i+3] AS word FROM (SELECT doc_id, c, unnest(range(0, len(c) - 2)) AS i FROM (SELECT doc_id, string_split(seq, '') AS c FROM seqs WHERE length(seq) >= 3))),
 v AS (SELECT *, reverse(translate(word, 'ACGU', 'UGCA')) AS partner FROM w WHERE regexp_full_match(word, '[ACGU]{{3}}')), p AS (SELECT a.doc_id, a.i FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.word = a.partner AND b.i >= a.i + 6)
 SELECT doc_id, CAST(count(p.i) AS BIGINT) AS stems, CAST(count(DISTINCT p.i) AS BIGINT) AS starts FROM (SELECT DISTINCT doc_id FROM v) LEFT JOIN p USING (doc_id) GROUP BY 1""",
)
def _(t):
    return text.stem_counts(sequences(t), ["doc_id"], "seq")


@query(
    "jn15_stem_pairs",
    f"""WITH {SEQS}, w AS (SELECT doc_id, i, c[i+1] || c[i+2] || c[i+3] AS word FROM (SELECT doc_id, c, unnest(range(0, len(c) - 2)) AS i FROM (SELECT doc_id, string_split(seq, '') AS c FROM seqs WHERE length(seq) >= 3))),
 v AS (SELECT *, reverse(translate(word, 'ACGU', 'UGCA')) AS partner FROM w WHERE regexp_full_match(word, '[ACGU]{{3}}'))
 SELECT a.doc_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.word = a.partner AND b.i >= a.i + 6""",
)
def _(t):
    """The pairs that ``jn15_stems`` counts; they are as many as its column stems adds up to."""
    return text.stems(sequences(t), ["doc_id"], "seq")


CLUSTERS = f"""{SEQS}, lead AS (SELECT sha256(seq) AS d, min(doc_id) AS node, any_value(seq) AS seq FROM seqs GROUP BY 1), {km_sql('kl', 'node', 'lead')}, nl AS (SELECT node, count(*) AS n FROM kl GROUP BY 1),
 ed AS (SELECT a.node AS a, b.node AS b, count(*) AS s FROM kl a JOIN kl b ON a.kmer = b.kmer AND a.node < b.node GROUP BY 1, 2), eg AS (SELECT a, b FROM ed JOIN nl x ON x.node = a JOIN nl y ON y.node = b WHERE s >= 0.8 * x.n AND s >= 0.8 * y.n),
 bi AS (SELECT a AS u, b AS v FROM eg UNION SELECT b, a FROM eg), cc(node, lab) AS (SELECT node, node FROM lead UNION SELECT bi.v, cc.lab FROM cc JOIN bi ON bi.u = cc.node), lb AS (SELECT node, min(lab) AS cluster FROM cc GROUP BY 1)"""


@query("st19_similarity_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, cluster FROM seqs JOIN lead ON d = sha256(seqs.seq) JOIN lb USING (node)")
def _(t):
    return text.similarity_clusters(sequences(t), "doc_id", "seq")


#: Hits of an item that are aligned: the first that pass the gates, a rule of the retrieval.
GATED = 40


def retrieved_pairs(t, most: int):
    """The best entries per item with both sequences attached."""
    hits = text.kmer_retrieve(items(t), sequences(t), "item_id", "doc_id", "seq", K, most).select("item_id", "doc_id", "rank")
    return hits.join(items(t), "item_id").join(sequences(t).select("doc_id", F.col("seq").alias("entry_seq")), "doc_id")


def template_points(t):
    """A point for every letter of every document; every eleventh is unresolved."""
    p = F.col("pos")
    gone = F.pmod(F.col("doc_id") + p, F.lit(11)) == 0
    at = {"x": (p % 97) * 1.5, "y": (p % 89) * 1.25, "z": p * 0.5}
    letters = sequences(t).where(F.length("seq") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1)).alias("pos"))
    return letters.select("doc_id", "pos", *[F.when(~gone, v).alias(k) for k, v in at.items()])


@query("sc11_alignment_score")
def _(t):
    scored = alignment.alignment_scores(retrieved_pairs(t, GATED), "seq", "entry_seq")
    return rounded(scored.select("item_id", "doc_id", "global_score", "local_score"), "global_score", "local_score")


def transferred(t, setting: str):
    """Alignments of the retrieved pairs, and the coordinates that they bring."""
    aligned = stash(alignment.correspondence(retrieved_pairs(t, GATED), "seq", "entry_seq", setting).drop("entry_seq", "text"), "aligned")
    points = template_points(t).join(aligned.select("doc_id").distinct(), "doc_id", "left_semi")
    return aligned, points, alignment.transfer_points(aligned, ["item_id", "doc_id"], points, "doc_id")


@query("sc12_align_transfer")
def _(t):
    aligned, points, moved = transferred(t, "transfer")
    return rounded(alignment.transfer_summary(aligned, moved, ["item_id", "doc_id"], points, "seq", "doc_id"), "identity", "coverage", "completeness")


@query("sc12_transferred_points")
def _(t):
    """The coordinates themselves, by the second setting, which penalises gaps at the ends."""
    return transferred(t, "adapt")[2]


def candidate_inputs(t):
    """Items ask, documents answer: a cutoff per item, a date, a family and an entity per document."""
    queries = items(t).select(F.col("item_id").alias("query"), "seq", F.date_add(F.lit("2020-03-01").cast("date"), (F.col("item_id") * 7 % 300).cast("int")).alias("cutoff"), (F.col("item_id") % 7).alias("own"))
    library = sequences(t).select(
        F.col("doc_id").alias("entry"), "seq", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("released"),
        (F.col("doc_id") % 11).alias("family"), (F.col("doc_id") % 97).alias("entity"),
    )
    return queries, library.where("seq <> ''"), template_points(t).withColumnRenamed("doc_id", "entry")


@query("tk16_tbm_candidates")
def _(t):
    chosen, _moved = alignment.build_candidates(*candidate_inputs(t))
    return rounded(chosen, "identity", "coverage", "completeness", "confidence")


@query("tk16_tbm_points")
def _(t):
    return rounded(alignment.candidate_points(*alignment.build_candidates(*candidate_inputs(t))), "x", "y", "z", "confidence")
