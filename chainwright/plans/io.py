"""Registered queries: sources, sinks and streams, on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainwright.functions import sequence as S
from chainwright.operators import structure, topk
from chainwright.plans.fixtures import CHAIN, DENSE, PTS, SENTINEL, SEQS, dense_points, event_chain, norm_sql, sequences, structure_points
from chainwright.plans.registry import query
from chainwright.plans.summaries import rounded
from chainwright.session import scratch
from chainwright.sources import files
from chainwright.streaming import jobs


@query("src01_read_sequences", f"WITH {SEQS} SELECT CAST(doc_id AS VARCHAR) AS target_id, seq AS sequence, CAST(DATE '2020-01-01' + CAST(n_chars % 900 AS INTEGER) AS DATE)::VARCHAR AS temporal_cutoff, lang AS all_sequences, CAST(length(seq) AS INTEGER) AS seq_len FROM seqs")
def _(t):
    path = scratch(t.spark, "sequences")
    cutoff = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("n_chars") % 900).cast("int")).cast("string")
    rows = sequences(t).select(F.col("doc_id").cast("string").alias("target_id"), F.col("seq").alias("sequence"), cutoff.alias("temporal_cutoff"), F.col("lang").alias("all_sequences"))
    rows.write.csv(path, header=True, escape='"')
    return files.read_sequences(t.spark, path)


def _wide(t):
    """Two conformations: the second is a shifted copy, wholly unresolved for every fourth structure."""
    v, pos = F.col("structure"), F.col("pos")
    one = F.pmod(v + pos, F.lit(11)) == 0
    two = (v % 4 == 0) | (F.pmod(v + pos, F.lit(7)) == 0)
    cell = lambda gone, c: F.when(gone, SENTINEL).otherwise(F.round(c, 3))
    return dense_points(t).select(
        F.concat(F.lit("s_"), v, F.lit("_"), pos + 1).alias("ID"),
        F.substring(F.lit("ACGU"), F.pmod(v + pos, F.lit(4)).cast("int") + 1, 1).alias("resname"),
        (pos + 1).alias("resid"),
        *[cell(one, F.col(a)).alias(f"{a}_1") for a in "xyz"],
        *[cell(two, F.col(a) + 1).alias(f"{a}_2") for a in "xyz"],
    )


def _labels(t):
    path = scratch(t.spark, "labels")
    files.write_csv(_wide(t), path)
    return files.read_labels(t.spark, path, 2)


@query(
    "src02_read_labels",
    f"""WITH {DENSE} SELECT CAST(2 AS INTEGER) AS n_refs, CAST(count(*) AS BIGINT) AS rows, CAST(count(CASE WHEN (structure+pos)%11 = 0 THEN 1 END) AS BIGINT) AS unresolved_1, CAST(count(CASE WHEN structure%4 = 0 OR (structure+pos)%7 = 0 THEN 1 END) AS BIGINT) AS unresolved_2 FROM dense""",
)
def _(t):
    labels = _labels(t)
    return labels.agg(
        F.lit(files.n_refs(labels)).alias("n_refs"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x_1") < -1e17).alias("unresolved_1"), F.count_if(F.col("x_2") < -1e17).alias("unresolved_2")
    )


@query(
    "src03_to_points",
    f"""WITH {DENSE}, r AS (SELECT concat('s_', structure) AS target, ref, pos + 1 AS resid, substr('ACGU', CAST((structure+pos)%4+1 AS BIGINT), 1) AS resname, CASE WHEN ref = 1 THEN (structure+pos)%11 = 0 ELSE structure%4 = 0 OR (structure+pos)%7 = 0 END AS gone, x + ref - 1 AS x, y + ref - 1 AS y, z + ref - 1 AS z FROM dense, (VALUES (1), (2)) AS k(ref)),
 a AS (SELECT target, ref FROM r GROUP BY 1, 2 HAVING bool_or(NOT gone)) SELECT target, ref, resid, resname, CASE WHEN NOT gone THEN round(x, 3) END AS x, CASE WHEN NOT gone THEN round(y, 3) END AS y, CASE WHEN NOT gone THEN round(z, 3) END AS z FROM r JOIN a USING (target, ref)""",
)
def _(t):
    return files.to_points(_labels(t))


@query("src04_sequence_of", f"WITH {CHAIN} SELECT chain, string_agg(substr(event_type, 1, 1), '' ORDER BY pos) AS seq FROM chain GROUP BY 1")
def _(t):
    rows = event_chain(t).select("chain", "pos", F.substring("event_type", 1, 1).alias("letter"))
    return files.sequence_of(rows, ["chain"], "pos", "letter")


_WRITABLE = f"""{SEQS}, w AS (SELECT doc_id, seq FROM seqs WHERE length(seq) >= 8 AND NOT regexp_full_match(seq, 'N*') AND NOT starts_with(seq, '>'))"""


@query("src05_read_fasta", f"WITH {_WRITABLE} SELECT CAST(doc_id AS VARCHAR) AS id, seq FROM w")
def _(t):
    path = scratch(t.spark, "fasta")
    files.write_fasta(sequences(t).where(~F.startswith("seq", F.lit(">"))), "doc_id", "seq", path)
    return files.read_fasta(t.spark, path)


@query("src06_write_fasta", f"WITH {SEQS} SELECT doc_id, CAST(length(seq) AS INTEGER) AS seq_len FROM seqs WHERE length(seq) >= 8 AND NOT regexp_full_match(seq, 'N*')")
def _(t):
    return files.writable_sequences(sequences(t), "seq").select("doc_id", F.length("seq").alias("seq_len"))


@query(
    "src07_read_hits",
    """SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS target, CAST(count(*) AS BIGINT) AS n, round(max(l_extendedprice), 2) AS bits FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    path = scratch(t.spark, "hits")
    q = F.col("l_quantity").cast("int")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_discount", q, q, q, q, q, q, q, F.lit(0.001), "l_extendedprice")
    rows.toDF(*[f.name for f in files.HIT_SCHEMA]).write.csv(path, sep="\t")
    none = files.read_hits(t.spark, path + "-absent")
    return files.read_hits(t.spark, path).unionByName(none).groupBy("query", "target").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("bits"), 2).alias("bits"))


@query("src08_read_release_dates", "SELECT concat('E', o_orderkey) AS entry, CAST(o_orderdate AS DATE) AS released FROM orders WHERE o_orderkey % 10 <> 0")
def _(t):
    path = scratch(t.spark, "dates")
    header = F.when(F.col("o_orderkey") % 25 == 0, F.lit("Entry ID,Release Date\n")).otherwise("")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("e"), "o_orderkey", F.lit(",unknown,"))).otherwise(
        F.concat(F.lit("e"), "o_orderkey", F.lit(",1970-01-01,\ne"), "o_orderkey", F.lit(","), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","))
    )
    t.orders.select(F.concat(header, line).alias("value")).write.text(path)
    return files.read_release_dates(t.spark, path)


def _atom_text(t):
    path = scratch(t.spark, "atoms")
    named = structure_points(t).select(F.col("structure").alias("target"), (F.col("pos") + 1).cast("int").alias("resid"), F.lit("A").alias("resname"), "x", "y", "z")
    files.write_atoms(named, "target", path)
    return path


@query(
    "src09_read_atoms",
    f"WITH {PTS} SELECT structure AS target, CAST(count(*) AS BIGINT) AS residues, CAST(min(pos) + 1 AS INTEGER) AS first_resid, CAST(max(pos) + 1 AS INTEGER) AS last_resid FROM pts WHERE x IS NOT NULL GROUP BY 1",
)
def _(t):
    atoms = files.read_atoms(t.spark, _atom_text(t), named="target")
    return atoms.groupBy(F.col("target").cast("long").alias("target")).agg(
        F.count(F.lit(1)).alias("residues"), F.min("resid").alias("first_resid"), F.max("resid").alias("last_resid")
    )


def _atoms(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("chain"),
        (F.col("l_suppkey") % 2).alias("model"),
        (F.col("l_linestatus") == "F").alias("polymer"),
        F.col("l_linenumber").alias("resid"),
        F.get(F.array(*[F.lit(n) for n in ("A", "C", "DG", "psu", "T", "XX")]), (F.col("l_partkey") % 6).cast("int")).alias("resname"),
        *[F.when(F.col("l_tax") < 0.07, F.col(c)).alias(a) for a, c in (("x", "l_quantity"), ("y", "l_extendedprice"), ("z", "l_tax"))],
        "l_discount",
        "l_partkey",
        "l_extendedprice",
    )
    preference = F.struct((-F.col("l_discount")).alias("o"), "l_partkey", "l_extendedprice")
    return files.canonical_base(rows, "resname"), preference


_ATOMS = """atm AS (SELECT *, CASE upper(resname) WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'DG' THEN 'G' WHEN 'PSU' THEN 'U' WHEN 'T' THEN 'U' ELSE 'N' END AS base FROM (SELECT l_orderkey AS chain, l_suppkey % 2 AS model, l_linestatus = 'F' AS polymer, l_linenumber AS resid, ['A', 'C', 'DG', 'psu', 'T', 'XX'][l_partkey % 6 + 1] AS resname,
  CASE WHEN l_tax < 0.07 THEN l_quantity END AS x, l_discount, l_partkey, l_extendedprice FROM lineitem)), fm AS (SELECT chain, min(model) AS model FROM atm GROUP BY 1),
 rs AS (SELECT * FROM (SELECT atm.*, row_number() OVER (PARTITION BY atm.chain, resid ORDER BY l_discount DESC, l_partkey, l_extendedprice) AS k FROM atm JOIN fm ON fm.chain = atm.chain AND fm.model = atm.model WHERE polymer) WHERE k = 1),
 sm AS (SELECT chain, CAST(count(*) AS BIGINT) AS length, CAST(count(x) AS BIGINT) AS n_resolved, CAST(count(CASE WHEN base = 'N' THEN 1 END) AS BIGINT) AS n_unknown FROM rs GROUP BY 1 HAVING count(x) > 0),
 ok AS (SELECT rs.* FROM rs JOIN sm USING (chain))"""


@query("src10_chains_from_atoms", f"WITH {_ATOMS} SELECT * FROM sm")
def _(t):
    return files.chains_from_atoms(*_atoms(t))[1]


@query(
    "src11_strict_chains",
    f"""WITH {_ATOMS}, s AS (SELECT chain, string_agg(base, '' ORDER BY resid) AS seq, chain % 50 AS file FROM ok WHERE base <> 'N' GROUP BY 1) SELECT file, seq, min(chain) AS chain FROM s GROUP BY 1, 2""",
)
def _(t):
    return files.strict_chains(files.chains_from_atoms(*_atoms(t))[0], F.col("chain") % 50)


@query("src12_canonical_base", f"WITH {_ATOMS} SELECT resname, base, CAST(count(*) AS BIGINT) AS n FROM atm GROUP BY 1, 2")
def _(t):
    return _atoms(t)[0].groupBy("resname", "base").agg(F.count(F.lit(1)).alias("n"))


@query("src12_unmapped_counts", f"WITH {_ATOMS} SELECT resname, CAST(count(*) AS BIGINT) AS n FROM atm WHERE base = 'N' GROUP BY 1")
def _(t):
    return files.unmapped_counts(_atoms(t)[0], "resname")


@query("src13_attach_dates", "SELECT c_custkey AS entry, coalesce(d, DATE '9999-12-31') AS released FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    dates = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("entry")).agg(F.to_date(F.min("o_orderdate")).alias("released"))
    return files.attach_dates(t.customer.select(F.col("c_custkey").alias("entry")), dates, "entry")


@query(
    "src14_unique_library",
    f"""WITH {SEQS}, c AS (SELECT doc_id, regexp_replace(seq, '[^ACGU]', '', 'g') AS seq, n_chars % 365 AS day FROM seqs), k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY day, doc_id) AS r FROM c WHERE length(seq) >= 8) SELECT doc_id, seq, day FROM k WHERE r = 1""",
)
def _(t):
    return files.unique_library(sequences(t).select("doc_id", "seq", (F.col("n_chars") % 365).alias("day")), "seq", "day", "doc_id")


@query("src15_candidate_table", "SELECT vec_id AS candidate, CAST(label AS BIGINT) AS target, CASE WHEN vec_id % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM embeddings WHERE label % 5 <> 0")
def _(t):
    """Saved twice with overlapping keys; targets whose sequence changed since are rejected on load."""
    label = F.col("label").cast("long")
    base = t.embeddings.select(label.alias("target"), F.col("vec_id").alias("candidate"), F.concat(F.lit("S"), label).alias("seq"), F.when(label < 5, "train").otherwise("validation").alias("split"))
    table = files.CandidateTable(t.spark, scratch(t.spark, "candidates"))
    table.save(base.where("candidate % 2 = 0").withColumn("origin", F.lit("first")))
    table.save(base.withColumn("origin", F.lit("second")))
    now = base.select("target", F.when(F.col("target") % 5 == 0, "changed").otherwise(F.col("seq")).alias("seq")).distinct()
    return table.load(now).select("candidate", "target", "origin")


@query(
    "src16_inventory",
    f"""WITH {PTS} SELECT structure, kind, length, resolved_fraction, supported_fraction FROM (SELECT vec_id AS structure, CASE WHEN vec_id % 3 = 0 THEN 'template' ELSE 'pretrained' END AS kind FROM embeddings) JOIN (SELECT structure, CAST(count(*) AS BIGINT) AS length, round(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS resolved_fraction, round(avg(CASE WHEN (structure+pos)%5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS supported_fraction FROM pts GROUP BY 1) USING (structure)""",
)
def _(t):
    candidates = t.embeddings.select(F.col("vec_id").alias("structure"), F.when(F.col("vec_id") % 3 == 0, "template").otherwise("pretrained").alias("kind"))
    points = structure_points(t).withColumn("supported", (F.col("structure") + F.col("pos")) % 5 != 0)
    return rounded(files.inventory(candidates, points, ["structure"]), "resolved_fraction", "supported_fraction")


@query(
    "src17_attach_confidence",
    f"""WITH {CHAIN}, l AS (SELECT chain, pos, CASE WHEN event_id % 4 = 0 THEN 0.5 WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / CASE WHEN event_id % 100 > 1 THEN 100 ELSE 1 END ELSE CAST(event_id % 11 AS DOUBLE) / 11 END AS confidence FROM chain), m AS (SELECT chain, avg(confidence) AS mean FROM l GROUP BY 1),
 s AS (SELECT user_id AS chain, CAST(json_extract(arg_min(props, event_id), '$.k') AS DOUBLE) AS k FROM events GROUP BY 1) SELECT chain, pos, round(confidence, 6) AS confidence, round(CASE WHEN chain % 3 = 0 THEN mean WHEN k > 1 THEN k / 100 ELSE k END, 6) AS global_confidence FROM l JOIN m USING (chain) JOIN s USING (chain)""",
)
def _(t):
    e = F.col("event_id")
    chain = event_chain(t)
    local = chain.where(e % 4 != 0).select("chain", "pos", F.when(e % 2 == 0, (e % 100).cast("double")).otherwise((e % 11) / 11.0).alias("local"))
    sidecar = t.events.groupBy(F.col("user_id").alias("chain")).agg(F.min_by("props", "event_id").alias("json")).where("chain % 3 <> 0")
    rows = files.attach_confidence(chain.select("chain", "pos"), local, sidecar, ["chain"], ["plddt", "k"], 0.5)
    return rounded(rows, "confidence", "global_confidence")


@query(
    "src18_resolve_chain",
    f"""WITH {_ATOMS}, e AS (SELECT chain // 3 AS file, chain, length, CASE WHEN (chain // 3) % 2 = 0 THEN 2 ELSE 4 END AS expected FROM sm), g AS (SELECT file, count(CASE WHEN length = expected THEN 1 END) AS f, sum(length) AS s, max(expected) AS expected, min(CASE WHEN length = expected THEN chain END) AS c FROM e GROUP BY 1)
 SELECT file, CASE WHEN f = 1 THEN 'unique' WHEN s = expected THEN 'concatenated' ELSE 'ambiguous' END AS resolution, CASE WHEN f = 1 THEN c END AS chain FROM g""",
)
def _(t):
    chains = files.chains_from_atoms(*_atoms(t))[1].withColumn("file", F.floor(F.col("chain") / 3))
    expected = chains.select("file").distinct().withColumn("expected", F.when(F.col("file") % 2 == 0, 2).otherwise(4))
    return files.resolve_chain(chains, expected, "file")


def _submission(t):
    ranked = topk.topn(t.embeddings.select(F.col("label").cast("long").alias("target"), F.col("vec_id").alias("structure")), ["target"], [F.col("structure")], 5, rank="slot")
    points = dense_points(t).join(ranked, ["target", "structure"]).select("target", "slot", (F.col("pos") + 1).alias("resid"), F.lit("A").alias("resname"), *[F.round(a, 3).alias(a) for a in "xyz"])
    return files.build_submission(points, "target")


@query(
    "src20_build_submission",
    f"""WITH {DENSE}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS slot FROM embeddings), p AS (SELECT target, pos + 1 AS resid, slot, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM dense JOIN r ON vec_id = structure WHERE slot <= 5)
 SELECT concat(target, '_', resid) AS "ID", 'A' AS resname, resid, """
    + ", ".join(f"max(CASE WHEN slot = {k} THEN {a} END) AS {a}_{k}" for k in range(1, 6) for a in "xyz")
    + " FROM p GROUP BY target, resid",
)
def _(t):
    return _submission(t)


@query("src21_write_csv", "SELECT CAST(count(DISTINCT label) * 21 AS BIGINT) AS rows, CAST(18 AS INTEGER) AS columns FROM embeddings")
def _(t):
    path = scratch(t.spark, "submission")
    files.write_csv(_submission(t), path)
    back = t.spark.read.csv(path, header=True)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(back.columns)).alias("columns"))


@query("src22_template_report", f"WITH {_ATOMS} SELECT CAST(count(*) AS BIGINT) AS chains, CAST(sum(length) AS BIGINT) AS residues, CAST(sum(n_resolved) AS BIGINT) AS resolved, CAST(sum(n_unknown) AS BIGINT) AS unknown, max(length) AS longest FROM sm")
def _(t):
    return files.template_report(files.chains_from_atoms(*_atoms(t))[1])


@query("src23_file_manifest")
def _(t):
    return files.file_manifest(t.spark, t.folder, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "bytes", "sha256")


@query("src25_write_atoms", f"WITH {PTS} SELECT structure AS target, CAST(count(*) AS BIGINT) AS lines FROM pts WHERE x IS NOT NULL GROUP BY 1")
def _(t):
    return t.spark.read.text(_atom_text(t)).groupBy(files.atom_target(F.col("value")).cast("long").alias("target")).agg(F.count(F.lit(1)).alias("lines"))


# ------------------------------------------------------------------ streams


def _stream(t):
    """The events as four files, one micro-batch each, so state, anti-joins and updates meet earlier batches."""
    path = scratch(t.spark, "events")
    t.events.repartition(4, "event_id").write.parquet(path)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(writer, path):
    running = writer.option("checkpointLocation", path).trigger(availableNow=True).start()
    running.awaitTermination()


@query("stm01_resolved_counters", "SELECT user_id, CAST(count(*) AS BIGINT) AS residues, CAST(count(CASE WHEN event_type <> 'error' THEN 1 END) AS BIGINT) AS resolved FROM events GROUP BY 1")
def _(t):
    path = scratch(t.spark, "counters")
    counters = jobs.resolved_counters(_stream(t), ["user_id"], F.col("event_type") != "error")
    # Each batch carries the current counters of the keys it touched; the newest batch of a key wins.
    _drain(counters.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")), f"{path}/log")
    return topk.best_per(t.spark.read.parquet(f"{path}/data"), ["user_id"], -F.col("batch")).select("user_id", "residues", "resolved")


@query("stm02_ingest_if_absent", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def _(t):
    path = scratch(t.spark, "ingest")
    rows = _stream(t).withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    _drain(jobs.ingest_if_absent(rows, ["user_id", "event_type"], "ts", "60 days", f"{path}/data"), f"{path}/log")
    return t.spark.read.parquet(f"{path}/data").select("user_id", "event_type")


@query("stm03_leakage_gate", "SELECT event_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-01' + CAST(user_id % 30 AS INTEGER)")
def _(t):
    path = scratch(t.spark, "gate")
    targets = t.events.select("user_id").distinct().withColumn("cutoff", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 30).cast("int")))
    gated = jobs.leakage_gate(_stream(t).withColumn("day", F.to_date("ts")), targets, "user_id", "day", "cutoff")
    _drain(gated.select("event_id").writeStream.format("parquet").option("path", f"{path}/data"), f"{path}/log")
    return t.spark.read.schema("event_id long").parquet(f"{path}/data")
