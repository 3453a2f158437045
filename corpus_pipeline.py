"""Five stages from raw documents to token ids. Each stage gets what the one before kept, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainwright.llm import bpe, decontaminate, jaccard, language, pii
from chainwright.session import stash

#: A document whose main language has a smaller share is rejected.
MIN_SHARE = 0.5
#: Near copies share so many per cent of their shingles of so many words.
COPY_WIDTH, COPY_PERCENT = 5, 80


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a main language; the model learns from all labelled ones."""
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.representatives(docs, width=COPY_WIDTH, percent=COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; the number of characters follows."""
    masked = pii.redact(docs.withColumn("_before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    return masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_language),
    ("near_copies", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", tokenize),
]
#: The mixture model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
