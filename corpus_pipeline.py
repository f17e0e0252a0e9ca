"""The corpus pipeline: STAGES over documents, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet to the shared folder and reads it again for the next one. All but the last
return the columns of documents. Null or empty texts go at the first stage (``und``);
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontaminate, language, pii, similar
from larder.llm.columns import column, row, unpacked
from larder.llm.staging import small_batches, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose n-grams are almost all unknown to every profile are not in a known language.
LEAST_SCORE = 0.05


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside row, which holds all others, so that no column that an operator adds is theirs."""
    return docs.select(row(docs, names), *map(column, names))


def _together(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, the changed ones as they are now."""
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known; those without a language get the predicted one."""
    small_batches(spark)
    profiles = language.train(docs.where(~language.held_out()))
    told = language.predict(_apart(docs, "text", "lang"), profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _together(told, docs, text=F.col("text"), lang=F.coalesce("lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of the smallest doc_id."""
    small_batches(spark)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), row(docs)), "rows")
    groups = similar.similar_groups(rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")))
    gone = stage(groups.where("rid <> first_rid").select("rid"), "gone")
    return rows.join(gone, "rid", "left_anti").select(*unpacked(docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, not even an edited one."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(_apart(docs, "text"), items)
    return _together(found.where(F.size("leaks") == 0), docs, text=F.col("text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text; n_chars follows."""
    small_batches(spark)
    redacted = pii.redact(_apart(docs, "text"), pii.train(docs))
    return _together(redacted, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the text that they decode to, and the digests of both."""
    small_batches(spark)
    coded = bpe.round_trip(docs)
    digest = {c: coded_column for c, coded_column in (("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)), ("decoded_sha256", F.sha2("decoded", 256)))}
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", *[v.alias(k) for k, v in digest.items()])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("tokens", encode),
]
#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
