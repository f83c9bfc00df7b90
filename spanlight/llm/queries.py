"""The pN_ queries on texts, each over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import bpe, packing, toxicity
from spanlight.session import table


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select(*columns)


# -- 6: encoding ------------------------------------------------------------------------------------------
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(documents(spark, sf, "doc_id", "text"), "doc_id", "text", "byte_bpe_50k")


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per language and source."""
    counts = bpe.count_tokens(documents(spark, sf, "doc_id", "text"), "doc_id", "text", "byte_bpe_50k")
    about = documents(spark, sf, "doc_id", "lang", "source")
    return counts.join(about, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))


# -- 7: packing -------------------------------------------------------------------------------------------
def _packed(spark: SparkSession, sf: str) -> DataFrame:
    budgets = [(r.budget_id, r.tokenizer, r.capacity_tokens) for r in table(spark, sf, "pack_budgets").orderBy("budget_id").collect()]
    counts = {
        t: packing.stored_counts(bpe.count_tokens(documents(spark, sf, "doc_id", "text"), "doc_id", "text", t))
        for t in sorted({b[1] for b in budgets})
    }
    return packing.pack_budgets(counts, "doc_id", "n_tokens", budgets)


def p7_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """``budget_id, container_id, doc_id, piece, start, size``: where every text, or piece of a text, goes."""
    return _packed(spark, sf)


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, per budget."""
    budgets = table(spark, sf, "pack_budgets").select("budget_id", "capacity_tokens")
    used = _packed(spark, sf).groupBy("budget_id", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return (
        used.groupBy("budget_id")
        .agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
        .join(F.broadcast(budgets), "budget_id")
        .withColumn("unused_tokens", F.col("n_containers") * F.col("capacity_tokens") - F.col("n_tokens"))
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    )


# -- 8: abusive content -----------------------------------------------------------------------------------
def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, score, insult, threat, demeaning, sexual, flagged`` of every document."""
    docs = documents(spark, sf, "doc_id", "text")
    chain = toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf, "doc_labels")))
    return toxicity.score_documents(docs, chain)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_scores(spark, sf).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged documents and mean scores per source; a null source is a group of its own."""
    scored = p8_scores(spark, sf).join(documents(spark, sf, "doc_id", "source"), "doc_id")
    return scored.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (p6_ids, p6_counts, p7_assignments, p7_fill, p8_found, p8_scores, p8_rates)}
