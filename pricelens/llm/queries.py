"""The registered queries of the training-data operators: thin wrappers with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import align, ann, decontam, html_text, lm, mixing, pii, quality, secrets, simhash, toxicity, trie, warc
from pricelens.llm.common import lineage_cut, shared_folder, table
from pricelens.llm.sql import ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(lineage_cut(quality.votes(quality.word_stats(docs)).drop("text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def _spans(column, kinds=None):
    """kind:start:end of each span, comma-joined; of the given kinds only."""
    part = F.filter(column, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(column)
    return F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(column, kind):
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.KINDS[:3]
    return found.select("doc_id", *[_count("secrets", k) for k in base], F.sha2(_spans("secrets", base), 256).alias("base_sha256"), _spans("secrets").alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("base", k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("pii").alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(lm.in_training()))
    held = (~lm.in_training()).alias("held_out")
    scored = lm.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES
