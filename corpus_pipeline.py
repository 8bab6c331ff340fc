"""From raw documents to a training mix: each stage works on all that the one before it kept.

1. toxicity: documents that score 0.7 or more go.
2. near_duplicates: of each group of near copies the document with the smallest doc_id stays.
3. decontamination: documents of which a twentieth or more are benchmark windows go; others lose the words of such windows.
4. personal_data: spans of personal data in the texts are replaced by their kind.
5. mixing: the training mix itself. Documents behind a source's cut are gone, the one at the border ends at its word, and
   whole passes over a source repeat its documents; size, source_size, target, taken and copy are added.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names are handled as
the stages' operators state it: a null text is clean, has no words to hit and none to redact, and is taken 0 times by the mix; a
null or repeated doc_id is a document of its own but for near copies; an empty table gives an empty mix. Only columns named
like those that mixing adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import decontam, mixing, pii, simhash, toxicity
from pricelens.llm.common import lineage_cut, table

#: Rows that go to a Python worker at once: texts may be long, and workers keep the memory that a batch once took.
BATCH_ROWS = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size, for what it runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Toxicity and personal data are trained models, and simhash needs XXH64: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = lineage_cut(docs)
    return docs
