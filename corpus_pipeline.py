"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before has written and calls one operator of sourcelens.llm:

1. quality_classifier: documents whose predicted quality is 0 go.
2. line_dedup: lines that too many documents of the same source contain go from the texts.
3. simhash_near_dedup: one document of each near-duplicate class stays.
4. pii: personal data in the texts is replaced by the name of its kind in brackets.
5. best_fit_packing: the texts become pieces, and the pieces sequences.

All but the last return the columns of documents, whatever they are; where a text changes, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import line_dedup, packing, pii, quality_classifier, simhash
from sourcelens.llm.common import free_name, materialize, table
from sourcelens.llm.queries import remainder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the length of text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns as op4 does. Null texts are judged as empty ones; without labels nothing goes."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    score, predicted = free_name(docs, "score", "predicted")
    return quality_classifier.score(docs, model, docs.columns, (score, predicted)).where(F.col(predicted) == 1).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The host is the source. A text whose lines all go stays as an empty one."""
    return _counted(line_dedup.drop_boilerplate(docs.select(docs.columns), counts=False)).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Classes are op7's: fingerprints of three-word shingles that differ in three bits or fewer. Null and
    blank texts are one class."""
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span, plain or disguised, becomes its kind in brackets; null and empty texts stay, no row goes."""
    return _counted(pii.redact_documents(docs)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each text (null and empty ones have one piece of one id), with its slot."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
