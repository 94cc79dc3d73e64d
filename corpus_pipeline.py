"""A corpus pipeline of five stages; each stage's output is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import decontam, packing, simhash, substring, toxicity
from assayline.llm.common import durable, table
from assayline.llm.queries import held_out


def _others(docs: DataFrame) -> Column:
    """All columns but doc_id and text in one, so that their names clash with none of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("others")


def _as_before(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic.

    Each row is judged by its own text, also where ids repeat or are null. Null
    and empty texts have the share of toxic rows among such as their score.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _others(docs))
    found = toxicity.scores(rows, labels, ~held_out(4, 2), carry=("text", "others")).where("predicted = 0")
    return _as_before(found.select("doc_id", F.col("text").cast("string").alias("text"), "others"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id; rows with a null doc_id stay.

    Texts without words are one group. Repeated ids are told apart by their texts.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that a smaller doc_id has too go from the texts; all rows stay, those cut with the length they have left.

    Null, empty and short texts and rows with a null doc_id stay as they are.
    """
    cut = substring.remove_repeats(docs.select("doc_id", "text", _others(docs)), carry=["others"])
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    others = F.when(F.size("spans") > 0, F.col("others").withField("n_chars", n_chars)).otherwise(F.col("others"))
    return _as_before(cut.select("doc_id", "text", others.alias("others")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows go of which benchmark passages are a twentieth or more of the words.

    Each row is judged by its own text, also where ids repeat or are null; null
    and empty texts have no words and stay.
    """
    rows = docs.select("doc_id", "text", F.struct(F.col("text").alias("t"), _others(docs)).alias("row"))
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), carry=("row",)).where("not contaminated")
    return _as_before(found.select("doc_id", F.col("row.t").alias("text"), F.col("row.others").alias("others")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows packed into sequences; null and empty texts are one end id each, repeated rows are packed each for itself."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", cut_repeats), ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

#: Scoring, near-duplicates and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages leave, packed. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
