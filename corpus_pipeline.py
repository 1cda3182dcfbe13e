"""A corpus in five stages: toxicity, quality, near duplicates, shared passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and all but the last return the columns of docs. Null texts count as empty, rows
that repeat an id and rows without one are judged like others, other columns are
carried along whatever their names, and an empty table gives an empty one; what a
stage makes of them is said at the stage. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import near_dedup, packing, quality, substring, toxicity
from tideline.llm.queries import held_out, table, vocabulary
from tideline.llm.storage import scratch, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored 0.5 or more. Null and empty texts have the score of a text without any feature; without labels all documents stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.scored(docs, model, score="_score").where("_score < 0.5").select(*docs.columns)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules on repetition reject: null, empty and very short texts are among them."""
    return quality.repetition(docs, prefix="_q_", carry=docs.columns).where("_q_kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows without an id stay, as do all rows of an id that is kept."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("id").alias("doc_id"))
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of passages that an earlier document has; documents that lose every word go, those that never had one stay.

    A document that loses nothing keeps its text as it is (null becomes empty); the
    words that others keep are joined by spaces.
    """
    cut = substring.remove_duplicates(docs, full=True, carry=[c for c in docs.columns if c != "text"], prefix="_s_").where("_s_n_removed = 0 or _s_n_removed < _s_n_words")
    left = cut.withColumn("text", F.col("_s_text"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_s_n_removed") > 0, F.length("_s_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_repetitive), ("near duplicates", drop_near_copies), ("shared passages", cut_passages), ("packing", pack)]

#: The toxicity classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. What stages store on their way is removed when the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = stored(stage(spark, docs, sf_dir))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
