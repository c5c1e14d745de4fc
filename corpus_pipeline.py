"""A corpus pipeline: language ID, line dedup, near-duplicate join, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents. Between stages the rows are written as Parquet to the shared folder and read again, so a lost executor costs no
more than the running stage.

Defined cases: null texts have no language and go in the first stage; an empty table passes through; columns beyond those
of documents are not carried; repeated rows of one doc_id count as one document, and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec
from keyloom.llm.common import scratch, stored, table
from keyloom.llm.queries import crc_rest, piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this confidence the text is in none of the languages learned.
LEAST_SCORE = 0.2
#: Ids are broadcast up to this many; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    model = language_id.learn(docs.filter(F.coalesce(crc_rest(3), F.lit(0)) != 1))
    out = language_id.identify(docs.select(*COLUMNS), model)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    linked = jaccard_join.link_components(docs)
    gone = stored(linked.filter("doc_id != component_id").select("doc_id").distinct(), scratch(spark), "gone")
    return docs.select(*COLUMNS).join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    docs = docs.select(*COLUMNS)
    return decontaminate.remove(docs, decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return sentencepiece_codec.encode_digests(docs, piece_model())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
