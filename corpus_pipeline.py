"""A corpus pipeline of four stages, each calling one operator of sheafworks.llm.

Quality rules drop documents and boilerplate lines; of near copies (five-word shingles, similarity 0.8) the document
with the smallest id stays; passages that an earlier document holds are cut; what is left is packed into sequences.

All stages take documents (doc_id, text, source and any other columns, whatever their names) and, but for the last, give
documents with the same columns. An empty table gives an empty one. Texts of any length are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm import jaccard, packing, quality, suffixes
from sheafworks.llm.common import documents, stash


#: The last token of each document; no word is one.
END = "\n"


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it is a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts go, for they have too few words. A null source is a host of its own. Null ids play no
    part in the rules but are not the first of a line's documents. Repeated rows are judged alike, each as a document."""
    return recounted(quality.keep(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are near nothing and stay. Of a group the smallest id stays, never a null one if there is
    another; rows with a null id all stay. Rows that share an id are kept or dropped together, so that repeated rows stay."""
    return jaccard.keep(docs, width=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text comes back empty. Documents that lose all their text go: of repeated rows all but the first. Null ids
    come after all others; other ties go by the place in the input."""
    return recounted(suffixes.strip(docs, 100))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' words, each document with an end mark: bin_id, capacity, n_tokens, doc_ids, starts,
    offsets, tokens. A null or empty text is its end mark alone. Null and repeated ids are packed row by row."""
    return packing.sequences(docs.select("doc_id", F.array_append(quality.words(F.coalesce("text", F.lit(""))), F.lit(END)).alias("tokens")), "tokens", mark=" ")


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("sequences", sequences)]
#: SQL has no best-fit packing and no suffix order; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
