"""The corpus pipeline: select by quality, drop repeated line runs, keep one of near duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, importance, jaccard, lines, mixing
from tidemark.llm.common import Scratch, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; what isn't sampled goes.

    Null and empty texts have weight 0 and compete like others; rows that share a doc_id draw the same noise.
    """
    return importance.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of lines out of the texts; every document stays, ``n_chars`` follows its text.

    Null texts stay null; rows without a doc_id stay as they are; rows that share one keep what the first keeps.
    """
    out = lines.drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group linked by a Jaccard of 0.8 or more on five-word shingles.

    Copies of whole documents come here emptied by the stage before: of the empty texts the least doc_id stays as well.
    Null texts and rows without a doc_id stay; rows that share a doc_id are one document.
    """
    least = docs.where("text = ''").agg(F.min("doc_id")).first()[0]
    docs = docs.where((F.coalesce(F.col("text"), F.lit("null")) != "") | F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(least)))
    return jaccard.keep_one(docs, k=5, num=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a row for each pass over a document's words.

    Documents without words stay once; a null source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests, and the text decoded from them. Null texts have no ids."""
    return bpe.encode_documents(docs, bpe.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Hashed models, rolling hashes and BPE merges aren't SQL: each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one is written; the last one's is read lazily."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tmp.write(docs, str(i))
            if i:
                tmp.drop(str(i - 1))
    return docs
