"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads. It
works on all that its predecessor kept; all but the last return the columns of
the documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm import langid, ngram_join, packing, secrets, toxicity
from riskspark.llm.queries import BYTE_RANKS, WORD_VOCABULARY, table
from riskspark.session import stage

#: A document goes if the mean chance of its language is lower. With four
#: languages none is under 0.25; held-out documents of one language have 0.6 or more.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised.

    Null and empty texts and those without letters go. Rows that repeat, with or
    without an id, stay or go alike; very long texts are judged whole; an empty
    table stays empty; further columns stay.
    """
    model = langid.train(docs, learn=toxicity.remainder("doc_id", 5) != 0)
    return langid.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not toxic.

    Null and empty texts stay. Rows that repeat, with or without an id, stay or
    go alike; very long texts are judged whole; an empty table stays empty;
    further columns stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=toxicity.remainder("doc_id", 3) != 1)
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    That is the one with the smallest id, rows without an id coming last; of one
    id, the one with the smallest hash of its text, then of its columns. Null
    texts and those without words all stay, as do rows that share an id but not
    their texts. Very long texts are compared whole; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows the text.

    No row goes. Null and empty texts stay as they are; rows that repeat change
    alike; very long texts are searched whole; an empty table stays empty.
    """
    clean = secrets.redact(docs, BYTE_RANKS)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences.

    A null or empty text is packed as its closing id alone. Rows that repeat are
    packed each on its own, also without an id; an empty table gives no pieces.
    """
    return packing.digests(packing.pieces(docs, WORD_VOCABULARY))


STAGES = [
    ("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack),
]

#: Two stages are learnt models, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
