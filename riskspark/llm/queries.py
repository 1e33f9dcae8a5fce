"""The operators as queries over the given tables."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm import bpe, chat, decontaminate, embeddings, langid, ngram_join, packing, periodic, quality, secrets, spelling, toxicity, warc
from riskspark.llm.oracle import CONTROL, oracle_sql  # noqa: F401
from riskspark.session import shared_dir

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a URI."""
    folder = shared_dir(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def op1_packing(spark, sf_dir):
    return packing.digests(packing.pieces(table(spark, sf_dir, "documents"), WORD_VOCABULARY))


def op2_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.examples(rows.unionByName(extra)))


def op3_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    remainder = toxicity.remainder("doc_id", 5)
    found = langid.identify(docs, langid.train(docs, learn=remainder != 0))
    return found.select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score")


def op5_secrets(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents"), BYTE_RANKS))


def op6_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS), BYTE_RANKS)


def op7_warc(spark, sf_dir):
    packages = warc.write(table(spark, sf_dir, "pages"), shared_uri(spark, "warc"))
    return warc.digests(warc.read(packages))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = toxicity.remainder("doc_id", 3)
    model = toxicity.train(docs, labels, learn=remainder != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder == 1).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"),
        F.size("sentences").alias("n_offending"),
    )


def op10_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"), drop_every=31)


def op12_periodic(spark, sf_dir):
    return periodic.digests(periodic.find_runs(periodic.with_repeats(table(spark, sf_dir, "documents"))))


def op13_decontaminate(spark, sf_dir):
    return decontaminate.digests(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def queries():
    return {f.__name__: f for f in (
        op1_packing, op2_chat, op3_quality, op4_language, op5_secrets, op6_bpe, op7_warc, op8_ngram_join, op9_toxicity, op10_embeddings, op11_spelling, op12_periodic, op13_decontaminate,
    )}
