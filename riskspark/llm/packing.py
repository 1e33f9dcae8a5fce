"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits
of n, after as many pieces of the full length as fit. Every piece is a training
sequence of its own: its length is a power of two, so nothing is padded, and no
sequence holds two documents. Batches are made inside a bucket of equal
lengths.

Nothing is shuffled. A piece's ids depend on its document alone, and its
sequence number on the partition and place it is read from, so a task that
runs again gives the same rows.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.tokens import WordTokens

LENGTH = 2048
#: Closes every document.
END = 1

PIECES = "doc_id {id}, start long, length long, doc_tokens long, ids binary"


def cuts(n: int, most: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces of at most `length` tokens.

    One row per piece: doc_id, start (ids before it), length, doc_tokens, ids
    (little-endian unsigned 32-bit), bucket (log2 of the length), sequence_id,
    offset (0: each piece is a sequence). `length` must be a power of two;
    `tokenizer` is the path of a tokenizers file that each task opens.

    A null or empty text is the end token alone: one piece of length 1. Null
    and repeated ids are kept, each row on its own. An empty table gives none.
    Other columns are ignored. A very long text takes memory for its own
    tokens only.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType

    def cut(batches):
        tokens, end = WordTokens.load(tokenizer), np.uint32(END).tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            size = 0
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = tokens.packed(text or "") + end
                n, start = len(ids) // 4, 0
                for part in cuts(n, length):
                    for out, value in zip(rows, (key, start, part, n, ids[4 * start:4 * (start + part)])):
                        out.append(value)
                    start += part
                size += len(ids)
                if size > 8_000_000:
                    yield _table(rows, batch.schema.field(0).type)
                    rows, size = ([], [], [], [], []), 0
            if rows[0]:
                yield _table(rows, batch.schema.field(0).type)

    found = source.mapInArrow(cut, PIECES.format(id=id_type.simpleString()))
    return (
        found.withColumn("bucket", F.round(F.log2("length")).cast("int"))
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def _table(rows, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array([k.as_py() for k in rows[0]], id_type), *(pa.array(r, pa.int64()) for r in rows[1:4]), pa.array(rows[4], pa.binary())],
        names=["doc_id", "start", "length", "doc_tokens", "ids"],
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as a table with one folder per length."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket",
    )
