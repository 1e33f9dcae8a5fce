"""Byte-pair encoding of whole texts, and decoding.

A text of more than `long_chars` is cut into leaves at any place, which tasks
encode in parallel, and joined again as a tree from its leaves' ids alone:
around each join a window is encoded again, and grows until both sides agree.

* Within words, numbers and spaces, a window ends where the vocabulary's
  splitting pattern always cuts, before a white-space character that follows
  another kind of character, and its first and last tokens must be tokens of the
  left and the right part. What lies outside has the same ids in the whole text.
* A long piece that the pattern does not cut has leaves of its own. Neighbouring
  tokens of one piece depend on each other only in pairs, so a window whose
  first and last tokens agree makes the joined sequence the piece's encoding.

Shorter texts are encoded where they are read.
"""

import base64
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskspark.llm import arrow

#: Texts with more characters are encoded by several tasks.
LONG_CHARS = 16_384
#: Characters in a leaf.
LEAF_CHARS = 4_096
#: Bytes of text that a task turns into ids at once.
BATCH_BYTES = 2_000_000
#: Tokens on either side of a join in the first window; doubled until it agrees.
WINDOW = 8

#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: its one special token.
SPECIAL = {"<|endoftext|>": 50256}

#: Between a character that is no white space and one that is, for every reading of white space.
SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")

_loaded: dict[str, "Coder"] = {}


class Coder:
    """Encodes and decodes with a file of ranks (base64 token, id)."""

    @classmethod
    def load(cls, path: str) -> "Coder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.piece = self.bpe._core_bpe.encode_single_piece
        self.split = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, SPECIAL)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens' strings stand for these."""
        return self.bpe.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        return self.bpe.decode_bytes(list(ids)).decode("utf-8", "replace")

    def bytes(self, ids) -> bytes:
        return self.bpe.decode_bytes(list(ids))

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """Ids of one unsplit piece from those of its two parts."""
        if not left or not right:
            return left or right
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            middle = self.piece(self.bytes(left[a:]) + self.bytes(right[:b]))
            starts = a == 0 or middle[0] == left[a]
            ends = b == len(right) or middle[-1] == right[b - 1]
            if starts and ends:
                return left[:a] + middle + right[b:]
            window *= 2

    def join_text(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """Ids of a text from those of its two parts, cut anywhere."""
        if not left or not right:
            return left or right
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            while a > 0 and not self.safe(left, a):
                a -= 1
            while b < len(right) and not self.safe(right, b):
                b += 1
            middle = self.bpe.encode_ordinary((self.bytes(left[a:]) + self.bytes(right[:b])).decode())
            starts = a == 0 or middle[0] == left[a]
            ends = b == len(right) or middle[-1] == right[b - 1]
            if starts and ends:
                return left[:a] + middle + right[b:]
            window *= 2

    def safe(self, ids: list[int], k: int) -> bool:
        """Whether the pattern cuts before the k-th token whatever stands around."""
        return self.bytes(ids[k:k + 1])[0] in b" \n\t\r" and 0x20 < self.bytes(ids[k - 1:k])[-1] < 0x7F

    def segments(self, text: str):
        """(part, whether it is a special token) in order."""
        at = 0
        for found in self.special.finditer(text):
            if found.start() > at:
                yield text[at:found.start()], False
            yield found.group(), True
            at = found.end()
        if at < len(text):
            yield text[at:], False


def stretches(text: str, leaf: int) -> list[str]:
    """Cut at safe places into parts of about `leaf` characters, or longer ones where there is none."""
    parts, at = [], 0
    while len(text) - at > leaf:
        found = SAFE.search(text, at + leaf)
        if not found:
            break
        parts.append(text[at:found.start()])
        at = found.start()
    return [*parts, text[at:]]


def leaves(text: str, coder: Coder, leaf: int = LEAF_CHARS) -> list[tuple[bytes, str]]:
    """A long text as (part, kind) for encoding apart.

    kind is `text` and then `more` (text to be joined to the one before),
    `special`, or, for a long piece that is not cut, `first` and then `next`.
    """
    out: list[tuple[bytes, str]] = []
    for segment, special in coder.segments(text):
        if special:
            out.append((segment.encode(), "special"))
            continue
        held: list[str] = []
        for stretch in stretches(segment, leaf):
            if len(stretch) <= 2 * leaf:
                held.append(stretch)
                continue
            out += _cut("".join(held), leaf) + _unsplit(coder.split.findall(stretch), leaf)
            held = []
        out += _cut("".join(held), leaf)
    return out


def _cut(text: str, leaf: int) -> list[tuple[bytes, str]]:
    """Text in parts of `leaf` characters, wherever that cuts it."""
    return [(text[k:k + leaf].encode(), "more" if k else "text") for k in range(0, len(text), leaf)]


def _unsplit(pieces: list[str], leaf: int) -> list[tuple[bytes, str]]:
    """Pieces of a stretch, short ones together, long ones in parts."""
    out, short, size = [], [], 0
    for piece in [*pieces, None]:
        if short and (piece is None or size + len(piece) > leaf):
            # White space at the end stands alone: with white space before it, it would be read as one piece.
            apart = [short[:-1], short[-1:]] if len(short) > 1 and short[-1].isspace() else [short]
            out += [("".join(own).encode(), "text") for own in apart]
            short, size = [], 0
        if piece is not None and len(piece) > leaf:
            data = piece.encode()
            out += [(data[k:k + leaf], "next" if k else "first") for k in range(0, len(data), leaf)]
        elif piece is not None:
            short.append(piece)
            size += len(piece)
    return out


def joined(coder: Coder, parts: list[tuple[str, list[int]]]) -> list[int]:
    """One text's ids from its encoded leaves, joined pairwise as a tree."""
    ids: list[int] = []
    k = 0
    while k < len(parts):
        run, join = [parts[k][1]], coder.join if parts[k][0] == "first" else coder.join_text
        k += 1
        while k < len(parts) and parts[k][0] in ("next", "more"):
            run.append(parts[k][1])
            k += 1
        while len(run) > 1:
            run = [join(run[i], run[i + 1]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        ids += run[0]
    return ids


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text",
           long_chars: int = LONG_CHARS, leaf: int = LEAF_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit).

    `ranks` is the path of a file of token ranks. A null or empty text has no
    ids. Null and repeated ids are kept, each row on its own. Other columns are
    ignored. An empty table gives no rows. Texts of more than `long_chars`
    characters are encoded as leaves in parallel, all others where they are read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"

    def short(batches):
        coder = Coder.load(ranks)
        for whole in batches:
            for i, j in arrow.slices(arrow.utf8(whole.column(1))[1], BATCH_BYTES):
                batch = whole.slice(i, j - i)
                ids = [np.array(coder.encode(t), "<u4") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    def cut(batches):
        coder = Coder.load(ranks)
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                key = batch.column(0).slice(row, 1)
                text_key = batch.column(2)[row].as_py()
                parts = leaves(text, coder, leaf)
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array([0] * len(parts))), pa.array([text_key] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()),
                     pa.array([k for _, k in parts]), pa.array([p for p, _ in parts], pa.binary())],
                    names=["doc_id", "row", "leaf", "kind", "part"],
                )

    def code(batches):
        coder = Coder.load(ranks)
        for batch in batches:
            ids = []
            for kind, part in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if kind == "special":
                    got = [SPECIAL[part.decode()]]
                else:
                    got = coder.bpe.encode_ordinary(part.decode()) if kind in ("text", "more") else coder.piece(part)
                ids.append(np.array(got, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["doc_id", "row", "leaf", "kind", "ids"])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        coder = Coder.load(ranks)
        rows = rows.sort_values("leaf")
        ids = joined(coder, [(k, np.frombuffer(i, "<u4").tolist()) for k, i in zip(rows["kind"], rows["ids"])])
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].to_numpy(), "n_tokens": [len(ids)], "ids": [np.array(ids, "<u4").tobytes()]})

    id_type = source.schema["doc_id"].dataType.simpleString()
    few = source.where(F.length("text") <= long_chars).mapInArrow(short, schema)
    many = (
        source.where(F.length("text") > long_chars).withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"doc_id {id_type}, row long, leaf long, kind string, part binary")
        .repartition(F.col("row"), F.col("leaf"))
        .mapInArrow(code, f"doc_id {id_type}, row long, leaf long, kind string, ids binary")
        .groupBy("row").applyInPandas(merge, schema)
    )
    return few.unionByName(many)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each row's ids; null ids give a null text."""
    at, names = encoded.columns.index(ids_col), encoded.columns
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != out_col], T.StructField(out_col, T.StringType())])
    keep = [c for c in names if c != out_col]

    def texts(batches):
        coder = Coder.load(ranks)
        for batch in (b.slice(i, j - i) for b in batches for i, j in arrow.slices(arrow.utf8(b.column(at))[1], BATCH_BYTES)):
            found = [None if i is None else coder.decode(np.frombuffer(i, "<u4").tolist()) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(found, pa.string())], names=[*keep, out_col])

    return encoded.mapInArrow(texts, schema)



def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """Per document, digests of its ids and of the text decoded from them."""
    return decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
