"""Secrets in texts: fixed patterns, and strings that tokenise badly.

A byte-pair vocabulary spells words and identifiers with few tokens and random
characters with many. A run of key characters that needs a token for every two
or so characters is a candidate; how few characters a token may spell depends on
the run's length and kinds of characters. Known digests, identifiers, numbers
and addresses are set aside then.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.bpe import Coder

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "token")

#: The three base patterns.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Most characters that a token spells on average: (shortest run, limit) of runs
#: with letters and digits, of letters in both cases, and of letters in one case.
#: Of random runs as long, nine in ten and more are under it (see README).
WITH_DIGITS = ((20, 2.2), (16, 1.8))
MIXED_LETTERS = ((20, 2.0),)
PLAIN_LETTERS = ((24, 1.9),)
LEAST_CHARS = 16
#: Characters that a token of a name spells on average, at least.
NAME_PER_TOKEN = 1.7

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
#: Digests (hex digits in one case, as many as a digest has), UUIDs, numbers with separators.
KNOWN = re.compile(
    "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in (32, 40, 48, 56, 64, 96, 128)) + r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+"
)
#: Where a run is cut if it is not found whole: paths and assignments first, then all separators.
SEPARATORS = (re.compile(r"[^/=]+"), re.compile(r"[^+/_=-]+"))
#: Words, perhaps with a number, put together by case, underscore, hyphen or slash.
#: Whole runs of a kind are taken and never given back, so the time is linear.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++|[+/_=-])++")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _limit(run: str) -> float:
    """Most characters a token of the run may spell if the run is to be random; 0 for runs that are not looked at."""
    plain = run.islower() or run.isupper()
    kinds = WITH_DIGITS if any(map(str.isdigit, run)) else PLAIN_LETTERS if plain else MIXED_LETTERS
    return next((limit for least, limit in kinds if len(run) >= least), 0.0)


def random_spans(text: str, coder: Coder) -> list[tuple[int, int, str]]:
    """(start, end, "token") of runs, or parts of them, that the vocabulary spells with many tokens."""
    found = []

    def look(start: int, end: int, cuts) -> None:
        run = text[start:end]
        limit = _limit(run) if any(map(str.isalpha, run)) else 0.0
        tokens = len(coder.bpe.encode_ordinary(run)) if limit else 0
        if limit and len(run) <= limit * tokens and not _known(run, len(run) / tokens):
            found.append((start, end, "token"))
        elif cuts and len(run) > LEAST_CHARS:
            for m in cuts[0].finditer(run):
                if m.end() - m.start() >= LEAST_CHARS:
                    look(start + m.start(), start + m.end(), cuts[1:])

    for m in CANDIDATE.finditer(text):
        look(m.start(), m.end(), SEPARATORS)
    return found


def _known(run: str, per_token: float) -> bool:
    """Digests, numbers, and identifiers. Random letters may look like a name, so of these only what tokens spell well is one."""
    if KNOWN.fullmatch(run):
        return True
    plain = run.isalpha() and (run.islower() or run.isupper())
    return not plain and per_token > NAME_PER_TOKEN and bool(IDENTIFIER.fullmatch(run))


def find_secrets(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of start, end, kind, base).

    Positions are code points, ends exclusive, ordered by start and then kind.
    `ranks` is the path of a tiktoken rank file. A null or empty text has no
    spans; null and repeated ids are kept, each row on its own; other columns
    are ignored. Spans of the token test may overlap base spans, which always
    stay. An empty table gives no rows. Whole texts are searched, very long ones
    too, in time linear in their length, in one pass without a shuffle.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    rank = {k: n for n, k in enumerate(KINDS)}

    def scan(batches):
        coder = Coder.load(ranks)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) + random_spans(text, coder) if text else []
                spans.sort(key=lambda s: (s[0], rank[s[2]]))
                rows.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return source.mapInArrow(scan, schema)


def redact(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark`; overlapping spans by one.

    All other columns and texts without a span stay as they are, null and empty
    texts among them. Repeated rows change alike. An empty table gives no rows.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(text: str, coder: Coder) -> str:
        spans = sorted(base_spans(text) + random_spans(text, coder))
        parts, end = [], 0
        for start, stop, _ in spans:
            if start >= end:
                parts += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*parts, text[end:]]) if spans else text

    def scan(batches):
        coder = Coder.load(ranks)
        for batch in batches:
            texts = [t and clean(t, coder) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(scan, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "token")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"), F.size(of("token")).cast("long").alias("n_token"),
    )
