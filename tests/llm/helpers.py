"""Small tables with every odd case, and brute-force parts shared by tests."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, start long, length int, ids string, bucket string, "
    "row long, n string, score string, kept string, key long, node long, part long, id long, rows long, value double"
)
PAD = (None,) * 14


def docs_of(spark, texts, langs=None, first_id=0):
    """Documents of (id, text) pairs or texts, with columns that clash with names used inside."""
    rows = [t if isinstance(t, tuple) else (first_id + k, t) for k, t in enumerate(texts)]
    langs = langs or [None] * len(rows)
    return spark.createDataFrame([(i, t, lang, None, None, *PAD) for (i, t), lang in zip(rows, langs)], DOCS)


ODD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "a"), (3, "a"), (None, "no id here, but a text of several words"), (4, "é" * 5000),
    (5, "word " * 30_000), (6, "Ünïcode ß ½² İ 漢字かな 🙂 <|endoftext|> it's 'RE\x0bx\x1c"), (-7, "\n\n\n"), (8, "x" * 70_000), (9, "１２ ١٢٣ a_b__c"),
]


def prose(seed, words, letters="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(words))
