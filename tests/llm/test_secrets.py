"""Spans against the patterns read literally."""

import hashlib
import random
import re
import signal
import string

import public_tokenizers

from riskspark.llm import bpe, secrets
from tests.llm.helpers import ODD, docs_of, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text):
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


CASES = [
    'Token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "secret: token: abcdefghijk", "token=token=abcdefgh", "API_KEY : 'abc.de-f' apikey=12345",
    "AKIA" + "B2" * 8 + " AKIAAKIA" + "C" * 11 + " AKIA12", "paſsword=abcdef Key", "é" * 9 + "password=abcdef " + "a" * 24 + "g" + "0" * 23,
    "\U0001F642 passwd = \"\" secret=______ " + "f" * 4000, "tokentoken==abcdef", "token\t= abcdef", "secret" * 500 + "=abcdef",
]


def test_base_spans(spark):
    texts = [*ODD, *((100 + k, t) for k, t in enumerate(CASES))]
    got = {}
    for r in secrets.digests(secrets.find_secrets(docs_of(spark, texts), RANKS)).collect():
        got[r["doc_id"]] = r
    for i, text in texts:
        want = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("token:")] == want
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]


def test_random_strings_are_found_and_names_are_not():
    coder, rng = bpe.Coder.load(RANKS), random.Random(5)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(200)]
    assert sum(bool(secrets.random_spans(f"see {k} here", coder)) for k in keys) >= 198
    for name in [
        "internationalization2024overview", "get_user_by_id_and_name_2", "123e4567-e89b-12d3-a456-426614174000", hashlib.md5(b"x").hexdigest(),
        hashlib.sha256(b"x").hexdigest().upper(), "4111-1111-1111-1111-1111", "-" * 60, "src/main/java/org/example/Test12", prose(1, 60),
    ]:
        assert not secrets.random_spans(f"see {name} here", coder), name


KEYS = {  # alphabet, lengths, least share that is found
    "key": (string.ascii_letters + string.digits, (20, 24, 40), 0.98), "short key": (string.ascii_letters + string.digits, (16, 18), 0.9),
    "base64": (string.ascii_letters + string.digits + "+/", (24, 44), 0.98), "letters": (string.ascii_letters, (20, 32, 40), 0.98),
    "small letters": (string.ascii_lowercase, (24, 32, 40), 0.85), "small letters and digits": (string.ascii_lowercase + string.digits, (20, 32), 0.95),
}


def test_planted_strings_are_found_and_the_texts_around_them_are_not(spark, sf):
    """Recall on random strings of all kinds planted in the given texts, precision on those texts."""
    coder, rng = bpe.Coder.load(RANKS), random.Random(9)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    wrong = [t[a:b] for t in texts for a, b, _ in secrets.random_spans(t, coder)]
    assert wrong == []
    for name, (letters, lengths, least) in KEYS.items():
        met, planted = 0, 0
        for k in range(300):
            text, key = texts[k % len(texts)][:2000], "".join(rng.choice(letters) for _ in range(lengths[k % len(lengths)]))
            if name != "small letters" and key.islower() and key.isalpha():
                continue
            at, planted = len(text) // 2, planted + 1
            found = secrets.random_spans(f"{text[:at]} {key} {text[at:]}", coder)
            met += any(a <= at + 1 + len(key) // 2 < b for a, b, _ in found)
        assert met >= least * planted, (name, met, planted)


def test_identifiers_are_those_of_the_plain_pattern():
    plain, rng = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}|[+/_=-])+"), random.Random(3)
    for _ in range(60_000):
        run = "".join(rng.choice("aabBBC12_/") for _ in range(rng.randint(0, 11)))
        assert bool(plain.fullmatch(run)) == bool(secrets.IDENTIFIER.fullmatch(run)), run


def test_long_letter_and_digit_runs_end_in_time():
    def late(*_):
        raise TimeoutError

    coder, before = bpe.Coder.load(RANKS), signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        for head in ("a" * 60 + "1", "1" * 40, "A" * 60 + "1", "ab" * 3000 + "1", "Ab1" * 3000, "1" * 9000, "_" * 500 + "aB" * 500 + "1"):
            assert not secrets.IDENTIFIER.fullmatch(head + "x")
            secrets.random_spans(f"see {head}x here", coder)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_hex_keys_and_keys_in_paths_are_found():
    coder, key = bpe.Coder.load(RANKS), "q7Zt0Xv9LmPb3RkW8sYdT2nG"
    for run in ("3F9A0C7E51D8B2469E0F7A1C", "3F9A0C7E51D8B2469E0F7A1C5B"):
        assert [run] == [f"see {run} here"[a:b] for a, b, _ in secrets.random_spans(f"see {run} here", coder)]
    words = "documentation/international/applications/organization/management/information/development"
    for run in (f"{words}/{key}", words.replace("/", "_") + f"-{key}", f"{words}/token_value={key}/{words}"):
        assert [key] == [run[a:b] for a, b, _ in secrets.random_spans(run, coder)], run


def test_redaction_keeps_all_else(spark):
    key = "q7Zt0Xv9LmPb3RkW8sYd"
    docs = docs_of(spark, [(1, f"a token = {key} b"), (2, "clean text"), (3, None), (4, f"{key}{key}")])
    clean = {r["doc_id"]: r for r in secrets.redact(docs, RANKS).collect()}
    assert [clean[i]["text"] for i in (1, 2, 3, 4)] == ["a [SECRET] b", "clean text", None, "[SECRET]"]
    assert secrets.redact(docs, RANKS).schema == docs.schema


def test_empty_table(spark):
    none = docs_of(spark, ["a"]).limit(0)
    assert secrets.digests(secrets.find_secrets(none, RANKS)).count() == 0 and secrets.redact(none, RANKS).count() == 0
