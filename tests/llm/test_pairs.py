"""N-gram join, vectors and components against brute force."""

import random
import re

import numpy as np
import pytest

from riskspark.llm import embeddings, ngram_join
from riskspark.llm.components import components
from tests.llm.helpers import ODD, docs_of, prose


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 3000 + k) for k in range(200)]
    links += [(5, 5), (7000, 7000)]
    union = Union({n for e in links for n in e})
    for a, b in links:
        union.join(a, b)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {n: union.find(n) for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(df.limit(0)).count() == 0


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1)
    return " ".join(words)


def sets_of(texts):
    out = {}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        out.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(texts):
    sets = sets_of(texts)
    flat = [(i, s) for i, own in sets.items() if i is not None for s in own]
    union = Union([i for i, _ in flat])
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    sizes = [(i, len(sets[i].pop(0))) for i, _ in texts]
    return sorted(((i, n, union.find(i) if i is not None else None) for i, n in sizes), key=str)


def cases():
    base, passage = [prose(k, 80) for k in range(6)], prose(77, 60)
    texts = [edited(base[k % 6], k, k % 5) for k in range(60)]
    texts += [base[0]] * 5 + [base[0].upper(), "A b C d", "a B c D", "a b c", "x", "x"]
    texts += [passage + " " + prose(200 + k, 12 + k % 30) for k in range(40)]
    texts += [" ".join(prose(300 + k, 20) for k in range(j, j + 10)) for j in range(12)]  # a chain
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    return [(order[k], t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("settings", [{}, {"frequent": 3, "map_bits": 20}, {"hub_rounds": 0, "block": 7, "map_bits": 20}, {"map_bits": 10, "frequent": 2, "hub_rounds": 1}])
def test_ngram_join_equals_brute_force(spark, settings):
    texts = cases() + [(1000 + (i or 0) if i is not None else None, t) for i, t in ODD if t is None or len(t) < 6000]
    if not settings:
        texts += [(3000, "word " * 30_000), (3001, "word " * 20_000), (3002, prose(5, 30_000)), (2, "another text under an id that is already taken")]
    got = ngram_join.near_duplicates(docs_of(spark, texts), limits=ngram_join.Limits(**settings)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(texts)


def test_threshold_is_exact(spark):
    words = [f"w{k}" for k in range(1000)]
    def doc(shared, own):  # `shared` n-grams, then `own` more
        return " ".join(words[:shared + 4] + [f"{own}x{k}" for k in range(own)])
    texts = [(0, doc(80, 0)), (1, doc(80, 20)), (10, " ".join(f"v{k}" for k in range(84))), (11, " ".join([f"v{k}" for k in range(84)] + [f"q{k}" for k in range(21)]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 10: 10, 11: 11}


def test_tree_drops_no_link():
    rng = np.random.default_rng(2)
    for _ in range(20):
        family = rng.integers(0, 2**63, (8, 120)).astype(np.uint64)
        sets = [np.unique(np.concatenate((f[:rng.integers(60, 120)], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)))) for f in family[rng.integers(0, 8, 70)]]
        n = np.array([len(s) for s in sets])
        bits = np.frombuffer(b"".join(ngram_join.signature(s) for s in sets), "<u8").reshape(len(sets), -1)
        order, part = np.argsort(n), np.arange(len(sets))
        tree = ngram_join.Tree(bits[order], n[order], part)
        found = {(order[i], order[j]) for p, q in ngram_join.walk(tree, tree) for i, j in zip(p, q)}
        for i in range(len(sets)):
            for j in range(len(sets)):
                overlap = len(np.intersect1d(sets[i], sets[j]))
                if i != j and ngram_join.linked(overlap, n[i], n[j]):
                    assert (i, j) in found
        assert len(found) < len(sets) ** 2 / 2


def test_one_of_each(spark):
    base = prose(1, 50)
    texts = [(4, base), (2, base), (9, edited(base, 1, 1)), (3, prose(2, 50)), (3, prose(2, 50)), (None, base), (None, None), (6, None), (7, "")]
    docs = docs_of(spark, texts)
    kept = ngram_join.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "6", "7", "None"]  # the null text has no id
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_but_no_text_stay(spark):
    one, two, three = prose(21, 50), prose(22, 50), prose(23, 50)
    texts = [(0, one), (0, two), (0, three), (0, two), (1, edited(two, 1, 1)), (None, three), (None, prose(24, 50)), (None, prose(24, 50)), (5, ""), (5, "")]
    docs = docs_of(spark, texts)
    for rows in (docs, docs.repartition(5)):
        kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(rows).collect()]
        assert sorted(kept, key=str) == sorted([(0, one), (0, two), (0, three), (None, prose(24, 50)), (5, ""), (5, "")], key=str)


def test_copies_that_differ_in_other_columns_leave_one_row(spark):
    rows = [(1, prose(31, 40), f"s{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(ngram_join.one_of_each(df.repartition(n)).collect()) for n in (1, 2, 4)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_links_grow_with_the_sets_not_their_square(spark, monkeypatch):
    base = [prose(40, 120), prose(41, 120)]
    texts = [(k, edited(base[0], k, 1 + k % 2)) for k in range(700)] + [(k, prose(k, 60)) for k in range(700, 900)]
    texts += [(k, base[1][:300] + " " + prose(k, 40)) for k in range(900, 1200)]
    sizes = []
    tree = ngram_join.tree_links

    def counted(keys, sets, limits):
        found = tree(keys, sets, limits)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "tree_links", counted)
    for rounds in (6, 0):
        got = ngram_join.near_duplicates(docs_of(spark, texts), limits=ngram_join.Limits(hub_rounds=rounds)).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(texts)
    assert sizes[0] < len(texts) and sizes[1] < 8 * len(texts), sizes  # 350 of them link pairwise


def test_the_map_of_shared_ngrams_is_never_full(spark):
    texts = [(k, prose(400 + k // 2, 60) + " " + prose(600 + k, 40)) for k in range(200)]  # halves of them are shared, none is a near copy
    docs, limits = docs_of(spark, texts), ngram_join.Limits(map_bits=10)
    maps = ngram_join.occurrence_maps(docs, limits=limits)
    assert np.unpackbits(np.frombuffer(maps[0], np.uint8)).mean() < 0.55
    found = ngram_join.profiles(docs, spark.sparkContext.broadcast(maps)).where("digest is not null").count()
    assert found < len(texts) / 20  # a full map leaves all of them
    bounded = ngram_join.occurrence_maps(docs, limits=ngram_join.Limits(map_bits=10, most_bits=11))
    assert len(bounded[0]) == 2 ** 8


def test_sets_of_equal_texts_are_written_once(spark, monkeypatch):
    base = [prose(50 + k, 80) for k in range(4)]
    texts = [(k, base[k % 4] + (" x" if k % 8 > 3 else "")) for k in range(160)] + [(None, base[0]), (7, base[1]), (7, base[1])]
    written, stage = {}, ngram_join.stage

    def kept(df, name="stage"):
        written[name] = stage(df, name)
        return written[name]

    monkeypatch.setattr(ngram_join, "stage", kept)
    for bits in (26, 10):  # with few bits marks meet
        got = ngram_join.near_duplicates(docs_of(spark, texts), limits=ngram_join.Limits(map_bits=bits)).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(texts)
        assert "values" not in written["profiles"].columns
        assert written["sets"].count() == 8


VECTORS = "vec_id long, embedding array<float>, label int, links long, node long, copies int, cell int, v string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], VECTORS)


def brute_vectors(rows):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    unit = [np.array(r[1], np.float32).astype(float) if sound(r) else None for r in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    union, links = Union({r[0] for r in rows if r[0] is not None}), [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                union.join(rows[i][0], rows[j][0])
    return sorted(((r[0], n, union.find(r[0]) if r[0] is not None else None) for r, n in zip(rows, links)), key=str)


@pytest.mark.parametrize("cells,block", [(embeddings.CELLS, 1024), ((50,), 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(embeddings, "CELLS", cells)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng, rows = np.random.default_rng(3), []
    centers = rng.standard_normal((12, 6))
    for k in range(400):
        x = centers[k % 12] * rng.uniform(0.5, 3) + rng.standard_normal(6) * 0.12
        rows.append((k * 3, [float(v) for v in x.astype(np.float32)], k % 3))
    rows += [(1200 + k, rows[0][1], 0) for k in range(30)] + [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, [2 * v for v in rows[0][1]], 0)]
    bad = float("nan"), float("inf")
    rows += [(5001, None, 0), (5002, [0.0] * 6, 0), (5003, [bad[0]] * 6, 0), (5004, [bad[1], *[1.0] * 5], 0), (5005, [None, *[1.0] * 5], 0), (5006, [], 0)]
    rows += [(5007, rows[0][1], None), (None, rows[0][1], 0), (5008, [1.0, 0.0], 0), (5009, [1.0, 0.01], 0), (5010, [1e30] * 6, 1), (5011, [1e-30] * 6, 1)]
    got = embeddings.near_duplicates(vectors_of(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_given_vectors_and_empty_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
