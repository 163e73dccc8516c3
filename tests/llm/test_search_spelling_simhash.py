"""Impact search, spelling groups and SimHash groups against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumentrail.llm import impact_search as search
from lumentrail.llm import registry, simhash, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def test_adder_and_largest_are_arithmetic():
    rng = np.random.default_rng(1)
    total, sums = np.zeros(700, np.int64), np.zeros((45, 11), np.uint64)
    for n in (1, 3, 500, 699):
        places = np.sort(rng.choice(700, n, replace=False))
        impacts = rng.integers(1, 1 << 38, n)
        total[places] += impacts
        search.add(sums, *search.sliced(places, impacts))
    for k in (1, 7, 50, 700, 900):
        places, values = search.largest(sums, k)
        best = sorted(((-t, i) for i, t in enumerate(total.tolist()) if t))[:k]
        assert sorted(places.tolist()) == sorted(i for _, i in best)
        assert values.tolist() == total[places].tolist()


def test_largest_takes_ties_by_place():
    sums = np.zeros((3, 2), np.uint64)
    search.add(sums, *search.sliced(np.arange(100), np.full(100, 5)))
    assert search.largest(sums, 4)[0].tolist() == [0, 1, 2, 3]


def _ranked(docs, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out.extend((item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k]))
    return out


@pytest.mark.parametrize("block", [3, 64, 32_768])
def test_impact_search_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "BATCH_TERMS", 30)
    rnd = random.Random(5)
    words = ["alpha", "BETA", "gamma", "Éa", "éa", "x9", "日本", "𝔸b", "z"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 30]))) + rnd.choice(["", ".", "\n!"])) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "... !"), (3, "alpha repeated id"), (None, "beta gamma"), (153, "alpha," * 5000), (154, docs[4][1]), (155, docs[4][1])]
    items = [(1, "Alpha beta, ALPHA"), (2, "éa Éa w3 w4 w5"), (3, None), (4, "nothing here"), (5, " ".join(words)), (5, "日本 𝔸b"), (None, "gamma z")]
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    got = search.impact_search(d, q, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_ranked(docs, items, 7), key=key)


def test_impact_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.impact_search(docs, items.limit(0)).count() == 0
    assert search.impact_search(docs.limit(0), items).count() == 0
    assert search.impact_search(docs, items).count() == 0 or search.impact_search(docs, items).first()["score"] > 0


def _noisy(doc_id, run):
    if doc_id is None or zlib.crc32(f"{doc_id}:{run}".encode()) % 31:
        return run
    at = zlib.crc32(f"{doc_id}:{run}".encode()) % len(run)
    return run[:at] + run[at + 1 :]


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def _spelled(docs):
    n = Counter(w for i, t in docs for run in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(w := _noisy(i, run.translate(LOWER))) >= 7)
    n = {w: c for w, c in n.items() if c >= 2}
    form, rows = {}, []
    for w in n:
        near = sorted((-n[x], x) for x in n if _near(w, x))
        form[w] = near[0][1] if near and -near[0][0] >= 10 * n[w] else None
        rows.append((w, len(near)))
    out = []
    for w, n_near in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], n_near, n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("block", [2, 48])
def test_spelling_groups_are_brute_force(spark, block):
    rnd = random.Random(11)
    stems = ["abcdefg", "aaaaaaaa", "aaaaaaaaa", "Überraschung", "internation", "internatxon", "abababab", "Ééééééé", "longword" * 9]
    words = []
    for stem in stems:
        words += [stem] * 60
        for _ in range(25):
            w, i = stem, rnd.randrange(len(stem) + 1)
            for _ in range(rnd.choice([1, 1, 2])):
                w = rnd.choice([w[:i] + rnd.choice("abzé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("abzÿ") + w[i + 1 :]])
                i = rnd.randrange(len(w))
            words += [w] * rnd.choice([1, 2, 3, 7, 600])
    rnd.shuffle(words)
    docs = [(i, " ".join(words[at : at + 40])) for i, at in enumerate(range(0, len(words), 40))]
    docs += [(None, "abcdefg abcdefg internation"), (7, "abcdefg×internation"), (7, "repeated repeated"), (9000, None), (9001, ""), (9002, "q" * 3000 + " " + "q" * 3000), (9003, "q" * 3001 + "," + "q" * 3001)]
    d = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = spelling.spelling_groups(d, block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == _spelled(docs)
    assert spelling.spelling_groups(d.limit(0)).count() == 0


def test_near_pairs_meet_once_with_any_block(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("ab", k=rnd.choice([7, 8, 9]))) for _ in range(400)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _near(a, b))
    for block in (2, 30, 10_000):
        assert sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(table, block).collect()) == want


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints, radius):
    of = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_simhash_groups_are_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(["One", "two\t", "thréé", " x", "four", "five", "Six"], k=rnd.choice([2, 3, 4, 9, 300]))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 120):
        w = base[i % 60].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "word " * 20_000), (5, "repeated id"), (None, base[59]), (None, "alone here"), (204, base[3]), (205, base[3].upper())]
    d = spark.createDataFrame(docs, DOCS).withColumn("print", F.lit("clash")).withColumn("component_id", F.lit(9)).repartition(3)
    got = [tuple(r) for r in simhash.simhash_groups(d).collect()]
    prints = [_print(t) for _, t in docs]
    of = _groups(prints, 4)
    names = {g: min((i for (i, _), x in zip(docs, of) if x == g and i is not None), default=None) for g in set(of)}
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, p - (1 << 64) if p >> 63 else p, names[g]) for (i, _), p, g in zip(docs, prints, of)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.simhash_groups(d.limit(0)).count() == 0


@pytest.mark.parametrize("mean,most", [(1024, 32_768), (50, 100), (20, 8)])
def test_simhash_links_at_every_shard_size(spark, mean, most):
    """A dense family, chains of four bits, and fingerprints at exactly four and five bits."""
    rnd = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for b in rnd.sample(range(64), rnd.choice([1, 4, 4, 5, 6])):
                x ^= 1 << b
    centre = rnd.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), 4, mean=mean, most=most).collect()
    at, of = {p: i for i, p in enumerate(signed)}, list(range(len(prints)))
    for a, b in links:
        low, high = sorted((of[at[a]], of[at[b]]))
        of = [low if x == high else x for x in of]
    assert of == _groups(prints, 4)


def test_bk_tree_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    tree = simhash.BKTree(prints)
    for node, key in zip(*np.nonzero(tree.child >= 0)):
        assert int(prints[node] ^ prints[tree.child[node, key]]).bit_count() == key
    queries = prints[:200] ^ np.uint64(0b111)
    i, j = tree.near(queries, 4)
    want = {(a, b) for a in range(200) for b in np.flatnonzero(np.bitwise_count(queries[a] ^ prints) <= 4).tolist()}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_queries_cover_their_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = registry.op13_simhash(spark, sf)
    assert got.count() == n and got.where("length(fingerprint) <> 16 or component_id > doc_id").count() == 0
