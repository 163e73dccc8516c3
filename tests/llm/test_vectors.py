"""Vector operators and the pipeline against brute force."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrail.llm import ann, registry, voronoi_join
from test_text_operators import brute_lines


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x)] + [(len(x) + i, v, "q") for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")


ODD = (None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [math.nan], [math.inf] + [1.0] * 7, [1.0] * 5)


def clustered(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((12, 8))[rng.integers(0, 12, n)] * 3 + rng.standard_normal((n, 8))
    x[n // 2 : n // 2 + n // 3] = x[7]  # one very common vector
    return x


def test_ann_recall_and_ties(spark):
    x = clustered()
    got = {}
    for r in ann.ann_search(vectors(spark, x, ODD), F.col("vec_id") % 20 == 0, block_rows=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, len(x), 20))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len({v for v, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == list(range(1, 11))
        order = [found[k] for k in sorted(found)]
        assert [(s, v) for v, s in order] == sorted((s, v) for v, s in order)
        assert all(s == pytest.approx(d[v]) for v, s in order)
    assert hit >= 0.95 * 10 * len(got)


def test_ann_lists_with_more_queries_than_a_lot(spark):
    """Queries of a list in lots, each of which meets every block: the same rows are found."""
    x = clustered(700, seed=4)
    rows = lambda **bounds: sorted(map(tuple, ann.ann_search(vectors(spark, x), F.col("vec_id") % 2 == 0, **bounds).collect()))
    assert rows(block_rows=60, query_rows=7) == rows()


def test_ann_recall_of_many_queries(spark):
    """20,000 vectors of 16 components in clusters, 1,000 queries."""
    rng = np.random.default_rng(11)
    x = (rng.standard_normal((150, 16))[rng.integers(0, 150, 20_000)] * 2 + rng.standard_normal((20_000, 16))).astype(np.float32).astype(float)
    got = collections.defaultdict(set)
    for r in ann.ann_search(vectors(spark, x), F.col("vec_id") % 20 == 0, fit_rows=4_096, query_rows=200).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 20_000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(got) == 1_000 and hit >= 0.95 * 10_000


def test_ann_few_rows(spark):
    assert ann.ann_search(vectors(spark, []), F.lit(True)).count() == 0
    got = ann.ann_search(vectors(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 0.0), (1, pytest.approx(math.sqrt(2)))]


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal(64)
    d = ((x - q) ** 2).sum(1)
    of, kept = ann.scan(x, q[None], np.array([np.inf]), 10, 16, 2.1)
    assert set(of.tolist()) == {0} and len(set(np.argsort(d)[:10]) - set(kept.tolist())) <= 1 and len(kept) < 200
    copies = np.repeat(x[:1], 300, axis=0)
    assert len(ann.scan(copies, copies[:1], np.zeros(1), 10, 16, 2.1)[1]) == 300  # nothing is nearer than a copy


def test_two_levels_of_lists():
    x = clustered(4000)
    lists = ann.Lists(x, 4096, 1)
    own, far = lists.own(x[:200]), lists.far(x[:200])
    assert len(lists.second) > 1 and lists.cross.size == far.shape[1] and 0 <= own.min() and own.max() < lists.cross.size
    centres = (lists.first[:, None] + lists.second[None]).reshape(-1, 8)
    assert np.allclose(2 * far + (x[:200] ** 2).sum(1)[:, None], ((x[:200, None] - centres[None]) ** 2).sum(2))


def test_ann_query_recall(spark, sf):
    """The registered query on the fixture's vectors of 64 components, which are nearly random."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in registry.queries()["op1_ann"](spark, sf).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[q]))
    assert hit >= 0.95 * 10 * len(got)


def repeated(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 4.0]), (None, [1.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_ann_repeated_ids_and_sizes(spark):
    """Each row of an id is a query and a candidate of the others; sizes do not meet."""
    got = sorted(tuple(r) for r in ann.ann_search(repeated(spark), F.col("vec_id") % 10 == 0, k=2).collect())
    far = math.sqrt(32)
    want = [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 7, 1.0), (0, 2, 7, 1.0), (0, 1, 7, far), (0, 2, 7, far), (10, 1, 9, 1.0)]
    assert [(a, b, c, pytest.approx(d)) for a, b, c, d in sorted(want)] == got


def test_voronoi_repeated_ids_and_sizes(spark):
    got = sorted(tuple(r) for r in voronoi_join.voronoi_top_k(repeated(spark), F.col("vec_id") % 10 == 0, vector_col="embedding", k=2).collect())
    want = [(0, 1, 0, 5), (0, 1, 0, 5), (0, 2, 0, 1), (0, 2, 0, 1), (0, 1, 7, 10), (0, 2, 7, 10), (10, 1, 9, 17)]
    assert got == sorted(want)


def brute_products(x, queries, k):
    x = np.array(x, dtype=object)
    out = []
    for q in queries:
        scores = [(-int(sum(a * b for a, b in zip(x[q], x[j]))), j) for j in range(len(x)) if j != q]
        out += [(q, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [20, 2**40])
def test_voronoi_matches_brute_force(spark, scale):
    x = np.floor(clustered(400) * scale / 4)
    if scale > 100:
        x = np.floor(x / 2**12)  # products over 2^53, still longs
    df = vectors(spark, x, [None, [1.0] * 7 + [math.nan]])
    got = voronoi_join.voronoi_top_k(df, F.col("vec_id") % 10 == 0, vector_col="embedding", k=5, group_queries=7, block_rows=90)
    ints = [[int(v) for v in r] for r in x]
    assert sorted(tuple(r) for r in got.collect()) == brute_products(ints, range(0, 400, 10), 5)


def test_voronoi_few_rows(spark):
    assert voronoi_join.voronoi_top_k(vectors(spark, []), F.lit(True), vector_col="embedding").count() == 0
    got = voronoi_join.voronoi_top_k(vectors(spark, [[0.0, 0.0], [1.0, 2.0]]), F.lit(True), vector_col="embedding").orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0), (1, 1, 0, 0)]


def test_bounds_exclude_far_cells():
    """Cells far from a query's neighbours are not needed."""
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    low, high = voronoi_join.needed(pivots, {0: 1.0}, {0: [0.1] * 6, 1: [0.1] * 6}, 5)[0]
    assert low[0] <= 0 <= high[0] and low[1] > 50


def test_top_k_query_matches_sql(spark, duck, sf):
    got = sorted(map(tuple, registry.queries()["op2_voronoi_top_k"](spark, sf).collect()))
    assert got == sorted(duck.execute(f"SELECT query_id, rank, vec_id, score FROM ({registry.oracle_sql()['op2_voronoi_top_k']})").fetchall())


def test_mixing_query_matches_sql(spark, duck, sf):
    got = sorted(map(tuple, registry.queries()["op5_mixing"](spark, sf).collect()))
    assert got == sorted(duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({registry.oracle_sql()['op5_mixing']})").fetchall())


def test_pipeline(spark, sf):
    """Each stage's decisions, held to what its operator says about its own input, and the whole run."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*c.COLUMNS).cache()
    rows = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf).cache()
        rows[name] = out.collect()
        if name != "packing":
            assert out.columns == list(c.COLUMNS)
            assert all(r.n_chars == len(r.text or "") for r in rows[name]) or name == "toxicity"
        before, docs = docs, out
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in registry.queries()["op7_toxicity"](spark, sf).collect()}
    assert {r.doc_id for r in rows["toxicity"]} == {i for i in first if scores[i] < c.TOXIC_FROM}
    assert [(r.doc_id, r.text) for r in sorted(rows["line_dedup"])] == [(i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in rows["toxicity"]])]
    joined = brute_join_of(rows["line_dedup"])
    assert {r.doc_id for r in rows["ngram_join"]} == {i for i, _, comp in joined if i == comp}
    times = collections.Counter(r.doc_id for r in rows["mixing"])
    assert set(times) <= {r.doc_id for r in rows["ngram_join"]} and max(times.values()) <= 3
    by = collections.defaultdict(int)
    for r in rows["packing"]:
        by[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    assert all(by[i] == times[i] * tokens[i] for i in times) and set(by) == set(times)
    again = c.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens, r.start, r.length) for r in again if r.start == 0 and r.length == r.doc_tokens)
    assert sum(r.length for r in again) == sum(by.values())


def brute_join_of(rows):
    """(id, size, component) from an index of shingles."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets, holders = {}, collections.defaultdict(list)
    for r in rows:
        w = word.findall((r.text or "").translate({u: u + 32 for u in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            holders[s].append(r.doc_id)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        shared = collections.Counter(j for s in own for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in sets.items()]


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated and missing ids, further columns, and no rows at all."""
    import corpus_pipeline as c

    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "two words", None, None, 9), (4, "two words", None, None, 9), (None, "a text without an id", "en", "b", 20),
        (None, "a text without an id", "en", "b", 20), (None, None, None, None, None), (7, "shared line of many documents\nown seven", "en", "b", 1), (8, "shared line of many documents\nown eight", "en", "b", 1), (9, "shared line of many documents\nown nine", "en", "b", 1),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in c.STAGES:
            now = stage(spark, now, sf).cache()
            n = now.count()
            assert name == "packing" or now.columns == list(c.COLUMNS)
            if start is docs:
                assert {"toxicity": n == 11, "line_dedup": n == 11, "ngram_join": n == 11, "mixing": n > 0, "packing": n > 0}[name], (name, n)
            else:
                assert n == 0
    assert sorted(r.text for r in c.lines(spark, docs, sf).where("doc_id in (7, 8, 9)").collect()) == ["own eight", "own seven", "shared line of many documents\nown nine"]


def test_hashed_only_where_it_fits(spark):
    from lumentrail.llm.common import HASHED_ROWS, hashed

    df = spark.range(3)
    assert "shuffle_hash" in hashed(df, 3)._jdf.queryExecution().logical().toString().lower()
    assert "shuffle_hash" not in hashed(df, HASHED_ROWS * 10**6)._jdf.queryExecution().logical().toString().lower()
