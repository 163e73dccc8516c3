"""The corpus operators on small tables, against brute force."""

import collections
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrail.llm import html_text, mixing, ngram_join, packing, registry, token_count, toxicity
from lumentrail.llm.common import tokenizer_file
from lumentrail.llm.components import components
from lumentrail.llm.line_dedup import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {u: u + 32 for u in range(65, 91)}
LONG = "x" * 30_000 + " end"


def frame(spark, texts, extra=True):
    """Documents, with further columns whose names are those of results."""
    rows = [(i, t, "en", f"s{i % 3}" if t else None, 7, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, line string")
    return df if extra else df.select("doc_id", "text", "lang", "source")


# Line dedup.


def brute_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    shared = "A line that many documents share here"
    texts = [f"{shared}\none {i}" for i in range(5)] + [None, "", "\n\n", f"  {shared.upper()}\t\n{shared}\nown", LONG, "É" * 20, "É" * 20, "é" * 20, "short\nshort", "short", "short"]
    df = frame(spark, texts)
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "line", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(list(enumerate(texts)))
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_repeats_and_nulls(spark):
    line = "a line of more than twenty points"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (3, line), (None, line)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_dropped) for r in line_dedup(df).collect())
    assert got == [(-1, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


# N-gram join.


def brute_join(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies(seed=3, groups=4, size=14):
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = [None, "", "one", "ONE", "a b c d", "A b  c\td", LONG]
    for _ in range(groups):
        base = list(rng.choice(vocabulary, 150))
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                words[at] = f"new{rng.integers(1_000_000)}"
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, 80)) for _ in range(20)]
    return texts + texts[10:16]


def test_ngram_join(spark):
    texts = near_copies()
    got = ngram_join.ngram_join(frame(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))


@pytest.mark.parametrize("family", [4_000_000, 0])
def test_ngram_join_heavy_tokens(spark, monkeypatch, family):
    """The same links where every shared token counts as heavy, by families and by stars."""
    monkeypatch.setattr(ngram_join, "FAMILY_TOKENS", family)
    monkeypatch.setattr(ngram_join, "_levels", lambda prints: np.ones(1 << ngram_join.SKETCH_BITS, np.uint8))
    texts = near_copies(seed=5, groups=2, size=25)
    got = ngram_join.ngram_join(frame(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))


def test_ngram_join_repeated_ids(spark):
    """Rows of one id and several texts: each text is linked for itself."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (4, "c " + a), (None, a)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id) == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (3, 57, 1), (4, 57, 1)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 56, 1)]


def test_ngram_join_rows_without_id(spark):
    """They link, and name no component: it takes the smallest id there is, or none."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, a), (7, a + " x"), (None, b), (None, b + " y"), (None, c), (None, None)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 56, 0), (0, 56, 0), (0, 56, 7), (0, 57, 0), (7, 57, 7)]


def test_ngram_join_of_clashing_hashes(spark, monkeypatch):
    """Sets whose hashes share a half are still told apart."""
    monkeypatch.setattr(ngram_join, "halves", lambda own: (len(own), int(np.bitwise_xor.reduce(own) >> np.uint64(2))))
    texts = near_copies(seed=8, groups=2, size=6)
    got = ngram_join.ngram_join(frame(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))


@pytest.mark.parametrize("family", [4_000_000, 0])
def test_ngram_join_one_token_in_many_sets(spark, monkeypatch, family):
    """A passage of one shingle in 5,000 unlike texts: they are candidates of each other under one order, not under all."""
    monkeypatch.setattr(ngram_join, "FAMILY_TOKENS", family)
    compared = []
    similar, enough = ngram_join.similar, ngram_join.share_enough
    texts = [f"the same five words here {' '.join(f'w{i}x{k}' for k in range(12))}" for i in range(5_000)] + [f"the same five words here {' '.join(f'w7x{k}' for k in range(12))} end"]
    got = ngram_join.ngram_join(frame(spark, texts, extra=False)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id != r.component_id} == {(5_000, 7)} and len(got) == 5_001
    sets = [ngram_join.shingle_set(t, ngram_join.WordHashes()) for t in texts]
    monkeypatch.setattr(ngram_join.np, "add", type("add", (), {"reduceat": staticmethod(lambda x, at, real=np.add: compared.append(len(at)) or real.reduceat(x, at))}))
    assert ngram_join.spanning_links(sets, 80) == [(7, 5_000)] and sum(compared) < 100


def test_lists_beyond_the_light_limit(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    texts = near_copies(seed=9, groups=3, size=8)
    got = ngram_join.ngram_join(frame(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))


def test_ngram_join_orders_again_by_exact_counts(spark, monkeypatch):
    """A sketch that is full tells nothing: tokens of long lists are counted, and go last in the second prefixes."""
    texts = near_copies(seed=3, groups=2, size=90)
    seen, counted = [], ngram_join._counted_levels
    monkeypatch.setattr(ngram_join, "_levels", lambda prints: np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8))
    monkeypatch.setattr(ngram_join, "_counted_levels", lambda found: seen.append(counted(found)) or seen[-1])
    for family in (4_000_000, 0):
        monkeypatch.setattr(ngram_join, "FAMILY_TOKENS", family)
        monkeypatch.setattr(ngram_join, "SATURATED", -1)
        got = ngram_join.ngram_join(frame(spark, texts))
        assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))
    # Every token that more than LIGHT texts have in their prefixes (here: by hash alone) has a level, by how many they are.
    sets = {s.tobytes(): s for t in texts if len(s := ngram_join.shingle_set(t, ngram_join.WordHashes()))}
    firsts = collections.Counter(int(x) for s in sets.values() for x in s[: ngram_join.prefix_length(len(s), 80)])
    for token, n in firsts.items():
        level = seen[0][token >> 64 - ngram_join.SKETCH_BITS]
        assert level >= (np.ceil(np.log2(n / ngram_join.LIGHT)) if n > ngram_join.LIGHT else 0)
    assert seen[0].any()


def test_prefixes_of_long_unrelated_texts_do_not_meet():
    """In full, prefixes under the second order of sets of thousands share nothing by chance, as 16-bit hashes would."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, 5_000).astype(np.uint64)) for _ in range(40)]
    seconds = [ngram_join.second_prefix(s, np.zeros(len(s), np.uint8), 80) for s in sets]
    assert all(len(x) == 1_001 or len(x) == ngram_join.prefix_length(len(s), 80) for x, s in zip(seconds, sets))
    assert sum(len(np.intersect1d(seconds[i], seconds[j])) for i in range(40) for j in range(i)) == 0
    near = np.unique(np.concatenate([sets[0][200:], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    assert len(np.intersect1d(seconds[0], ngram_join.second_prefix(near, np.zeros(len(near), np.uint8), 80))) > 100


def test_ngram_join_of_long_texts(spark, monkeypatch):
    """Texts of thousands of shingles with one shared heavy passage, through every step of large families."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [f"{' '.join(f'v{x}' for x in rng.integers(0, 10**9, 2_500))} {passage}" for _ in range(12)]
    texts += [t.replace(" p3 ", " q3 ") for t in texts[:3]] + [texts[0] + " tail"]
    monkeypatch.setattr(ngram_join, "FAMILY_TOKENS", 0)
    monkeypatch.setattr(ngram_join, "_levels", lambda prints: np.ones(1 << ngram_join.SKETCH_BITS, np.uint8))
    got = ngram_join.ngram_join(frame(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_join(list(enumerate(texts)))


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_join(frame(spark, ["a"]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(frame(spark, [None])).collect()] == [(0, 0, 0)]


def test_spanning_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 2**63, 60), base).astype(np.uint64)) for _ in range(80)] + [np.unique(rng.integers(0, 2**63, 9).astype(np.uint64))]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def parts(links):
        root[:] = range(len(sets))
        for x, y in links:
            root[find(x)] = find(y)
        return {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.similar(sets[i], sets[j], 80)]
    got = ngram_join.spanning_links(sets, 80)
    assert parts(got) == parts(every) and 1 < len(parts(every)) and set(map(lambda p: (max(p), min(p)), got)) <= set(every)


def test_prefix_filter_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.12], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]))
        if len(y) and ngram_join.similar(x, y, 80):
            level = rng.integers(0, 3, 64) * (_ % 2)
            orders = [(s, level[(s % np.uint64(64)).astype(int)]) for s in (x, y)]
            a, b = (ngram_join.short_prefixes(s, s[np.lexsort((s, h))][: ngram_join.prefix_length(len(s), 80)], h) for s, h in orders)
            assert ngram_join.share_enough(a, len(x), b, len(y), 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 300), (300, 250), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 200} and got[60] == 0 and got[250] == 200


# Mixing.


def test_targets():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210) == pytest.approx([30, 120, 60])
    assert mixing.targets([], [], 0) == []
    got = mixing.targets([1, 2, 300], [5, 2, 1], 303)
    assert got == pytest.approx([3, 6, 294])


def test_flow_prefers_few_repeats():
    # The second pattern belongs to both sources and fills the one that would have to repeat.
    flow = mixing.min_cost_flow([10, 10, 10], [20, 10], [(0, 0), (1, 0), (1, 1), (2, 1)])
    assert flow[0, 0] == 10 and flow[1, 0] == 10 and flow[2, 1] == 10


def test_mixing(spark):
    texts = [" ".join(["w"] * (1 + i % 40)) for i in range(300)] + [None, ""]
    df = frame(spark, texts)
    got = mixing.mix_sources(df, F.array("source")).collect()
    by = collections.defaultdict(list)
    source = {i: f"s{i % 3}" if t else None for i, t in enumerate(texts)}
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size
        by[source[r.doc_id]].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and rows[0].source_size == sum(r.size for r in rows)
    again = mixing.mix_sources(df.repartition(7), F.array("source")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix_sources(df.limit(0), F.array("source")).count() == 0


def brute_flow(supplies, quotas, edges, costs):
    """The largest flow and its least cost, over all whole amounts."""
    best = None

    def go(k, left, used):
        nonlocal best
        if k == len(edges):
            price = sum(costs[i // n] for p, n in enumerate(supplies) for i in range(used[p])) if all(used[p] <= len(costs) * n for p, n in enumerate(supplies)) else None
            if price is not None:
                best = min(best or (1, 0), (-sum(used), price))
            return
        p, s = edges[k]
        for words in range(min(left[s], len(costs) * supplies[p] - used[p]) + 1):
            go(k + 1, [x - words * (i == s) for i, x in enumerate(left)], [x + words * (i == p) for i, x in enumerate(used)])

    go(0, list(quotas), [0] * len(supplies))
    return best


def test_flow_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        supplies, quotas = rng.integers(1, 3, 3).tolist(), rng.integers(0, 6, 3).tolist()
        edges = [(p, s) for p in range(3) for s in range(3) if rng.random() < 0.55]
        flow = mixing.min_cost_flow(supplies, quotas, edges)
        used = [sum(w for (p, _), w in flow.items() if p == k) for k in range(3)]
        assert all(sum(w for (_, s), w in flow.items() if s == k) <= quotas[k] for k in range(3))
        price = sum(mixing.REPETITION_COSTS[i // n] for p, n in enumerate(supplies) for i in range(used[p]))
        assert (-sum(used), price) == (brute_flow(supplies, quotas, edges, mixing.REPETITION_COSTS) or (0, 0))


def test_mixing_with_overlaps(spark):
    """Documents of two sources at once: quotas are met with the fewest repeats."""
    kinds = [["a"], ["a", "b"], ["b"], ["b", "c"], ["d"]]
    rows = [(i, "w " * (1 + i % 9), kinds[i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = {r.doc_id: r for r in mixing.mix_sources(df, F.col("sources")).collect()}
    size = collections.Counter()
    for i, t, k in rows:
        assert got[i].size == len(t.split()) and 0 <= got[i].taken <= 3 * got[i].size
        for s in k:
            size[s] += got[i].size
    quotas = dict(zip("abcd", mixing.targets([size[s] for s in "abcd"], [5, 2, 1, 5], sum(r.size for r in got.values()))))
    taken = [sum(got[i].taken for i in range(500) if i % 5 == k) for k in range(5)]
    order = sorted(range(5), key=lambda k: json.dumps(kinds[k], separators=(",", ":")))
    sizes = [sum(got[i].size for i in range(500) if i % 5 == k) for k in order]
    want = mixing.routed([kinds[k] for k in order], sizes, {s: round(q) for s, q in quotas.items()}, 3)
    assert [taken[k] for k in order] == want and taken[4] == round(quotas["d"])
    assert got[1].source_size == size["a"] + size["b"] and got[1].target == pytest.approx(quotas["a"] + quotas["b"])
    assert abs(sum(taken[:4]) - sum(quotas[s] for s in "abc")) <= 3


def test_mixing_of_many_sources():
    """No graph where no document has two sources."""
    names = [[f"s{i}"] for i in range(200_000)]
    assert sum(mixing.routed(names, [3] * len(names), {n[0]: 5 for n in names}, 3)) == 5 * len(names)
    assert len(mixing.targets([3] * len(names), [5, 2, 1] * 66_666 + [5, 2], 600_000)) == len(names)


def test_mixing_more_patterns_than_are_broadcast(spark, monkeypatch):
    df = frame(spark, [" ".join(["w"] * (1 + i % 7)) for i in range(60)])
    few = sorted(map(tuple, mixing.mix_sources(df, F.array("source")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 1)
    assert sorted(map(tuple, mixing.mix_sources(df, F.array("source")).collect())) == few


def test_mixing_repeated_and_missing_ids(spark):
    rows = [(1, "a b", "x"), (1, "a b c", "x"), (None, "a", "x"), (None, "a b c d", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, F.array("source")).collect()
    assert sorted(r.size for r in got) == [0, 1, 2, 3, 4] and sum(r.taken for r in got) == 10
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(df.repartition(5), F.array("source")).collect()))


# Packing.


def public_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = packing.Encoder(open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    return t, own


def public_ranks():
    import public_tokenizers

    return open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN


def test_encoder_matches_library():
    t, own = public_encoder()
    rng = np.random.default_rng(0)
    letters = list("abcdeé ßÄ\n\t  .,'`s0129漢½²×÷  ​_\U0001f600<|endoftext|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("ab é  \n\t.'s1"), rng.integers(0, 40))) for _ in range(6000)]  # plain ones, wide spaces in some
    texts += ["".join(rng.choice(list("abé \n.,'s12"), rng.integers(0, 40))).replace("  ", " ") for _ in range(6000)] + ["it's we'll  two   spaces \n\n x ", "<|endoftext|>", "ñandú über façade œuvre"]
    for x in texts:
        assert np.frombuffer(own.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "word " * 9000] + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], rng.integers(1, 900))) for _ in range(60)]
    t, _ = public_encoder()
    rows = registry.pack_public(frame(spark, texts)).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in p) < 2048 for p in sequences.values()) <= 1  # one padded sequence a shard
    assert registry.pack_public(frame(spark, ["a"]).limit(0)).count() == 0


def test_packing_long_runs():
    """Runs of white space that overflow the library's word rule, beside a sign of another script."""
    t, own = public_encoder()
    for x in (" " * 5_000_000 + "漢 a", "漢" + "\n" * 1_000_000, "漢" + " \u3000\n" * 400_000 + "\x1c b", "é" + "!?" * 200_000, "漢" * 300_000):
        assert np.frombuffer(own.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x[:2]


def test_packing_deals_related_documents_to_one_shard(spark):
    """Kinds of documents stored in turns meet in the shards; a group of copies of more than a shard is several."""
    rng = np.random.default_rng(6)
    kinds = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(60)] for _ in range(8)]
    texts = [" ".join(rng.choice(kinds[i % 8], 60)) for i in range(800)] + ["one copy of many " * 12] * 400
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), *public_ranks(), shard_tokens=16_000).collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.sequence_id >> 20].append(r)
    assert len(shards) >= 8 and max(sum(r.length for r in p) for p in shards.values()) <= 2 * 16_000
    kind = lambda r: r.doc_id % 8 if r.doc_id < 800 else 8
    together = [max(sum(kind(r) == k for r in p) for p in shards.values()) / sum(kind(r) == k for r in rows) for k in range(8)]
    assert sum(together) / 8 > 0.45, together  # a kind fills more than one shard; dealt at random, about a tenth of it would meet
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_packing_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "same text", "x"), (1, "same text", "y"), (None, "no id", "z"), (None, None, None)], "doc_id long, text string, sequence_id string")
    rows = registry.pack_public(df).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows) == [(0, 1), (0, 3), (1, 3), (1, 3)]


def test_packing_brings_neighbours_together():
    """A seed's window is filled with the documents most like it."""
    a, b = np.arange(100, 160, dtype="<u2"), np.arange(500, 560, dtype="<u2")
    docs = [np.concatenate([x, np.array([1000 + i], "<u2")]) for i, x in enumerate([a, b] * 8)]
    order = packing.packed_order(packing.Shard(docs, np.ones(2000), 61.0, 8), 512)
    assert sorted(order) == list(range(16)) and len({i % 2 for i in order[:8]}) == 1


def test_packing_asks_for_all_neighbours_of_a_seed():
    """More short documents than one request returns fill the window before any that share less."""
    a, b = np.arange(100, 110, dtype="<u2"), np.arange(500, 510, dtype="<u2")
    docs = [np.concatenate([x, np.array([1000 + i], "<u2")]) for i, x in enumerate([a, b] * 60)]
    order = packing.packed_order(packing.Shard(docs, np.ones(2000), 11.0, 12), 512)
    assert sorted(order) == list(range(120)) and {i % 2 for i in order[:47]} == {0}


@pytest.mark.parametrize("share", [1, 8, 1000])
def test_packing_scores_all_terms(share):
    """Neighbours are those of the whole BM25 sum, whatever part of it is dense."""
    rng = np.random.default_rng(share)
    idf = rng.exponential(2.0, 400) ** 2 + 1e-3
    docs = [rng.zipf(1.3, rng.integers(1, 200)).clip(1, 399).astype("<u2") for _ in range(400)]
    mean = float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean, share)
    shard.unused[rng.integers(0, 400, 60)] = False
    weights = np.zeros((400, 400))
    for i, d in enumerate(docs):
        t, n = np.unique(d, return_counts=True)
        weights[i, t] = (idf[t] * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean)))).astype(np.float32)
    for seed in range(0, 400, 7):
        shard.unused[seed], was = False, shard.unused[seed]
        terms = shard.terms(seed)
        score = weights[:, np.unique(docs[seed])].sum(axis=1) * shard.unused
        for most in (1, 5, 16, 400):
            found = shard.neighbours(terms, most)
            best = np.sort(score[score > 0])[::-1][:most]
            assert len(set(found.tolist())) == len(found) == len(best) and np.allclose(score[found], best, rtol=1e-9)
        shard.unused[seed] = was
    terms, most = shard.terms(3), 50
    before = shard.neighbours(terms, most)
    names = shard.compacted()
    assert names[shard.neighbours(terms, most)].tolist() == before.tolist()  # the index without those used


# Token counts.


def test_token_count(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    t = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    rng = np.random.default_rng(0)
    texts = ["", " ", "Hello world", "tab\tand\nline", "漢字 \U0001f600\U0001f600 é", "▁ already marked"] + ["".join(rng.choice(list("abcd e▁é\n漢"), 30)) for _ in range(300)] + [LONG]
    pieces, lowest = token_count.read_vocabulary(path)
    got = token_count.count_tokens(frame(spark, [None, *texts]), pieces, lowest).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0] + [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_count_of_repeats_clashes_and_empty_tables(spark):
    pieces = [("▁", -1.0), ("a", -1.0), ("▁a", -1.5)]
    df = spark.createDataFrame([(1, "a a", "old"), (1, "a a", "other"), (2, None, "x")], "doc_id long, text string, n_tokens string")
    got = token_count.count_tokens(df, pieces, -2.0)
    assert got.columns == ["doc_id", "text", "n_tokens"] and sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [(1, 2), (1, 2), (2, 0)]
    assert token_count.count_tokens(df.limit(0), pieces, -2.0).count() == 0


def test_token_count_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    counter, rng = token_count.PieceCounter(pieces, -3.0), np.random.default_rng(1)
    for _ in range(2000):
        x = "".join(rng.choice(list("ab "), rng.integers(0, 14)))
        assert counter.text(x) == len(t.encode(x).ids), x


# HTML.


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  <b>two</b>\n three.<p>Four &eacute;&#x21;</article><footer>f</footer>", "T\nOne two three.\nFour é!"),
        ("<body><div id=content><h2>Head</h2><p>A paragraph that is long enough.</p><ul><li>one<li>two</ul></div><div class='comments'><p>a comment</p></div><form>q<input></form></body>", "Head\nA paragraph that is long enough.\none\ntwo"),
        ("<script>var t='</p>';</script><article><p>a<br>b</p><!-- c --><style>p{}</style></article>", "a b"),
        ("<body><div class='cookie-notice'>We use cookies</div><main><p>Main text here.</p></main><aside>side</aside>", "Main text here."),
        ("<article><p>unclosed <i>text", "unclosed text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PARAGRAPH = "<p>A long paragraph of article text that goes on for a while, so that it weighs something.</p>"
SAID = "A long paragraph of article text that goes on for a while, so that it weighs something."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout has-sidebar'><article><h1>T</h1>{PARAGRAPH}</article></div>", f"T\n{SAID}"),
        (f"<body><form action=x><div><h1>T</h1>{PARAGRAPH}{PARAGRAPH}</div><input></form>", f"T\n{SAID}\n{SAID}"),
        (f"<article><div class='entry-header'><h1>Title</h1></div>{PARAGRAPH}</article>", f"Title\n{SAID}"),
        (f"<article><h1>T</h1>{PARAGRAPH}<section id='social-history'>{PARAGRAPH}</section><p class='copyright-law'>Law.</p></article>", f"T\n{SAID}\n{SAID}\nLaw."),
        ("İ" * 50 + f"<script>x</SCRIPT >{PARAGRAPH}<p>after", "İ" * 50 + f"\n{SAID}\nafter"),
        (f"<body><div><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div><h1>Head</h1>{PARAGRAPH}{PARAGRAPH}</div><div><a href=a>One more</a><a href=b>Two</a><a href=c>Three</a></div>", f"Head\n{SAID}\n{SAID}"),
        (f"<body><article><h1>Head</h1>{PARAGRAPH}</article><section class='comments'>{PARAGRAPH * 9}</section><div class='site-footer'>f</div>", f"Head\n{SAID}"),
    ],
)
def test_main_text_by_density(page, text):
    assert html_text.main_text(page) == text


def test_density_chooses(monkeypatch):
    """Menus and sidebars without a name go only because density chooses: with the body in place of its choice they stay."""
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div><h1>Head</h1>{PARAGRAPH * 3}</div><div><span>x</span> <a href=c>Three</a></div>"
    want = "\n".join(["Head", *[SAID] * 3])
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text.Page, "content", lambda self: ({self.tag.index("body")}, self.cut))
    assert html_text.main_text(page) != want


@pytest.mark.parametrize("part", ["<div>", "<div><b>", "<p><table>", "<ul><li>", "<b><div></b>", "<p><button><div>"])
def test_main_text_of_deep_pages(part):
    """Time grows with a page's length, whatever is nested."""
    import time

    began = time.process_time()
    html_text.main_text(part * (50_000 // part.count("<")) + "text")
    assert time.process_time() - began < 8  # quadratic work would take minutes


def test_main_text_of_fixture_pages(spark, sf):
    """The fixture's articles, taken from between their tags."""
    import html

    def article(page):
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner[1] if inner else "")))
        return "\n".join(x for part in parts if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split())))

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in registry.queries()["op4_html_text"](spark, sf).collect()}
    assert len(got) == len(pages) and all(got[p.page_id] == article(p.html) for p in pages)
    for row in spark.read.parquet(f"{os.path.dirname(sf)}/sf0.1/pages.parquet").select("html").collect():
        assert html_text.main_text(row.html) == article(row.html)


def test_html_column(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "<article><p>Añ</p></article>" + "<p>" * 3000, "k"), (3, "<p>same", "a"), (3, "<p>same", "b"), (4, f"<article>{PARAGRAPH * 20_000}</article>", None)], "page_id long, html string, text string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect())
    assert rows[:4] == [(1, "", 0), (2, "Añ", 2), (3, "same", 4), (3, "same", 4)] and rows[4][2] == 20_000 * (len(SAID) + 1) - 1
    assert html_text.extract_text(df.limit(0)).count() == 0


# Toxicity and quality.


def test_levenshtein_trie():
    words = ["idiot", "moron", "scum", "worthless", "clown", "disgusting"]
    trie = toxicity.FuzzyTrie([toxicity.Term(w, False, 1.0) for w in words] + [toxicity.Term("lowei", True, 1.0)], most_states=200)  # begun anew now and then

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    rng = np.random.default_rng(0)
    for _ in range(3000):
        w = list(words[rng.integers(len(words))])
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(len(w) + 1)
            w[at : at + rng.integers(0, 2)] = list("".join(rng.choice(list("aiomx"), rng.integers(0, 2))))
        w = "".join(w)
        near = [(distance(w, t), t) for t in words if distance(w, t) <= (len(t) >= 5) + (len(t) >= 10)]
        got = trie.match(w)
        assert (got is None) == (not near), (w, got, near)
        assert got is None or got[1] == min(near)[0]
    assert trie.match("loweichen")[0].text == "lowei" and trie.match("lowe") is None


def test_context():
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False, 4.0)])
    plain, quoted, said, at = (toxicity.evidence(t, trie)[0] for t in ("an idiot here", 'an "idiot" here', "he said idiot here", "you idiot"))
    assert quoted < said < plain < at
    assert toxicity.evidence("an idoit idot", trie) == (0.0, 2.0) or toxicity.evidence("an idot", trie)[1] > 0
    assert toxicity.evidence(None, trie) == toxicity.evidence("", trie) == (0.0, 0.0)


@pytest.mark.parametrize("text", ["id1ot", "you 1d!ot", "i.d.i.o.t", "i d i o t", "an I-D-I-O-T here", "1d1ot"])
def test_disguised_terms(text):
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False, 4.0), toxicity.Term("scum", False, 2.0)])
    assert toxicity.evidence(text, trie)[1] > 0 == toxicity.evidence(text, trie)[0]
    assert toxicity.evidence(text.replace("d", "x").replace("D", "X"), trie) == (0.0, 0.0)


def test_quotations():
    """A hit anywhere inside quotation marks counts less than the same one outside."""
    trie = toxicity.FuzzyTrie([toxicity.Term("idiot", False, 4.0)])
    inside, outside, unclosed = (toxicity.evidence(t, trie)[0] for t in ('"what an idiot and a fool" was on the wall', "what an idiot and a fool was on the wall", '"what an idiot and a fool was\non the "wall'))
    assert inside < outside == unclosed
    assert toxicity.evidence("„so ein idiot hier“ x", trie)[0] == inside


def test_disguise_patterns_take_linear_time():
    import time

    began = time.process_time()
    for x in ("1" * 200_000, "a1" * 100_000, "a." * 100_000 + "bb", "a1" * 100_000 + "_", "!" * 200_000 + "a"):
        toxicity.disguised(x, {"a", "b"}, lambda w: None)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.85)])
def test_held_out(spark, sf, name, label, least):
    df = registry.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, n, low, high = df.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 50 and hit >= least and 0 <= low <= high <= 1


def test_scores_of_odd_texts(spark):
    from lumentrail.llm.quality import QualityModel, FEATURES, fit_quality, score_quality

    texts = [None, "", LONG, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "ok text"]
    df = frame(spark, texts)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit_quality(df, empty) == QualityModel((0.0,) * FEATURES, 0.0, 1.0, 0.5)
    assert [r.score for r in score_quality(df, fit_quality(df, empty)).collect()] == [0.5] * 5
    scores = [r.score for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, empty)).collect()]
    assert all(0 <= s < 0.7 for s in scores)
    none = df.limit(0)
    assert score_quality(none, fit_quality(none, empty)).count() == toxicity.score_toxicity(none, toxicity.fit_toxicity(none, empty)).count() == 0


def test_scores_of_repeats_and_clashing_columns(spark):
    """Repeated rows are scored alike, a column called score is replaced, ties of strength get one score."""
    from lumentrail.llm.quality import fit_quality, score_quality

    rows = [(i, "a plain and readable line of text" if i % 3 else "!!! ### !!! buy buy buy, you idiot", i, "x") for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, score long, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (score_quality(df, fit_quality(df, labels)), toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels))):
        assert got.columns == df.columns
        scores = collections.defaultdict(set)
        for r in got.collect():
            scores[r.doc_id % 3 > 0].add(r.score)
        assert len(scores[True]) == len(scores[False]) == 1 and scores[True] != scores[False]


def test_n_grams_of_any_script_and_length():
    from lumentrail.llm import quality

    assert np.abs(quality.features("обычный текст на русском языке") - quality.features("!!! купи купи купи")).sum() > 1
    data = np.frombuffer(("слова и words " * 200_000).encode(), np.uint8)
    whole = quality.n_gram_counts(data)
    assert whole.sum() == len(data) - 3
    small = np.frombuffer(b"abcdefg", np.uint8)
    assert quality.n_gram_counts(small).sum() == 4 and quality.n_gram_counts(small[:3]).sum() == 0
    step, quality.STEP = quality.STEP, 1000
    try:
        assert (quality.n_gram_counts(data[:50_000]) == sum(quality.n_gram_counts(data[i : i + 4]) for i in range(49_997))).all()
    finally:
        quality.STEP = step


def test_pairwise_logistic_is_at_its_optimum():
    from lumentrail.llm import quality

    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = (x @ np.array([1.0, -2, 0, 0.5, 0]) + rng.standard_normal(200) > 0).astype(float)
    won, lost = quality.preference_pairs(y, 6, 0)
    assert (y[won] == 1).all() and (y[lost] == 0).all()
    w = quality.pairwise_logistic(x, won, lost, ridge=1.0)
    loss = lambda w: np.log1p(np.exp(-(x[won] - x[lost]) @ w)).sum() + (w**2).sum() / 2
    assert all(loss(w) <= loss(w + d) for d in 1e-3 * rng.standard_normal((50, 5)))


# SQL twins.


def test_line_query_matches_sql(spark, duck, sf):
    got = sorted(map(tuple, registry.queries()["op10_line_dedup"](spark, sf).collect()))
    assert got == sorted(duck.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({registry.oracle_sql()['op10_line_dedup']})").fetchall())
    assert len(got[0][3]) == len(hashlib.sha256().hexdigest())


def test_toxicity_keeps_words_under_a_stem(spark):
    """Words that a stem covers, short words and more terms than 400 are all learned."""
    many = ["".join(chr(97 + i // 26**k % 26) for k in range(2)) + "qxzv" for i in range(420)]
    bad = ["clownish", "clownery", "clowns", "clown", "oaf"]
    rows = [(" ".join([*bad, *many]), 1)] * 5 + [("a kind word", 0)] * 5
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert {t.text for t in terms if not t.stem} == {*bad, *many}
    assert any(t.stem and "clowns".startswith(t.text) for t in terms)
    trie = toxicity.FuzzyTrie(terms)
    assert [trie.match(w)[1] for w in ("clowns", "clown", "oaf", "clpwns", "clpwn", "clwn")] == [0, 0, 0, 1, 1, 1]


def test_a_word_and_a_stem_of_the_same_letters():
    for order in (1, -1):
        trie = toxicity.FuzzyTrie([toxicity.Term("idiot", True, 3.0), toxicity.Term("idiot", False, 2.0)][::order])
        assert [trie.match(w) and trie.match(w)[1] for w in ("idiot", "idiotic", "idxot", "idxotic")] == [0, 0, 1, None]


def test_quality_is_fitted_on_every_labelled_row(spark):
    """A sign that only a few of 20,200 labelled rows carry, whatever the hashes of their ids, and the cut from all strengths."""
    from lumentrail.llm import quality

    rng = np.random.default_rng(4)
    df = spark.range(20_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words of row "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " !!!! !!!!").otherwise("")).alias("text"))
    last = {r.doc_id for r in df.select("doc_id").orderBy(F.xxhash64("doc_id").desc(), F.desc("doc_id")).limit(200).collect()}  # those beyond the smallest hashes of 20,000
    docs = df.withColumn("text", F.when(F.col("doc_id").isin(*last), F.lit("$$$$ %%%% $$$$ %%%%")).otherwise(F.col("text")))
    labels = docs.select("doc_id", F.when(F.col("doc_id").isin(*last), 0).otherwise((F.col("doc_id") % 2).cast("int")).alias("quality"))
    model = quality.fit_quality(docs, labels, group_rows=4_000)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all((s >= 0.3) == (i % 2 == 1 and i not in last) for i, s in got.items())
    values = rng.standard_normal(1_000).round(3)
    ranked = np.sort(values)
    for n_bad in (1, 300, 999):
        lo = max(0, n_bad - 5)
        at = lo + int(np.argmax(np.diff(ranked[lo : min(1_000, n_bad + 5)])))
        assert quality.quantile_cut(spark.createDataFrame([(float(v),) for v in values], "s double"), 1_000, n_bad) == (ranked[at] + ranked[at + 1]) / 2
