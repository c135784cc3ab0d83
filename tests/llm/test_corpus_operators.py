"""Operators over whole corpora: deduplication, mixing, components and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import bloom, embed_dedup, exact_dedup, minhash_dedup, mixing
from mnemospark.llm.components import connected_components


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 1), *links[:9]], "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == closure(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("most", [bloom.BROADCAST_WORDS, 10])
def test_bloom_has_no_false_negatives(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "BROADCAST_WORDS", most)  # broadcast, and joined by a shuffle
    rows, wanted = spark.range(5000), spark.range(0, 5000, 7)
    left = bloom.only_possible(rows, "id", wanted)
    assert left.join(wanted, "id").count() == wanted.count() and left.count() < 900


def test_bloom_passes_few_by_chance_at_any_size(spark):
    for n in (20_000, 300_000):
        rows = spark.range(n)
        table, words = bloom.filter_of(rows, "id", n, hits=2)
        assert bloom.with_flag(rows, "id", table, words, "flag").where("flag").count() < 0.004 * n


# ---- exact


def exact_rows():
    return [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "unique"), (8, "A b"), (9, "a\xa0b"), (10, "a b"), (10, "a b"), (None, "ab"), (11, "é" * 40_000), (12, "é" * 40_000 + " ")]


def test_exact_duplicates(spark):
    rows = exact_rows() + [(100 + i, "many copies") for i in range(400)]
    df = spark.createDataFrame([(i, t, True, -1) for i, t in rows], "doc_id bigint, text string, kept boolean, __n int")
    got = exact_dedup.exact_duplicates(df).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", t or ""), []).append((-len(t or ""), -1 if i is None else i, i))
    by = {}
    for key, members in groups.items():
        for _, _, i in members:
            by.setdefault(i, []).append((min(members)[2], len(members)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) in by[r.doc_id] and r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


# ---- MinHash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(25):
        base = text(rng.randint(20, 200))
        add(base)
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            add(other)
    common, hub = text(60), text(120)
    for _ in range(60):  # a passage that many share, and a great group of near copies about the threshold
        add(text(60) + common)
        other = list(hub)
        for _ in range(rng.randint(1, 5)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        add(other)
    for _ in range(50):
        add(hub)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three")]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 32)  # several blocks to a bucket
    rows = near_corpus()
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = closure(ids, links)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(None, "no key at all here today", "x", 0)], "doc_id bigint, text string, component_id string, sig int")
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], len(sets[r.doc_id]), expected[r.doc_id] == r.doc_id)
    assert minhash_dedup.drop_near_duplicates(df).count() == sum(r.kept for r in got)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash_dedup.near_duplicates(df).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(again).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_near_duplicates_of_keys_with_several_texts(spark):
    """A key with two texts links what either is near to, in any order of the rows."""
    rng = random.Random(8)
    a, b = ([f"{c}{rng.randrange(900)}" for _ in range(60)] for c in "ab")
    near = lambda w: " ".join([*w[:57], "x", "y", "z"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (9, near(b)), (7, "quite another text of some words"), (7, ""), (9, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
        assert got == {(5, 2, False), (2, 2, True), (3, 2, False), (9, 2, False), (7, 7, True)}
    assert sorted(r.doc_id for r in minhash_dedup.drop_near_duplicates(df.withColumn("__key", F.lit(1)).withColumn("__lost", F.lit(1))).collect()) == [2, 7, 7]


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = list(w)
    for i in range(0, 60_000, 40):
        other[i] = "x"
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:30_000])), (4, "a" * 300_000)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicate_recall_on_the_tables(spark):
    """All links of the table, by an inverted index over whole texts, next to what bands and pruning find."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in df.select("doc_id", "text").collect()}
    holders, links = {}, []
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert got == closure(sorted(sets), links)


def test_posterior_bounds():
    bounds = dict(minhash_dedup.least_matches())
    assert list(bounds) == list(range(16, minhash_dedup.HASHES + 1, 16)) and all(0 < m / n < 0.75 for n, m in bounds.items())
    assert sorted(m / n for n, m in bounds.items()) == [m / n for n, m in bounds.items()]  # more positions, a closer bound


# ---- embeddings


def test_near_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        for k in range(rng.integers(1, 12)):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1, 0.2]), int(c % 3)))
    hot = rng.standard_normal(16)
    rows += [(hot + rng.standard_normal(16) * 0.03, 1) for _ in range(80)] + [(hot, 1)] * 40 + [(hot * 3, 1)] * 3
    data = [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, data[-1][1], None), (n + 6, [float("inf")] + [1.0] * 15, 1), (None, data[-1][1], 1)]
    df = spark.createDataFrame([(*d, 5) for d in data], "vec_id bigint, embedding array<float>, label int, links int")
    good = data[:n]
    v = np.array([d[1] for d in good], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.98) & (np.array([d[2] for d in good])[:, None] == np.array([d[2] for d in good])[None, :])
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if near[i, j]]
    expected = closure(range(n), links)
    got = {r.vec_id: r for r in embed_dedup.near_embeddings(df).collect()}
    assert len(got) == len(data)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[i].sum()) - 1, expected[i], expected[i] == i)
    for i in [*range(n, n + 7), None]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embed_dedup.near_embeddings(df.limit(0)).count() == 0


def test_near_embeddings_of_keys_with_several_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (9, [0.0, 1.0], 1), (4, [1.0, 1.0], 1)]
    for order in (rows, rows[::-1]):
        got = {(r.vec_id, r.component_id, r.kept) for r in embed_dedup.near_embeddings(spark.createDataFrame(order, "vec_id bigint, embedding array<float>, label int").repartition(3)).collect()}
        assert got == {(5, 2, False), (2, 2, True), (3, 2, False), (9, 2, False), (4, 4, True)}


# ---- mixing


def water_level(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, target, live = float(sum(sizes.values())), {}, set(names)
    while live:
        total = sum(weight[s] for s in live)
        over = {s for s in live if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in live}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        live -= over
    return target


@pytest.mark.parametrize("shape", [[40, 40, 40], [400, 2, 300, 5, 1], [1], [3, 900, 900, 900]])
def test_mixture(spark, shape):
    rng = random.Random(6)
    rows, i = [], 0
    for s, n in enumerate(shape):
        for _ in range(n):
            rows.append((i, None if rng.random() < 0.02 else " ".join("w" for _ in range(rng.randint(0, 300))), None if s == 1 else f"s{s}", 1))
            i += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken int")
    got = {r.doc_id: r for r in mixing.mixture(df).collect()}
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for d, t, s, _ in rows:
        n = len((t or "").split())
        assert got[d].size == n and got[d].taken <= 3 * n
        sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + got[d].taken
    target = water_level(sizes)
    for d, _, s, _ in rows:
        assert got[d].source_size == sizes[s] and got[d].target == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3.5 * mixing.BLOCK_WORDS
    assert sorted(map(tuple, mixing.mixture(df.repartition(7)).collect())) == sorted(map(tuple, got.values()))


def test_mixture_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "s"), (3, "", None)], "doc_id bigint, text string, source string")
    assert mixing.mixture(df).count() == 5
    assert mixing.mixture(df.limit(0)).count() == 0
    assert mixing.mixture(df.where("doc_id > 1")).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = mixing.mixture(docs).where("taken > 0").select("doc_id", "taken").orderBy("doc_id").collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    said = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("n")).orderBy("doc_id").collect()
    assert [tuple(r) for r in said] == [tuple(r) for r in taken]


def test_mixed_documents_of_null_and_repeated_keys(spark):
    rows = [(None, f"n{i}", 90 + i) for i in range(12)] + [(7, f"k{i}", 150) for i in range(6)] + [(8, "same", 200)] * 5 + [(100 + i, f"u{i}", 80) for i in range(6)]
    docs = spark.createDataFrame([(k, " ".join([w] * n), "s" if w[0] in "nu" else None, i) for i, (k, w, n) in enumerate(rows)], "doc_id bigint, text string, source string, rid int")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken, said, of_row = {}, {}, {}
    for r in mixing.mixture(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in mixed.collect():
        words = r.text.split()
        assert (r.doc_id, set(words)) == (rows[r.rid][0], {rows[r.rid][1]})
        said[r.doc_id] = said.get(r.doc_id, 0) + len(words)
        of_row[r.rid] = of_row.get(r.rid, 0) + len(words)
    assert said == {k: n for k, n in taken.items() if n} and said[None] and said[7] and said[8]
    assert all(n <= mixing.MOST_REPEATS * rows[i][2] for i, n in of_row.items())
    by_text = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    assert by_text(mixing.mixed_documents(docs.repartition(5))) == by_text(mixed)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4097])
def test_permutation_is_one(n):
    p = mixing.permuted(np.arange(n), n, (1, 2, 3))
    assert sorted(p.tolist()) == list(range(n)) and (p == mixing.permuted(np.arange(n), n, (1, 2, 3))).all()
    if n >= 1000:
        steps = np.diff(p) % n
        assert len(np.unique(steps)) > 0.5 * n  # no one map x -> a * x + b
        assert (p != mixing.permuted(np.arange(n), n, (1, 2, 4))).mean() > 0.9


def test_shard_draws(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    quotas = [900, 0, 70, 5, 403]
    shards = -(-sum(quotas) // 32)
    whole = list(mixing.shard_slots(quotas, 3, range(shards)))
    assert [x for k in range(shards) for x in mixing.shard_slots(quotas, 3, range(k, k + 1))] == whole  # any task draws the same
    for s, q in enumerate(quotas):
        own = [(shard, first, n) for at, shard, first, n in whole if at == s]
        assert sum(n for _, _, n in own) == q and all(f == sum(n for _, _, n in own[:k]) for k, (_, f, _) in enumerate(own))
    for k in range(shards):
        assert sum(n for _, shard, _, n in whole if shard == k) == min(32, sum(quotas) - 32 * k)
    # the counts of a shard are spread as draws without replacement are
    first = np.array([sum(n for s, _, _, n in mixing.shard_slots(quotas, seed, range(1)) if s == 0) for seed in range(400)])
    mean = 32 * 900 / sum(quotas)
    assert abs(first.mean() - mean) < 0.6 and 0.7 < first.var() / (mean * (1 - 900 / sum(quotas))) < 1.3
    rng = np.random.default_rng(1)
    big = [mixing._hypergeometric(rng, 3 * 10**9, 10**9, 4_000_000) for _ in range(50)]
    assert abs(np.mean(big) / 3_000_000 - 1) < 1e-3 and 0 < np.std(big) < 3000


# ---- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = at
        at = stage(spark, before, sf)
        if k < 4:
            assert at.columns == docs.columns
        if k == 0:
            assert sorted(r.doc_id for r in at.select("doc_id").collect()) == sorted(r.doc_id for r in before.where(F.col("text").rlike("\\p{L}")).select("doc_id").collect())
        if k in (1, 2):
            expected = (exact_dedup.exact_duplicates(before) if k == 1 else minhash_dedup.near_duplicates(before)).where("kept").select("doc_id")
            assert sorted(r.doc_id for r in at.select("doc_id").collect()) == sorted(r.doc_id for r in expected.collect())
        if k == 3:
            assert {r.doc_id for r in at.select("doc_id").distinct().collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            known = {r.doc_id: r.lang for r in at.select("doc_id", "lang").collect()}
            labels = {r.doc_id: r.lang for r in before.where("lang is not null").select("doc_id", "lang").collect()}
            assert sum(known[i] == lang for i, lang in labels.items() if i in known) > 0.97 * len(known)
        if k == 4:
            assert at.count() == before.count()
    assert at.columns == ["doc_id", "n_tokens", "ids"]


@pytest.mark.parametrize(("good", "bad", "sample"), [(3000, 7000, 5000), (40, 9000, 300), (5000, 5000, 9990), (8000, 1, 4000), (2000, 3000, 70)])
def test_draws_of_big_populations_are_exact(monkeypatch, good, bad, sample):
    want = np.random.default_rng(1).hypergeometric(good, bad, sample, 20_000)
    monkeypatch.setattr(mixing, "NUMPY_DRAWS", 50)
    rng = np.random.default_rng(2)
    got = np.array([mixing._hypergeometric(rng, good, bad, sample) for _ in range(4000)])
    n = good + bad
    mean, var = sample * good / n, sample * good * bad * (n - sample) / (n * n * (n - 1))
    assert abs(got.mean() - mean) < 4.5 * (var / 4000) ** 0.5 + 1e-9 and abs(got.var() / var - 1) < 0.15
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        x = np.quantile(want, q)
        assert abs((got <= x).mean() - (want <= x).mean()) < 0.04


def test_draws_beyond_numpy():
    rng = np.random.default_rng(3)
    got = [mixing._hypergeometric(rng, 6 * 10**12, 3 * 10**12, 10**12) for _ in range(300)]
    spread = (10**12 * (2 / 3) * (1 / 3) * (8 / 9)) ** 0.5
    z = (np.array(got, float) - 2 / 3 * 1e12) / spread
    assert abs(z.mean()) < 0.25 and 0.8 < z.std() < 1.2
    assert mixing._hypergeometric(rng, 10**12, 0, 7) == 7 and mixing._hypergeometric(rng, 0, 10**12, 7) == 0 and mixing._hypergeometric(rng, 10**12, 5, 10**12 + 5) == 10**12
