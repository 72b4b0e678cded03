import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _words
from tidemark.llm import jaccard as j
from tidemark.llm.graph import components


def brute_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("chunk", [8, 64, 2 << 20])
def test_grams(monkeypatch, chunk):
    monkeypatch.setattr(_words, "CHUNK", chunk)
    rng = random.Random(chunk)
    parts = ["the", "of", "É", "é", "A", "a", "\t", " ", "\n", "x y", "Zz", "  ", "ß", "\x1c", "日本"]
    for _ in range(40):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(rng.randint(1, 10))]
        for n in (1, 3, 5):
            got = list(j.all_grams(pa.array(["skipped", *texts], pa.string()).slice(1), n))
            want = [brute_set(x, n) for x in texts]
            assert [len(g) for g in got] == [len(w) for w in want]
            for a in range(len(texts)):
                for b in range(len(texts)):
                    assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])
                    assert (j.set_key(got[a]) == j.set_key(got[b])) == (want[a] == want[b])


def random_sets(rng):
    base = [{rng.randrange(200) for _ in range(rng.randint(1, 60))} for _ in range(rng.randint(1, 4))]
    out = []
    for _ in range(rng.randint(1, 40)):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(rng.randrange(1000))
        out.append(np.array(sorted(s), np.uint64))
    return out


def test_tries_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        num, den = rng.choice([(90, 100), (80, 100), (1, 2)])
        sets = random_sets(rng)
        own, rank, _ = j.ranked(sets)
        trie = j.Trie(own, len(rank))
        up = list(range(len(sets)))
        for i, a in enumerate(sets):
            want = [k for k, b in enumerate(sets) if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))]
            assert sorted(trie.linked(own[i], num, den)) == want
            for k in want:
                up = [up[i] if x == up[k] else x for x in up]
        got = j.cell_components(sets, num, den)
        assert all((got[a] == got[b]) == (up[a] == up[b]) for a in range(len(sets)) for b in range(len(sets)))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{rng.randrange(400)}" for _ in range(4))])
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, 120))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [None, "", "  ", "a b", "A  b", "a b", "c"]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[1]), (None, rows[2])]


def expected(rows, n, num, den):
    sets = [brute_set(t, n) for _, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up = [up[b] if x == up[a] else x for x in up]
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[up[i]] = min(least.get(up[i], k), k)
    return [(k, len(sets[i]), least.get(up[i]) if sets[i] else k) for i, (k, _) in enumerate(rows)], up, sets


@pytest.mark.parametrize("n,num,den,limits", [(3, 90, 100, {}), (5, 80, 100, {}), (2, 80, 100, {"cell_grams": 300, "pivots": 2})])
def test_join_matches_brute_force(spark, tmp_path, n, num, den, limits):
    rows = corpus(n)
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS node", "3 AS component").repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    want, up, sets = expected(rows, n, num, den)
    got = j.join(df, n=n, num=num, den=den, **limits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = j.one_of_each(df, n=n, num=num, den=den, **limits)
    assert kept.columns == df.columns
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    groups: dict = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(up[i] if sets[i] else ("empty", i), []).append(-1 if k is None else k)
    assert len(ids) == len(groups)
    assert ids == sorted(min((k for k in g if k >= 0), default=-1) for g in groups.values())


def test_rows_are_found_again_when_files_are_dealt_otherwise(spark, tmp_path):
    """As when executors come or go between two scans: files go to other partitions."""
    rows = [(i, f"a{i // 3} b{i // 3} c{i // 3} d{i // 3} e{i // 3} f{i // 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS k_place", "1 AS place").repartition(12, "doc_id").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # below the cost of opening a file: a file each
        kept = j.one_of_each(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)  # several files a partition
        assert sorted(map(tuple, kept.collect())) == [(*rows[i], i, 1) for i in range(0, 60, 3)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_frequent_grams_are_counted_in_bounded_parts(spark, monkeypatch):
    """Grams of a slot count together, and a part of a batch is counted when it has COUNTED grams."""
    counted = spark.createDataFrame([(5, 3), (5 + j.SLOTS, 5), (9, 1), (9 + j.SLOTS, 1), (11, 1)], "gram long, n long")
    table = j._table(counted)
    assert [table[i] for i in (5, 9, 11, 12)] == [3, 1, 0, 0]
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(4)], "doc_id long, text string").coalesce(1)
    assert (j.often(docs, 1) > 0).sum() == 2
    monkeypatch.setattr(j, "COUNTED", 1)  # a text a part: none repeats in its own
    assert (j.often(docs, 1) > 0).sum() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(df).collect() == [] and j.one_of_each(df).collect() == []


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])  # of op6 and of the pipeline
def test_grams_shared_by_chance_make_no_cell(spark, monkeypatch, n, num):
    """Each gram below is in three long texts, and no text is near another: there are no cells."""
    monkeypatch.setattr(j, "COUNTED", 1)  # a text a part: the shared grams pass for seldom ones, as they do in large tables
    words = [[f"w{i}x{k}" for k in range(600)] for i in range(40)]
    for g in range(38):
        for i in range(g, g + 3):
            words[i][40 * (g % 3) : 40 * (g % 3) + n] = [f"shared{g}longer{k}" + "z" * 20 for k in range(n)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    rows = j.keyed(docs, n, num, 100)
    nodes = rows.groupBy("k1", "k2").agg(F.min("place").alias("node"), F.max("n_shingles").alias("n_shingles"), F.first("outline").alias("outline"))
    assert j._cells(rows.select(F.col("k1").alias("a"), "n_shingles", "prefix"), nodes, num, 100).count() == 0


@pytest.mark.parametrize("meet,extra", [(1, 256), (2, 8), (5, 4), (64, 8)])
def test_pairs_and_stars_lose_no_link(spark, monkeypatch, meet, extra):
    monkeypatch.setattr(j, "MEET", meet)
    monkeypatch.setattr(j, "EXTRA", extra)
    rows = corpus(meet + extra)
    want, _, _ = expected(rows, 2, 80, 100)
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=2, num=80, den=100).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_sets_are_of_the_rows_that_nodes_name(spark):
    """Rows with a place are read for their sets only where a node names them: not other copies, not other texts."""
    docs = spark.createDataFrame([(i, f"a b c d{i % 3}", 1 << 33 | i) for i in range(12)], "doc_id long, text string, place long").repartition(12, "doc_id")
    rows = j.keyed(docs, 3, 90, 100)
    wanted = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("place").alias("node"))
    assert sorted(r.node & 15 for r in wanted.collect()) == [0, 1, 2]
    assert j._sets(docs, 3, wanted).count() == 3
    assert j._sets(docs.drop("place"), 3, wanted).count() > 3  # without places: every copy in another batch


def test_grams_of_one_node_are_left_at_once(spark):
    texts = ["a b c d e f", "a b c d e g", "h i j k l m"]
    rows = j.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 1, 10, 100)
    prefixes = rows.select(F.col("k1").alias("a"), "n_shingles", "prefix")
    grams = [set(map(int, next(j.all_grams(pa.array([x]), 1)).view(np.int64))) for x in texts]
    have = [set(r.prefix) for r in prefixes.collect()]
    shared = sum(len(have[x] & have[y]) > 0 for x in range(3) for y in range(x))
    met = j._met(prefixes, 10, 100).collect()
    assert shared == 1 and len({r.a for r in met}) == 2 and all(r.b is None for r in met) and not grams[0] & grams[2]
