import random
from fractions import Fraction

import numpy as np

from tidemark.llm import mixing as m


def greedy(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        left = [(-Fraction(votes[i], 2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < most[i] and votes[i]]
        if not left:
            break
        out[min(left)[1]] += 1
    return out


def test_apportionment_is_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 6)
        votes, most, seats = [rng.randint(0, 200) for _ in range(n)], [rng.randint(0, 90) for _ in range(n)], rng.randint(0, 300)
        assert m.sainte_lague(votes, seats, most) == greedy(votes, seats, most)


def test_many_seats():
    got = m.sainte_lague([Fraction(5), Fraction(3), Fraction(1)], 9 * 10**12, [10**14] * 3)
    assert got == [5 * 10**12, 3 * 10**12, 10**12]


def test_water_fill():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes, weights = [rng.randint(0, 1000) for _ in range(n)], [m.WEIGHTS[i % 3] for i in range(n)]
        t = m.water_fill(sizes, weights)
        assert sum(t) == sum(sizes) and all(x <= 3 * s for x, s in zip(t, sizes, strict=True))
        free = [i for i in range(n) if t[i] < 3 * sizes[i]]
        assert len({t[i] / weights[i] for i in free}) <= 1  # those below their cap share by weight
        if free:
            assert all(t[i] / weights[i] <= t[free[0]] / weights[free[0]] for i in range(n))


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(m.permuted(np.arange(n), np.full(n, n), np.full(n, 9))) == list(range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS size", "8 AS taken", "9 AS shard")


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 300)), rng.choice("aaaabbc")) for i in range(400)] + [(400, None, "a"), (401, "", None), (402, "x y", None), (402, "x y", None)]
    df = docs(spark, rows)
    got = m.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, m.mix(df.repartition(7)).collect()), key=repr)
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        x = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        x[0] += r.size
        x[1] += r.taken
    assert set(by) == {"a", "b", "c", None}
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 2 * m.BLOCK_WORDS
    assert abs(sum(x[3] for x in by.values()) - sum(x[0] for x in by.values())) < 1e-6


def test_copies_and_empty(spark):
    rows = [(i, "w " * 50, "a" if i < 300 else "b") for i in range(330)] + [(900, None, "a")]
    df = docs(spark, rows)
    out = m.copies(df)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.where("text is not null").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    goal = {r.source: r.target / 50 for r in m.mix(df).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - goal[s]) < 0.25 * goal[s] for s in words) and out.where("doc_id = 900").count() == 1
    assert m.mix(df.limit(0)).collect() == [] and m.copies(df.limit(0)).collect() == []


def filled(sizes, weights):
    """Targets: what is above a cap is shared anew until none is."""
    capped: set = set()
    while True:
        left, w = sum(sizes) - sum(3 * sizes[i] for i in capped), sum(weights[i] for i in range(len(sizes)) if i not in capped)
        out = [Fraction(3 * sizes[i]) if i in capped else Fraction(left * weights[i], w) for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in capped and out[i] > 3 * sizes[i]}
        if not more:
            return out
        capped |= more


def test_taken_matches_brute_force(spark, monkeypatch):
    """Word by word: lines, blocks, quotas by greedy quotients, blocks picked in whole passes and then by the permutation."""
    monkeypatch.setattr(m, "SHARD_WORDS", 900)
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 200]), rng.choice(["a", "a", "a", "b", None])) for i in range(120)]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in m.mix(df).collect()}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size_of = {i: len(t.split()) for i, t, _ in rows}
    sizes = [sum(size_of[i] for i, _, s in rows if s == x) for x in sources]
    targets = filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))])
    shards = [max(1, -(-n // 900)) for n in sizes]
    drawn = {
        r.doc_id: (r.turn, r.h) for r in df.selectExpr("doc_id", "xxhash64(42, doc_id) AS turn", "xxhash64(43, doc_id, cast(size(filter(split(text, ' '), x -> x <> '')) AS bigint)) AS h").collect()
    }
    lines: dict = {}
    for i, _, s in rows:
        k = sources.index(s)
        lines.setdefault((k, drawn[i][1] % shards[k]), []).append(i)
    blocks = {key: -(-sum(size_of[i] for i in own) // 16) for key, own in lines.items()}
    have = [sum(b for (k, _), b in blocks.items() if k == x) for x in range(len(sources))]
    quotas = greedy(targets, round(Fraction(sum(sizes), 16)), [3 * h for h in have])
    keys = {(r.source, r.shard): r.key for r in spark.createDataFrame([(sources[k], h) for k, h in lines], "source string, shard long").selectExpr("*", "xxhash64(42, coalesce(source, '\0'), shard) AS key").collect()}
    for k, source in enumerate(sources):
        own = sorted(h for kk, h in lines if kk == k)
        for h, quota in zip(own, greedy([blocks[k, h] for h in own], quotas[k], [3 * blocks[k, h] for h in own]), strict=True):
            n = blocks[k, h]
            words = [i for i in sorted(lines[k, h], key=lambda i: (drawn[i][0], i)) for _ in range(size_of[i])]
            order = m.permuted(np.arange(n), np.full(n, n), np.full(n, keys[source, h], np.int64)) if n else []
            times = [quota // n + (order[b] < quota % n) for b in range(n)]
            taken: dict = {}
            for at, i in enumerate(words):
                taken[i] = taken.get(i, 0) + int(times[at // 16])
            for i in lines[k, h]:
                assert (got[i].taken, got[i].size, got[i].source_size) == (taken.get(i, 0), size_of[i], sizes[k])
                assert abs(got[i].target - float(targets[k])) < 1e-6


def test_sources_that_do_not_fit_the_driver_give_the_same_mix(spark, monkeypatch):
    rng = random.Random(12)
    for trial in range(2):
        names = [None, "", *(f"s{i}" for i in range(30)), "é", "\U0001f600", "\uffff"]
        size = (lambda: rng.choice([0, 3, 60, 700])) if trial else (lambda: 40)  # with equal sizes, ties decide
        rows = [(i, "w " * size(), names[i % len(names)] if trial == 0 else rng.choice(names)) for i in range(210)]
        df = docs(spark, rows)
        monkeypatch.setattr(m, "SHARD_WORDS", 900)
        monkeypatch.setattr(m, "MAX_SOURCES", 100_000)
        want = sorted(map(tuple, m.mix(df).collect()), key=repr)
        monkeypatch.setattr(m, "MAX_SOURCES", 0)
        got = sorted(map(tuple, m.mix(df).collect()), key=repr)
        assert [(*r[:4], round(r[4], 6), r[5]) for r in got] == [(*r[:4], round(r[4], 6), r[5]) for r in want]
    assert m.mix(df.limit(0)).collect() == []
