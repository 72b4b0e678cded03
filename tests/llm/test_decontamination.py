import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import _words
from tidemark.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        b = words(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            p = b[i : i + 10]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    names.add(name)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "É", "é", "d1", "the", "of"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 3, 9, 10, 14, 30]))) for i in range(8)] + [("7", text(12))]
    docs = []
    for i in range(30):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            piece = words(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(piece) - 10))
            t += " - " + " ".join(piece[at : at + rng.randint(8, 14)]) + " . " + text(5)
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, "...")], items


def test_search_matches_brute_force(spark):
    for seed in range(4):
        docs, items = cases(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS spans", "3 AS n_words")
        bench = spark.createDataFrame(items, "item_id string, text string")
        for limit in (d.BLOCK_BYTES, 200):  # in one block, and in several
            got = {r.doc_id: tuple(r)[1:] for r in d.report(d.scan(df, bench, block_bytes=limit)).collect()}
            assert got == {k: brute(t, items) for k, t in docs}
            kept = {r.doc_id for r in d.clean(df, bench, limit).collect()}
            assert kept == {k for k, t in docs if not brute(t, items)[4]}


def test_clean_judges_each_row_whatever_the_blocks(spark, monkeypatch):
    docs = [(1, "so it goes on"), (1, "x one two three x"), (None, "nothing"), (None, "four five six"), (2, "one two three four five six"), (3, None), (3, "so")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS spans")
    bench = spark.createDataFrame([("a", "one two three"), ("b", "four five six"), (None, "seven"), ("c", None)], "item_id string, text string")
    want = sorted([(1, "so it goes on", 1), (None, "nothing", 1), (3, None, 1), (3, "so", 1)], key=repr)
    for limit in (d.BLOCK_BYTES, 12):  # in one block, and in several
        monkeypatch.setattr(d, "BLOCK_BYTES", limit)
        assert sorted(map(tuple, d.clean(df, bench).collect()), key=repr) == want


def test_single_length_searches(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        monkeypatch.setattr(d, "SEGMENT", rng.choice([1, 3, 128]))
        monkeypatch.setattr(_words, "CHUNK", rng.choice([4, 64, 1 << 18]))
        m = rng.randint(1, 5)
        patterns = [" ".join(rng.choice("abc") for _ in range(m)) for _ in range(rng.randint(1, 5))]
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]
        search = d.Searcher([(str(i), p) for i, p in enumerate(patterns)], window=m)
        for text, (n, spans, items) in zip(texts, search.find(pa.array(texts)), strict=True):
            w = text.split()
            at = [i for i in range(len(w) - m + 1) if " ".join(w[i : i + m]) in patterns]
            assert n == len(w) and sorted(spans) == [(i, i + m) for i in at]
            assert items == {k for k, p in enumerate(patterns) if any(" ".join(w[i : i + m]) == p for i in at)}


def test_equal_hashes_are_told_apart_by_their_words(monkeypatch):
    """All windows in one bucket: only the comparison is left."""
    monkeypatch.setattr(d, "_wholes", lambda h, first, m: np.zeros(len(first), np.uint64))
    search = d.Searcher([("x", "a b c")], window=3)
    assert [spans for _, spans, _ in search.find(pa.array(["z a b c", "z b c", "y b c a b c"]))] == [[(1, 4)], [], [(3, 6)]]


def test_very_long_text_and_item(spark):
    filler = " ".join(f"w{i % 997}" for i in range(150_000))
    passage = " ".join(f"p{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{filler} {passage} {filler}"), (2, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", passage), ("y", " ".join(f"q{i}" for i in range(200_000)))], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in d.report(d.scan(df, bench)).collect()}
    assert got == {1: (300_012, 12, 1), 2: (150_000, 0, 0)}


def test_memory_of_a_block_is_bounded():
    """Bytes of the arrays that a worker holds, a byte of items."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200_000))
    s = d.Searcher([(str(i), text[i * 12_000 : (i + 1) * 12_000]) for i in range(100)])
    held = sum(x.nbytes for w in s.searches for x in (w.keys, w.first, w.owners, w.owned, w.shift)) + s.texts.nbytes + s.begin.nbytes
    assert held < 8 * len(text)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in d.report(d.scan(docs, none)).collect()] == [(2, 0, 0)]
    assert d.report(d.scan(docs.limit(0), none)).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (1, None)], "item_id long, text string")
    assert d.report(d.scan(docs, odd)).first().n_hit == 2 and d.clean(docs, odd).count() == 0
