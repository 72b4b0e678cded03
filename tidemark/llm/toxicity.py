"""Toxicity by the nearest labelled examples.

Examples are a bounded, seeded sample of labelled documents. Terms are all their
words and word beginnings. A term weighs in a text by its frequency there, its
inverse document frequency over all documents, and a *lean* between 0 and 1: how
surely it is unevenly spread over the labels (by a likelihood ratio over the
examples). The lean only weighs: no term is left out by it.

A document's nearest examples by exact cosine come from an inverted index whose
postings lie in blocks of similar examples, with each term's greatest weight in
each block. The sums of these bound the cosines of a block; blocks are gone
through from the greatest bound on, and those whose bound cannot reach the k-th
best are passed over. The votes, weighted by distance and by how much of its label
an example stands for, are calibrated by isotonic regression on examples that are
scored by a model of the other folds: leans and index are made without them.

What is shipped is bounded by EXAMPLES and EXAMPLE_BYTES; documents are read
for the sample, for the frequencies and for scoring, in place, with no shuffle but
of the sample and the counts.

Cases: null and empty texts and texts without any known term get the rate of
label 1; equal cosines go to the example that comes first by hash; rows that
repeat an id count each; an id with both labels counts as toxic; with no labels
every score is 0; empty tables give empty results; other columns are ignored.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

from ._common import alnum_words, documents, id_text, map_arrow, trim, utf8

EXAMPLES = 1000  #: of each label, at most
EXAMPLE_BYTES = 20_000  #: longer documents are no examples (they are scored like all others)
SURE = 10.0  #: the likelihood ratio at which a term has half of its lean, before it is squared
NEAREST = 15
BLOCK = 32  #: examples of a block
FIRST = 4  #: blocks that are looked at before any can be passed over
OFTEN = 16  #: a term that more than one in so many examples have has its postings in a matrix
TOGETHER = 60_000  #: blocks of postings of the queries that are searched together
FOLDS = 5  #: rows with crc32(id) mod FOLDS = 0 are held out; the others are calibrated in as many folds
STEMS = (5,)  #: bytes of the word beginnings


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after another."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Vectors (terms and weights of each) as postings by term, in blocks."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n = len(vectors)
        # examples whose strongest terms are equal lie together
        lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda i: (lead[i], i)), np.int64)
        self.blocks = -(-self.n // BLOCK)
        sizes = np.array([len(vectors[i][0]) for i in self.order], np.int64)
        at = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        term = np.concatenate([vectors[i][0] for i in self.order]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if self.n else np.zeros(0)
        # terms that many examples have: their postings are rows of a matrix
        self.row = np.full(terms, -1)
        often = np.flatnonzero(np.bincount(term, minlength=terms) > max(1, self.n // OFTEN))
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], at[dense]] = weight[dense]
        at, term, weight = at[~dense], term[~dense].astype(np.int64), weight[~dense]
        by = np.argsort(term, kind="stable")
        term, self.at, self.weight = term[by], at[by], weight[by]
        own = term * max(self.blocks, 1) + self.at // BLOCK
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        #: of each block of a term's postings: where it starts, which block it is, its greatest weight
        self.start = np.concatenate([first, [len(term)]]).astype(np.int64)
        self.block = (own[first] % max(self.blocks, 1)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(term[first], np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> list[tuple[float, int]]:
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[list[tuple[float, int]]]:
        """Of each query the k vectors of greatest cosine above 0, best first, earlier ones first among equals. Exact."""
        out: list[list[tuple[float, int]]] = []
        sizes = [int((self.entry[t + 1] - self.entry[t]).sum()) for t, _ in queries]
        at = 0
        while at < len(queries):  # as many together as have TOGETHER blocks of postings
            end, held = at + 1, sizes[at]
            while end < len(queries) and end - at < 64 and held + sizes[end] <= TOGETHER:
                held += sizes[end]
                end += 1
            out += self._search(queries[at:end], k)
            at = end
        return out

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        count, blocks, n = len(queries), self.blocks, self.blocks * BLOCK
        if not n or not any(len(t) for t, _ in queries):
            return [[] for _ in queries]
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        query, row = np.repeat(np.arange(count), [len(t) for t, _ in queries]), self.row[terms]
        asked = np.zeros((count, len(self.rows)))
        asked[query[row >= 0], row[row >= 0]] = weights[row >= 0]
        scores = asked @ self.rows
        a, b = self.entry[terms], self.entry[terms + 1]
        entries, own = _spans(a, b), np.repeat(weights, b - a)
        query = np.repeat(query, b - a)
        block = query * blocks + self.block[entries]
        # what a block can have at most: of the terms in the matrix by what its examples have, of the others by their greatest weights
        bound = scores.reshape(count, blocks, BLOCK).max(axis=2) + np.bincount(block, own * self.most[entries], count * blocks).reshape(count, blocks)
        turn = np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, :FIRST]
        now = np.zeros((count, blocks), bool)
        np.put_along_axis(now, turn, True, axis=1)
        eps = 1e-9
        floor = np.full((count, 1), eps)
        for rest in (True, False):
            mine = now.ravel()[block]
            s, e = self.start[entries[mine]], self.start[entries[mine] + 1]
            posts = _spans(s, e)
            at = np.repeat(query[mine] * n, e - s) + self.at[posts]
            scores += np.bincount(at, self.weight[posts] * np.repeat(own[mine], e - s), count * n).reshape(count, n)
            if n > k:
                floor = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1], eps)
            if rest:  # blocks that may still reach the k-th best
                now = (bound >= floor - eps) & ~now
        out = []
        for i in range(count):
            found = np.flatnonzero(scores[i, : self.n] >= floor[i] - eps * (floor[i] > eps))
            best = sorted((-round(float(x), 10), int(o)) for x, o in zip(scores[i][found], self.order[found], strict=True))[:k]
            out.append([(-x, o) for x, o in best])
        return out


class Terms:
    """Numbers of words and word beginnings."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.stems: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def learn(self, words: set[bytes]) -> None:
        for w in words:
            if w not in self.words:
                self.words[w] = len(self)
            for n in STEMS:
                if len(w) >= n and w[:n] not in self.stems:
                    self.stems[w[:n]] = len(self)

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and how often each is there."""
        times = Counter(words)
        each = np.fromiter(times.values(), np.float64, len(times))
        terms = [np.fromiter(map(self.words.get, times, repeat(-1)), np.int64, len(times))]
        terms += [np.fromiter(map(self.stems.get, [w[:n] for w in times], repeat(-1)), np.int64, len(times)) for n in STEMS]
        found, back = np.unique(np.concatenate(terms), return_inverse=True)
        n = np.bincount(back, np.tile(each, len(terms)), len(found))
        unknown = int(len(found) and found[0] < 0)
        return found[unknown:], n[unknown:]

    def set_of(self, words: list[bytes]) -> np.ndarray:
        """Terms of a text, each once."""
        own = set(words)
        has = {self.words.get(w, -1) for w in own}
        for n in STEMS:
            has.update(map(self.stems.get, {w[:n] for w in own}, repeat(-1)))
        has.discard(-1)
        return np.fromiter(has, np.int64, len(has))

    def names(self) -> list[bytes]:
        """The word of each number; of a beginning with a hyphen."""
        out = [b""] * len(self)
        for w, i in self.words.items():
            out[i] = w
        for w, i in self.stems.items():
            out[i] = w + b"-"
        return out


def leans(have: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """Of each term, from how many examples of either label (rows of ``have``)
    have it: between 0 and 1."""
    a, b = have[1].astype(float), have[0].astype(float)
    c, d = total[1] - a, total[0] - b
    n = max(sum(total), 1)
    g2 = np.zeros(len(a))
    for x, row, col in ((a, a + b, total[1]), (b, a + b, total[0]), (c, c + d, total[1]), (d, c + d, total[0])):
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 += np.where(x > 0, x * np.log(x * n / (row * col)), 0.0)
    g2 = np.maximum(2 * g2, 0.0)
    return (g2 / (g2 + SURE)) ** 2


class Model:
    """Examples, their terms' weights, the index of their vectors and the calibration."""

    def __init__(self, terms: Terms, idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], stands: dict[int, float], names: list):
        self.terms, self.idf, self.labels, self.stands, self.names = terms, idf, labels, stands, names
        have = np.zeros((2, len(idf)))
        for (t, _), y in zip(counts, labels, strict=True):
            have[y, t] += 1
        self.weight = idf * leans(have, (labels.count(0), labels.count(1)))
        self.index = Index([self.vector(*c) for c in counts], len(idf))
        mass = sum(stands[y] for y in labels)
        self.prior = sum(stands[y] for y in labels if y) / mass if mass else 0.0
        self.steps: list[tuple[float, float]] = []  #: from this raw score on: calibrated

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length 1; terms that say nothing (in as many examples of each label as chance has it) are left out."""
        w = (1 + np.log(counts, dtype=np.float64)) * self.weight[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / math.sqrt((w * w).sum()) if len(w) else w

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.vector(*self.terms.counts(alnum_words(text)))

    def raw(self, near: list[tuple[float, int]]) -> float:
        votes = [(self.stands[self.labels[i]] / (1.05 - s), self.labels[i]) for s, i in near]
        return (sum(v for v, y in votes if y) + 0.5 * self.prior) / (sum(v for v, _ in votes) + 0.5)

    def score(self, near: list[tuple[float, int]]) -> float:
        """Between the steps of the calibration scores rise with the votes."""
        if not near:
            return self.prior
        raw = self.raw(near)
        return float(np.interp(raw, *zip(*self.steps, strict=True))) if self.steps else raw


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (raw, label, weight): (middle of the raw scores, value) of each pool, ascending."""
    pools: list[list[float]] = []
    for raw, y, w in sorted(points):
        pools.append([raw * w, y * w, w, raw])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][3] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            r, a, b, last = pools.pop()
            pools[-1] = [pools[-1][0] + r, pools[-1][1] + a, pools[-1][2] + b, last]
    out: list[tuple[float, float]] = []
    for r, a, n, _ in pools:  # half an example of each label keeps values off 0 and 1
        out.append((r / n, max((a + 0.5) / (n + 1), out[-1][1] if out else 0.0)))
    return out


def _different(texts: Iterable[list[bytes]]) -> list[int]:
    """Which texts to keep so that none is a near copy of one before: no two
    that share half of eight least hashes of their word triples."""
    seen: list[set[int]] = [set() for _ in range(8)]
    keep = []
    salts = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i, words in enumerate(texts):
        grams = {zlib.crc32(b" ".join(words[j : j + 3])) for j in range(max(1, len(words) - 2))} if words else {0}
        mixed = (np.fromiter(grams, np.uint64)[:, None] ^ salts) * np.uint64(0xD6E8FEB86659FD93)
        least = (mixed >> np.uint64(16)).min(axis=0).tolist()
        if sum(h in s for h, s in zip(least, seen, strict=True)) < 4:
            keep.append(i)
        for h, s in zip(least, seen, strict=True):
            s.add(h)
    return keep


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``labels`` has doc_id and toxic; rows of the held-out fold are not looked at."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # a threshold on the hash first, so that tasks send few rows to the limit
    drawn = lambda y: known.where((F.col("toxic") == y) & (F.pmod("h", F.lit(1 << 32)) <= int(min(2 * EXAMPLES / sizes.get(y, 1), 1) * (1 << 32))))
    sample = drawn(1).orderBy("h").limit(EXAMPLES).unionByName(drawn(0).orderBy("h").limit(EXAMPLES))
    chosen = (
        id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # 2 x EXAMPLES rows at most
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES)
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"), F.first("h").alias("h")).collect()
    )
    chosen.sort(key=lambda r: (r["h"], r["doc_id"]))
    # texts are parted into words anew each time: their words together would fill the driver
    texts = [(r["text"] or "").encode() for r in chosen]
    keep = _different(map(alnum_words, texts))
    texts, labels_, names = [texts[i] for i in keep], [chosen[i]["toxic"] for i in keep], [chosen[i]["doc_id"] for i in keep]
    del chosen
    terms = Terms()
    for text in texts:
        terms.learn(set(alnum_words(text)))
    found, rows = frequencies(docs, terms, id_col, text_col)
    model = fitted(terms, np.log(1 + rows / (1 + found)), map(alnum_words, texts), labels_, sizes, names)
    trim()
    return model


def fitted(terms: Terms, idf: np.ndarray, texts: Iterable[list[bytes]], labels: list[int], sizes: dict[int, int], names: list) -> Model:
    """The model of these examples. ``sizes``: how many labelled documents they stand for."""
    counts = [(t.astype(np.int32), c.astype(np.float32)) for t, c in map(terms.counts, texts)]
    n = Counter(labels)
    stands = {y: sizes[y] / n[y] for y in n}
    points = []
    for fold in range(FOLDS if len(n) == 2 else 0):  # one index at a time is held
        others = [i for i in range(len(labels)) if i % FOLDS != fold]
        part = Model(terms, idf, [counts[i] for i in others], [labels[i] for i in others], stands, [])
        own = range(fold, len(labels), FOLDS)
        for i, near in zip(own, part.index.nearest_of([part.vector(*counts[i]) for i in own]), strict=True):
            if near:
                points.append((part.raw(near), float(labels[i]), stands[labels[i]]))
        del part
    model = Model(terms, idf, counts, labels, stands, names)
    steps = isotonic(points)
    # beyond the middle of the outer pools scores go on half of the way to 0 and 1
    model.steps = [(-1e-9, steps[0][1] / 2), *steps, (1 + 1e-9, (1 + steps[-1][1]) / 2)] if steps else []
    return model


def held_out(key) -> object:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def frequencies(docs: DataFrame, terms: Terms, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are."""
    spark = docs.sparkSession
    ship(spark)
    held, token, size = spark.sparkContext.broadcast(terms), uuid.uuid4().hex, len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _held(token, held)
        n = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in utf8(batch.column(1)):
                n[own.set_of(alnum_words(text))] += 1
                n[size] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["term", "n"])
        trim()

    counts = id_text(docs, id_col, text_col).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    held.destroy()
    return out[:size], int(out[size])


_models: dict[str, object] = {}


def _held(token: str, shipped):
    if token not in _models:
        _models.clear()
        _models[token] = shipped.value
    return _models[token]


def _names(token: str, shipped) -> list[bytes]:
    if f"{token}-names" not in _models:
        model = _held(token, shipped)
        _models[f"{token}-names"] = model.terms.names()
    return _models[f"{token}-names"]


def _searched(m: Model, texts: Iterator[bytes]) -> tuple[list, list]:
    """Vectors of the texts, and their nearest examples."""
    vectors = [m.of(t) for t in texts]
    return vectors, m.index.nearest_of(vectors)


SHOWN = 8  #: terms of greatest weight that are told with a score
EVIDENCE = "array<struct<example:string,cosine:double,toxic:int>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, terms (the SHOWN strongest) and evidence (nearest examples) of every row."""
    spark = docs.sparkSession
    ship(spark)
    shipped, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def rows(batch):
        m, names = _held(token, shipped), _names(token, shipped)
        for key, (t, w), near in zip(batch.column(0).to_pylist(), *_searched(m, utf8(batch.column(1))), strict=True):
            top = t[np.lexsort((t, -w))[:SHOWN]].tolist()
            yield key, m.score(near), [names[x].decode("utf-8", "replace") for x in top], [{"example": str(m.names[i]), "cosine": s, "toxic": m.labels[i]} for s, i in near]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(id_text(docs, id_col, text_col), rows, f"doc_id {kind}, score double, terms array<string>, evidence {EVIDENCE}", lambda r: 40 * len(r[3]))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (needs text) that score below ``threshold``, with all their columns."""
    ship(docs.sparkSession)
    shipped, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def kept(batches):
        m = _held(token, shipped)
        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([m.score(near) < threshold for near in _searched(m, texts)[1]], type=pa.bool_()))
        trim()

    return docs.mapInArrow(kept, docs.schema)


def op10_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.to_json(F.slice("evidence", 1, 3)).alias("evidence"),
    )
