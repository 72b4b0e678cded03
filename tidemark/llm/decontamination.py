"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, as 64-bit hashes. A search has all windows of one length m.
Its shift table, addressed by a hash of the block of two words that ends at a place,
says how far the place may move (m - 1 past a block that no window has); places are
moved on many at once, in segments of the texts. A shift of 0 leads to the bucket:
the hash of the whole window among the sorted hashes of all windows, so that many
windows that end alike cost one search. What is found there is compared word by word
with the window's text.

Benchmark items are read on the driver in blocks of a bounded size and shipped as
a broadcast of arrays, about five bytes in a worker's memory a byte of items (so 85
MB for a block of BLOCK_BYTES). With one block, documents are read once, in place.
With more, they are read once a block and a last time, never rewritten: what a block
finds is kept by a digest of the text, which only texts with hits have a row for. Both
ways give the same rows. An item lies in one block, so one of more than BLOCK_BYTES
makes a larger one.

Cases: null and empty texts have no words and are clean; items without words
have no windows; an item of fewer than 10 words is one window; repeated items
and rows each count, each row by its own text; an item with a null id is named by
the empty string; empty tables give clean documents or no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

from ._common import alnum_words, documents, id_text, map_arrow, stage, utf8
from ._words import ALNUM, M1, mix, words_of

WINDOW = 10
BLOCK_BYTES = 16 << 20
SEGMENT = 128  #: places that one search goes through
BROADCAST_BYTES = 64 << 20  #: digests of texts with hits are shipped up to this size, beyond it joined by a shuffle


def _pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the two words that end at each place."""
    return mix(h[at - 1] * M1 + h[at])


def _wholes(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m words from each place on."""
    out = h[first].copy()
    for j in range(1, m):
        out *= M1
        out += h[first + j]
    return mix(out + np.uint64(m))


class WuManber:
    """Occurrences of windows of m words. ``h``: hashes of the items' words, one
    after another; ``first``: where windows begin; ``owner``: the item of each."""

    def __init__(self, m: int, h: np.ndarray, first: np.ndarray, owner: np.ndarray):
        self.m = m
        whole = _wholes(h, first, m)
        order = np.lexsort((owner, whole))
        whole, first, owner = whole[order], first[order], owner[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        self.keys = whole[new]  #: of the different windows
        self.first = first[new].astype(np.int32)  #: where one of each is
        other = np.concatenate([[True], owner[1:] != owner[:-1]]) | new
        self.owners = owner[other].astype(np.int32)
        self.owned = np.concatenate([np.flatnonzero(new[other]), [len(self.owners)]]).astype(np.int32)
        bits = min(max(16, 2 + len(self.keys).bit_length()), 26)  # a few slots for each block of two words
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, max(1, m - 1), np.uint8)
        if m == 1:
            self.shift[self._slot(h, first)] = 0
        for end in range(1, m):  # the least shift of a block is written last
            self.shift[self._slot(h, first + end)] = m - 1 - end

    def _slot(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((mix(h[at]) if self.m == 1 else _pairs(h, at)) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may be in texts that lie together (``counts`` words each),
        by their hashes: first word and number of the window, in order."""
        m = self.m
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none
        ends = np.cumsum(counts)
        start = ends - counts + m - 1  # where the first window of a text would end
        cuts = np.maximum(0, -((start - ends) // SEGMENT))
        at = np.repeat(start, cuts) + SEGMENT * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        stop = np.minimum(at + SEGMENT, np.repeat(ends, cuts))
        hits = []
        while len(at):
            step = self.shift[self._slot(h, at)].astype(np.int64)
            hits.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        found = np.sort(np.concatenate(hits)) - m + 1 if hits else none
        if not len(found):
            return none, none
        whole = _wholes(h, found, m)
        place = np.minimum(np.searchsorted(self.keys, whole), len(self.keys) - 1)
        same = self.keys[place] == whole
        return found[same], place[same]


class Searcher:
    """All windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [n for n, _ in items]
        self.texts = pa.array([t for _, t in items], pa.large_string())
        parts = list(words_of(self.texts, ALNUM))
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  #: of each item, among all words
        length = np.minimum(counts, window)
        self.searches = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            windows = counts[own] - m + 1
            owner = np.repeat(own, windows)
            first = self.begin[owner] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            self.searches.append(WuManber(m, h, first, owner))
        self._words: dict[int, list[bytes]] = {}

    def _window(self, first: int, m: int) -> list[bytes]:
        item = int(np.searchsorted(self.begin, first, side="right")) - 1
        if item not in self._words:
            if len(self._words) > 1000:
                self._words.clear()
            self._words[item] = alnum_words(self.texts[item].as_py().encode())
        at = first - int(self.begin[item])
        return self._words[item][at : at + m]

    def find(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Words of each text, the spans of hit words and the items that have a window there."""
        done = 0
        for h, _, counts in words_of(texts, ALNUM):
            ends = np.cumsum(counts)
            by_text: dict[int, list[tuple[int, int, WuManber]]] = {}
            for s in self.searches:
                first, window = s.find(h, counts)
                for text, a, w in zip(np.searchsorted(ends, first, side="right").tolist(), first.tolist(), window.tolist(), strict=True):
                    by_text.setdefault(text, []).append((a, w, s))
            for i, n in enumerate(counts.tolist()):
                spans, items = [], set()
                if i in by_text:
                    words, start = alnum_words(texts[done + i].as_py().encode()), int(ends[i]) - n
                    for a, w, s in by_text[i]:
                        if words[a - start : a - start + s.m] == self._window(int(s.first[w]), s.m):
                            spans.append((a - start, a - start + s.m))
                            items.update(s.owners[s.owned[w] : s.owned[w + 1]].tolist())
                yield n, spans, items
            done += len(counts)


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_built: dict[str, Searcher] = {}


def _searcher(token: str, held: Broadcast) -> Searcher:
    """The searcher of a broadcast, loaded once in a Python worker."""
    if token not in _built:
        _built.clear()
        _built[token] = held.value
    return _built[token]


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[str, Broadcast, int]]:
    """A token and the shipped searcher of each block, and how many blocks there are."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    ship(spark)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        # columns and not rows: rows as Python objects would take several times the block
        t = own.distinct().toArrow()
        searcher = Searcher(list(zip(t.column("name").to_pylist(), t.column("text").to_pylist(), strict=True)))
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(searcher), blocks


def _kept(df: DataFrame, token: str, held: Broadcast) -> DataFrame:
    """key, spans and items of the texts (key, text) with hits."""

    def rows(batch):
        search = _searcher(token, held)
        for key, (_, spans, items) in zip(batch.column(0).to_pylist(), search.find(batch.column(1)), strict=True):
            if spans:
                yield key, [x for s in spans for x in s], [search.names[i] for i in items]

    return map_arrow(df, rows, "key string, spans array<int>, items array<string>", lambda r: 8 * len(r[1]))


def _digest(text_col: str):
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def _by_digest(df: DataFrame, text_col: str, blocks: Iterable[tuple[str, Broadcast, int]]) -> DataFrame:
    """A row for each digest of a text with hits: what all blocks found."""
    keyed = df.select(_digest(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    each = []
    for token, held, _ in blocks:
        each.append(stage(_kept(keyed, token, held).groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
        held.unpersist()
    return reduce(DataFrame.unionByName, each).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def scan(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, spans (hit words, as flat start, end pairs) and items of every row."""
    blocks = _blocks(df.sparkSession, benchmark, block_bytes or BLOCK_BYTES)
    token, held, count = next(blocks)
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if count == 1:

        def rows(batch):
            search = _searcher(token, held)
            for key, (n, spans, items) in zip(batch.column(0).to_pylist(), search.find(batch.column(1)), strict=True):
                yield key, n, [x for s in spans for x in s], sorted({search.names[i] for i in items})

        return map_arrow(docs, rows, f"doc_id {kind}, n_words long, spans array<int>, items array<string>", lambda r: 8 * len(r[2]))

    def counted(batch):
        for key, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            yield key, digest, len(alnum_words(text))

    hits = stage(_by_digest(docs, "text", _chained((token, held, count), blocks)), "hits")
    sizes = map_arrow(docs.select("doc_id", _digest("text").alias("k"), "text"), counted, f"doc_id {kind}, k string, n_words long")
    joined = sizes.join(_small(hits), F.col("k") == F.col("key"), "left")
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    return joined.select(
        "doc_id", "n_words", F.coalesce("spans", none("int")).alias("spans"), F.coalesce(F.array_sort(F.array_distinct("items")), none("string")).alias("items")
    )


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _small(hits: DataFrame) -> DataFrame:
    """Shipped where its size, as counted, is bounded."""
    size = hits.agg(F.sum(100 + 4 * F.size("spans")) if "spans" in hits.columns else F.count("*") * 100).first()[0] or 0
    return F.broadcast(hits) if size <= BROADCAST_BYTES else hits


def report(found: DataFrame) -> DataFrame:
    def rows(batch):
        for key, n, spans, names in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            hit = covered(list(zip(spans[::2], spans[1::2], strict=True)))
            yield key, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(found, rows, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(df: DataFrame, benchmark: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` (needs text) without any hit word; all its columns.
    Each row is judged by its own text, however many blocks there are."""
    blocks = _blocks(df.sparkSession, benchmark, block_bytes or BLOCK_BYTES)
    token, held, count = next(blocks)
    if count > 1:
        hits = stage(_by_digest(df, "text", _chained((token, held, count), blocks)).select("key"), "hits")
        return df.join(_small(hits), _digest("text") == F.col("key"), "left_anti")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(token, held)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not spans for _, spans, _ in search.find(texts)], type=pa.bool_()))

    return df.mapInArrow(kept, df.schema)


def op3_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS m
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT pos.doc_id, pos.i, pos.m, win.item_id FROM pos JOIN win ON pos.g = win.g AND pos.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.names, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
