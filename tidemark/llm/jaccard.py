"""Similarity join of documents on n-gram sets by prefix trees.

Two documents link when num / den of the union of their sets is shared. The
steps, none of which loses a link:

1. n-grams that repeat inside a batch anywhere are summed over all batches; a
   fixed-size table of their counts gives the global order: seldom before often,
   long before short, then by hash (grams that share a slot count together).
2. Documents of equal sets become one node (key: 128 bits of the set). Of each
   node the order's first n - ceil(t n) + k grams are its prefix (k: 1, and one
   more for each EXTRA grams): two nodes that link share k grams of their
   prefixes (the smaller k), and their lengths are near. Nodes of near lengths
   that share a gram which at most MEET of them have are compared as pairs: by how
   many such grams they share and by outlines. A gram that more have joins them
   to the smallest one. Connected nodes are a *cell*, and links stay inside cells.
   Cells above CELL_GRAMS are cut anew the same way, in the order of the
   frequencies inside the cell.
3. A cell's sets go into a trie, ordered by frequency in the cell, often first,
   so that near copies share paths. A set traverses the trie level by level: a
   node adds its segment's overlap to its parent's, and subtrees are pruned when
   the lengths that remain cannot reach the threshold.
4. Only sets outside a cell's largest component traverse (and one inside it):
   any link between components has such an end, so components are exact and a
   group of thousands of near copies needs a few traversals, not all pairs.
   A cell that is still above CELL_GRAMS is cut into slices with a trie each,
   and rounds of such sets are sent to every slice of the cell.

Texts are never shuffled; what is: a row a prefix gram (a tenth of all at 0.9)
and the sets of nodes that are in a cell.

Cases: null texts, empty ones and those without words have no set, link with
nothing and are their own component; a text of fewer words than n is one gram;
a null id never is a component's smallest unless there is no other; equal rows
are one node; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

from ._common import documents, id_text, stage, trim
from ._words import M1, M2, SPACED, mix, words_of
from .graph import components

SLOTS = 1 << 24  #: of the table of frequent grams: a byte each, shipped whole (16 MB)
OFTEN = 2
OUTLINE = 64  #: parts of the grams, for bounds on how far sets are apart
CLASS = 1.5  #: ratio of the lengths of a class
EXTRA = 256  #: grams of a set for each gram more that prefixes must share: long sets share single grams by chance
MEET = 64  #: nodes with a gram that are compared as pairs; more are joined as a star
CELL_GRAMS = 1 << 22  #: of a trie; larger cells are cut into slices
PIVOTS = 256  #: sets of a cell that a round sends to its slices
BLOOM_WORDS = 1 << 20  #: 8 MB at most
BROADCAST_BYTES = 64 << 20  #: up to this size (64 bytes a row) nodes are shipped to the sets, beyond it joined by a shuffle


COUNTED = 2 << 20  #: grams that are looked at together for repeats


def _made(h: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Grams of k words in a row, from the words' hashes: eight bits for their
    length in bytes, 255 less it (so that long ones come first), and a hash of 56."""
    m = len(h) - k + 1
    out, total = h[:m].copy(), size[:m].copy()
    for j in range(1, k):
        out *= M1
        out += h[j : m + j]
        total += size[j : m + j]
    out = mix(out + np.uint64(k)) >> np.uint64(8)
    return out | (255 - np.minimum(total, 255)).astype(np.uint64) << np.uint64(56)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def all_grams(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Distinct n-grams of each text of a string column, ascending. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than n are one gram; null is empty."""
    for h, size, counts in words_of(texts, SPACED):
        made = _made(h, size, n) if len(h) >= n else np.zeros(0, np.uint64)
        first = 0
        for c in counts.tolist():
            yield _distinct(made[first : first + c - n + 1] if c >= n else _made(h[first : first + c], size[first : first + c], c) if c else made[:0])
            first += c


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(values).sum(dtype=np.uint64), mix(values ^ M2).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _map(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(trimmed, schema)


def often(docs: DataFrame, n: int) -> np.ndarray:
    """The table of grams that several texts of a batch share: counts of all batches, by slot."""

    def repeats(own: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        again = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[again].view(np.int64)), pa.array(counts[again].astype(np.int64))], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[np.ndarray] = []
            held = 0
            for values in all_grams(pc.unique(batch.column(1)), n):  # copies say nothing about how many texts share a gram
                own.append(values)
                held += len(values)
                if held >= COUNTED:
                    yield repeats(own)
                    own, held = [], 0
            if own:
                yield repeats(own)

    return _table(_map(docs, run, "gram long, n long"))


_shared: dict[str, object] = {}


def _value(token: str, held) -> object:
    if token not in _shared:
        if len(_shared) > 3:
            _shared.clear()
        _shared[token] = held.value
    return _shared[token]


def _first(values: np.ndarray, hot: np.ndarray, p: int) -> np.ndarray:
    """The first p of ascending grams in the order seldom before often, then as they are."""
    often_ = hot[(values & np.uint64(len(hot) - 1)).astype(np.int64)]
    seldom = values[often_ == 0]
    return seldom[:p] if len(seldom) >= p else values[np.argsort(often_, kind="stable")[:p]]


def _table(counted: DataFrame) -> np.ndarray:
    """A byte for each slot: log2 of what its grams count (column n), 0 below OFTEN."""
    by_slot = counted.groupBy(F.expr(f"cast(gram & {SLOTS - 1} AS int)").alias("slot")).agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    slots = by_slot.select("slot", F.floor(F.log2("n")).cast("byte").alias("c")).toArrow()  # SLOTS rows of five bytes at most
    out = np.zeros(SLOTS, np.uint8)
    out[slots.column("slot").to_numpy()] = slots.column("c").to_numpy()
    return out


def keyed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """place, doc_id, n_shingles, k1, k2 and prefix of every row, written. A place
    that ``docs`` has stays: row numbers hold only inside the job that gives them."""
    spark = docs.sparkSession
    held, token = spark.sparkContext.broadcast(often(docs, n)), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _value(token, held)
        for batch in batches:
            keys, sizes, prefixes, outlines = [], [], [], []
            seen = set()
            for values in all_grams(batch.column(1), n):
                m = len(values)
                keys.append(set_key(values))
                sizes.append(m)
                if not m or keys[-1] in seen:  # a copy in a batch needs no prefix of its own
                    prefixes.append(None)
                    outlines.append(None)
                    continue
                seen.add(keys[-1])
                prefixes.append(_first(values, hot, m - -(-num * m // den) + 1 + m // EXTRA).view(np.int64))
                outlines.append(np.minimum(np.bincount((values >> np.uint64(24)).astype(np.int64) % OUTLINE, minlength=OUTLINE), 32_000).astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2), batch.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    _lists(prefixes, np.int64), _lists(outlines, np.int16),
                ],
                names=["place", "doc_id", "n_shingles", "k1", "k2", "prefix", "outline"],
            )

    schema = f"place long, doc_id {kind}, n_shingles long, k1 long, k2 long, prefix array<long>, outline array<smallint>"
    own = F.col("place") if "place" in docs.columns else F.monotonically_increasing_id()
    out = stage(_map(docs.select("doc_id", "text", own.alias("place")), run, schema), "keyed")
    held.destroy()
    trim()
    return out


def _lists(values: list[np.ndarray | None], kind: type) -> pa.Array:
    """A list column of arrays; None is null."""
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
    full = [v for v in values if v is not None]
    mask = pa.array([v is None for v in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(full) if full else np.zeros(0, kind)), mask=mask)


class Trie:
    """Sets (ascending arrays of ranks) as a compressed prefix tree in arrays,
    with the lengths of each subtree's sets."""

    def __init__(self, sets: list[np.ndarray], ranks: int):
        self.sets, self.ranks = sets, ranks
        self.inside = np.zeros(ranks, np.int8)  # marks the query's grams while it traverses
        encoded = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=encoded.__getitem__)
        depth, parent, start, leaf = [0], [-1], [0], [-1]  # start: where the segment begins in a set of the subtree
        owner = [order[0] if order else 0]
        stack = [0]
        before = None
        for i in order:
            s = sets[i]
            common = 0
            if before is not None:
                k = min(len(s), len(before))
                differs = np.flatnonzero(s[:k] != before[:k])
                common = int(differs[0]) if len(differs) else k
            child = -1
            while depth[stack[-1]] > common:
                child = stack.pop()
            top = stack[-1]
            if child >= 0 and depth[top] < common:  # the edge to child is cut at ``common``
                depth.append(common)
                parent.append(top)
                start.append(depth[top])
                leaf.append(-1)
                owner.append(owner[child])
                top = len(depth) - 1
                parent[child], start[child] = top, common
                stack.append(top)
            depth.append(len(s))
            parent.append(top)
            start.append(depth[top])
            leaf.append(i)
            owner.append(i)
            stack.append(len(depth) - 1)
            before = s
        self.depth, self.parent, self.leaf = np.array(depth), np.array(parent), np.array(leaf)
        self._segments(start, owner)

    def _segments(self, start: list[int], owner: list[int]) -> None:
        n = len(self.depth)
        length = self.depth - np.array(start)
        self.offset = np.concatenate([[0], np.cumsum(length)])
        self.tokens = np.concatenate([self.sets[o][a:d] for o, a, d in zip(owner, start, self.depth, strict=True)]) if n > 1 else np.zeros(0, np.int64)
        self.last = np.full(n, -1)  # the greatest rank on the path
        full = length > 0
        self.last[full] = self.tokens[self.offset[1:][full] - 1]
        # children of each node, together; least and greatest length of the sets below
        self.least, self.most = np.where(self.leaf >= 0, self.depth, 1 << 60), np.where(self.leaf >= 0, self.depth, -1)
        level = np.zeros(n, np.int64)
        kids: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            kids[self.parent[v]].append(v)
        todo = [0]
        walk = []
        while todo:
            v = todo.pop()
            walk.append(v)
            for c in kids[v]:
                level[c] = level[v] + 1
                if not length[c]:
                    self.last[c] = self.last[v]
                todo.append(c)
        for v in reversed(walk[1:]):
            p = self.parent[v]
            self.least[p], self.most[p] = min(self.least[p], self.least[v]), max(self.most[p], self.most[v])
        self.kid_offset = np.concatenate([[0], np.cumsum([len(k) for k in kids])])
        self.kids = np.array([c for k in kids for c in k], np.int64)

    def linked(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which sets link with ``query``, an ascending array of ranks (those at
        ``ranks`` or above are in no set here)."""
        inside, mine = self.inside, query[query < self.ranks]
        inside[mine] = 1
        n = len(query)
        found = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            at, end = self.kid_offset[nodes], self.kid_offset[nodes + 1]
            count = end - at
            kids = self.kids[np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())]
            have = np.repeat(overlap, count)
            if not len(kids):
                break
            a, b = self.offset[kids], self.offset[kids + 1]
            size = b - a
            pick = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            got = np.concatenate([[0], np.cumsum(inside[self.tokens[pick]], dtype=np.int64)])
            ends = np.cumsum(size)
            have = have + got[ends] - got[ends - size]
            depth, last = self.depth[kids], self.last[kids]
            rest = n - np.searchsorted(query, last, side="right")  # of the query, beyond the path
            # the length below at which the bound on the overlap is best against what it must reach
            best = np.clip(depth + rest, self.least[kids], self.most[kids])
            fits = (den + num) * (have + np.minimum(rest, best - depth)) >= num * (n + best)
            kids, have = kids[fits], have[fits]
            done = self.leaf[kids] >= 0
            ok = done & ((den + num) * have >= num * (n + self.depth[kids]))
            found.append(self.leaf[kids[ok]])
            nodes, overlap = kids, have  # a set may begin another one
        inside[mine] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class _Union:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets in their common order (often first): as ascending ranks; the
    rank of each gram, grams ascending; how many sets have the gram of each rank."""
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    return [np.sort(rank[own]) for own in np.split(place, ends[:-1])], rank, counts[order]


def cell_components(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """The component of each set, as the place of one of its members: exact
    (step 4 of the module)."""
    union, near = _Union(len(sets)), _Union(len(sets))
    own, _, counts = ranked(sets)
    first: dict[int, int] = {}
    for i, s in enumerate(own):  # what is seldom in the cell comes last in a set: its prefix for links
        for g in s[-(len(s) - -(-num * len(s) // den) + 1) :]:
            if counts[g] > 1:
                near.join(first.setdefault(int(g), i), i)
    groups: dict[int, list[int]] = {}
    for i in range(len(sets)):
        groups.setdefault(near.find(i), []).append(i)
    for group in groups.values():
        if len(group) > 1:
            _traverse(group, own, counts, union, num, den)
    return [union.find(i) for i in range(len(sets))]


def _traverse(group: list[int], own: list[np.ndarray], counts: np.ndarray, union: _Union, num: int, den: int) -> None:
    """Join what links in a group of sets, as far as components need it."""
    trie = Trie([own[i] for i in group], len(counts))
    todo, largest = sorted(group, key=lambda i: -counts[own[i]].mean()), None
    while todo:  # ends when all that have not traversed are in one component
        rest = []
        for i in todo:
            if largest is not None and union.find(i) == union.find(largest):
                rest.append(i)
                continue
            for j in trie.linked(own[i], num, den):
                union.join(i, group[j])
            if largest is None or union.size[union.find(i)] > union.size[union.find(largest)]:
                largest = i
        todo = [i for i in rest if union.find(i) != union.find(largest)]


def _sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """k1, k2 and grams of the rows whose set may be in ``wanted`` (k1, node): a Bloom
    filter of bounded size passes over most others; a batch gives a set once. Rows
    that have a place are passed over by it, unread: a node is the place of a row."""
    spark = docs.sparkSession
    by_place = "place" in docs.columns
    rows = docs.select("doc_id", "text", F.xxhash64("place").alias("h")) if by_place else docs
    # two bits a key, from halves that are independent
    spots = wanted.select((F.xxhash64("node") if by_place else F.col("k1")).alias("h")).select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 29))).alias("h"))
    words = spots.groupBy(F.pmod(F.shiftrightunsigned("h", 6), F.lit(BLOOM_WORDS)).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits")
    ).toArrow()
    bloom = np.zeros(BLOOM_WORDS, np.int64)
    bloom[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    del words
    trim()
    held, token = spark.sparkContext.broadcast(bloom), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _value(token, held).view(np.uint64)
        for batch in batches:
            if by_place:
                h = batch.column(2).to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(may(bits, h) & may(bits, h >> np.uint64(29))))
            seen: set[tuple[int, int]] = set()
            out: list[tuple[tuple[int, int], np.ndarray]] = []
            held_grams = 0
            for values in all_grams(batch.column(1), n):
                if not len(values):
                    continue
                k = set_key(values)
                if k in seen:
                    continue
                seen.add(k)
                h = k[0] & 0xFFFFFFFFFFFFFFFF
                if by_place or all(int(bits[(x >> 6) % BLOOM_WORDS]) >> (x & 63) & 1 for x in (h, h >> 29)):
                    out.append((k, values.view(np.int64)))
                    held_grams += len(values)
                if held_grams > 1 << 19:
                    yield told(out)
                    out, held_grams = [], 0
            if out:
                yield told(out)

    def may(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (bits[((h >> np.uint64(6)) % np.uint64(BLOOM_WORDS)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)

    def told(out: list[tuple[tuple[int, int], np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), _lists([v for _, v in out], np.int64)], names=["k1", "k2", "grams"]
        )

    return _map(rows, run, "k1 long, k2 long, grams array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns: the rest, with
    lists as arrays. A row that repeats the one before it, lists aside, is left out."""
    now, held, before = None, [], None
    for batch in batches:
        cols = [c.to_pylist() if not pa.types.is_list(c.type) else None for c in batch.columns]
        arrays = {i: (c.offsets.to_numpy(), c.values.to_numpy()) for i, c in enumerate(batch.columns) if pa.types.is_list(c.type)}
        for r in range(batch.num_rows):
            key, plain = tuple(cols[i][r] for i in range(keys)), tuple(c[r] for c in cols if c is not None)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            elif plain == before:
                continue
            before = plain
            held.append(tuple(arrays[i][1][arrays[i][0][r] : arrays[i][0][r + 1]].view(np.uint64).copy() if i in arrays else cols[i][r] for i in range(keys, len(cols))))
    if held:
        yield now, held


def _met(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """a, k, gram and b of the prefix grams that two nodes or more have in one
    class: a node is in the class of its length (powers of CLASS) and in those of the
    greater lengths that it can link with. b: the smallest node with the gram, null if
    at most MEET have it. Most grams are of one node alone; they are read once and left here."""
    of = lambda c: F.floor(F.log(c) / F.log(F.lit(CLASS)))
    longest = F.floor(F.col("n_shingles") * den / num)
    spots = F.explode(F.sequence(of(F.col("n_shingles")), of(longest)))
    # k: grams that must be shared; negative in a class that is not the node's own
    k = F.expr(f"cast(1 + n_shingles div {EXTRA} AS int)")
    tokens = prefixes.select("a", "n_shingles", "prefix", spots.alias("c")).select("a", "c", F.when(F.col("c") == of(F.col("n_shingles")), k).otherwise(-k).alias("k"), F.explode("prefix").alias("g"))
    tokens = tokens.select("a", "k", F.xxhash64("g", "c").alias("gram"))
    tokens = tokens.where("a IS NOT NULL AND gram IS NOT NULL")  # as a join would add below the exchange, which then could not serve all
    tokens = tokens.repartition(_parts(prefixes), "gram")  # one exchange for both
    met = tokens.groupBy("gram").agg(F.min("a").alias("b"), F.max("a").alias("top"), F.count("*").alias("c"), F.max("k").alias("k")).where("b < top AND k > 0")
    met = met.select("gram", F.when(F.col("c") > MEET, F.col("b")).alias("b"))
    return stage(tokens.join(met.hint("shuffle_hash"), "gram"), "met")  # no sort of all grams


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cells(prefixes: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(k1, cell) of the nodes that share prefix grams with a node of a
    length that could link. Nodes go by half of
    their key here; two that had the same half would only be in one cell. An outline
    has how many grams of a set are in each of OUTLINE parts of all grams: two sets
    differ in at least as many grams as their outlines do."""
    met = _met(prefixes, num, den)
    # a linked pair shares k grams. If more than MEET nodes have one of these, it joins the pair; else all k are
    # counted here, each once: in the class of the longer set, the only one that both are in and one has for its own
    few = met.where("b IS NULL").repartition(_parts(met), "gram").groupBy("gram").agg(F.collect_set(F.struct("a", "k")).alias("own"))
    both = few.select("own", F.posexplode("own").alias("i", "x")).where("i > 0").select("x", F.explode(F.expr("slice(own, 1, i)")).alias("y")).where("(x.k > 0 OR y.k > 0) AND x.a != y.a")
    pairs = both.select(F.greatest("x.a", "y.a").alias("a"), F.least("x.a", "y.a").alias("b"), F.least(F.abs("x.k"), F.abs("y.k")).alias("k"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("k").alias("k")).where("c >= k").select("a", "b")
    own = lambda x: nodes.select(F.col("k1").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("outline").alias(f"o_{x}"))
    pairs = pairs.join(own("a"), "a").join(own("b"), "b")
    apart = F.aggregate(F.zip_with("o_a", "o_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
    most = F.floor((F.col("n_a") + F.col("n_b")) * (den - num) / (den + num))
    stars = met.where("a != b").select("a", "b").distinct()
    links = stars.unionByName(pairs.where(apart <= most).select("a", "b"))
    return stage(components(links, "cell"), "cells").withColumnRenamed("node", "k1")


def _placed(nodes: DataFrame, cell_grams: int) -> DataFrame:
    """Nodes with the slices of their cell and their own."""
    sums = nodes.groupBy("cell").agg(F.sum("n_shingles").alias("total"))
    slices = F.ceil(F.col("total") / F.lit(cell_grams)).cast("long")
    return stage(nodes.join(sums.select("cell", slices.alias("slices")), "cell").withColumn("slice", F.pmod(F.xxhash64("node"), "slices")), "placed")


def _seldom(inside: DataFrame, num: int, den: int) -> DataFrame:
    """a, n_shingles and prefix of the nodes ``inside`` large cells (a set that
    comes more than once counts more than once, which only moves the order), by an order that puts grams first which only one of them has."""
    spark = inside.sparkSession
    each = inside.select(F.explode("grams").alias("gram"))
    table = _table(each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    held, token = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _value(token, held)
        for batch in batches:
            c = batch.column(2)
            ends, flat = c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)
            prefixes = []
            for i in range(batch.num_rows):
                values = flat[ends[i] : ends[i + 1]]
                prefixes.append(_first(values, hot, len(values) - -(-num * len(values) // den) + 1 + len(values) // EXTRA).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))],
                names=["a", "n_shingles", "prefix"],
            )

    return _map(inside, run, "a long, n_shingles long, prefix array<long>")


def nodes_and_components(docs: DataFrame, n: int, num: int, den: int, cell_grams: int = CELL_GRAMS, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and (k1, k2, component) of every node; a node is the place
    of its first row, its component the smallest node that it reaches."""
    rows = keyed(docs, n, num, den)
    nodes = stage(
        rows.where("n_shingles > 0").groupBy("k1", "k2")
        .agg(F.min("place").alias("node"), F.max("n_shingles").alias("n_shingles"), F.first("outline", ignorenulls=True).alias("outline")),
        "nodes",
    )
    cells = _cells(rows.where("prefix IS NOT NULL").select(F.col("k1").alias("a"), "n_shingles", "prefix"), nodes, num, den)
    placed = _placed(cells.join(nodes.drop("outline"), "k1"), cell_grams)
    broad = placed.where("slices > 1").drop("cell", "slices", "slice")
    if broad.limit(1).count():
        # large cells are cut anew by the frequencies of their own grams; nodes that meet no other leave
        inside = stage(_joined(_sets(docs, n, broad), broad), "inside").select(F.col("k1").alias("a"), "n_shingles", "grams")
        finer = _cells(_seldom(inside, num, den), nodes, num, den)
        placed = stage(placed.where("slices = 1").unionByName(_placed(finer.join(broad, "k1"), cell_grams).select(placed.columns)), "placed")
    members = _joined(_sets(docs, n, placed), placed).select("cell", "slice", "node", "slices", "grams")
    large = placed.where("slices > 1").limit(1).count() > 0
    if large:
        members = stage(members, "members")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, held in _grouped(batches, 1):
            once = list({node: g for node, g in held}.items())
            top = cell_components([g for _, g in once], num, den)
            for (node, _), t in zip(once, top, strict=True):
                a.append(node)
                b.append(once[t][0])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.where("slices = 1").select("cell", "node", "grams").repartition(parts, "cell").sortWithinPartitions("cell", "node")
    joined = stage(_map(dealt, small, "a long, b long"), "joined")
    # in a cell of one slice, all of a component point to one member
    low = joined.groupBy("b").agg(F.min("a").alias("component"))
    told = joined.join(low, "b").select(F.col("a").alias("node"), "component")
    if large:
        told = told.unionByName(_large(members.where("slices > 1"), placed.where("slices > 1"), num, den, pivots))
    out = nodes.join(told, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    return rows, out


def _joined(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets with what ``nodes`` says of their key."""
    small = nodes.count() * 64 <= BROADCAST_BYTES
    return sets.join(F.broadcast(nodes) if small else nodes, ["k1", "k2"])


def _large(members: DataFrame, placed: DataFrame, num: int, den: int, pivots: int) -> DataFrame:
    """Components inside cells of several slices, in rounds: sets outside the
    largest component of their cell that have not traversed are sent to all
    slices, ``pivots`` a cell at a time."""
    spark = members.sparkSession
    nodes = placed.select("cell", "node", "slices")
    labels = nodes.select("node", F.col("node").alias("component"))
    done = spark.createDataFrame([], "node long")
    links = spark.createDataFrame([], "a long, b long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, 2):
            own = list({node: g for sent, node, g in held if not sent}.items())
            sent = list({node: g for sent, node, g in held if sent}.items())
            a, b = [], []
            if own and sent:
                sets, rank, _ = ranked([g for _, g in own])
                values = np.unique(np.concatenate([g for _, g in own]))
                trie = Trie(sets, len(rank))
                for node, g in sent:
                    at = np.minimum(np.searchsorted(values, g), len(values) - 1)
                    here = np.where(values[at] == g, rank[at], len(rank))
                    for j in trie.linked(np.sort(here), num, den):
                        if own[j][0] != node:
                            a.append(node)
                            b.append(own[j][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    while True:
        sized = nodes.join(labels, "node").groupBy("cell", "component").agg(F.count("*").alias("n"))
        largest = sized.groupBy("cell").agg(F.max(F.struct("n", F.negative("component").alias("c"))).alias("x")).select("cell", F.negative("x.c").alias("largest"))
        # a largest component of one member is no more than a set that has not traversed
        outside = nodes.join(labels, "node").join(largest, "cell").join(done, "node", "left_anti").where("component != largest OR component = node AND largest = node")
        turn = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
        chosen = stage(outside.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= pivots).select("cell", "node", "slices"), "pivots")
        if not chosen.limit(1).count():
            return labels
        sets = members.join(chosen.select("node"), "node", "left_semi")
        sent = sets.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("sent", F.lit(True))
        both = sent.select("cell", "slice", "sent", "node", "grams").unionByName(members.select("cell", "slice", F.lit(False).alias("sent"), "node", "grams"))
        found = _map(both.repartition(parts, "cell", "slice").sortWithinPartitions("cell", "slice", "sent", "node"), probe, "a long, b long")
        links = stage(links.unionByName(found), "found")
        done = stage(done.unionByName(chosen.select("node")), "done")
        joined = components(links)
        labels = stage(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, **limits) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id of the component) of every row."""
    docs = id_text(df, id_col, text_col)
    rows, nodes = nodes_and_components(docs, n, num, den, **limits)
    own = rows.select("doc_id", "n_shingles", "k1", "k2")
    least = own.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id")).join(nodes, ["k1", "k2"])
    ids = least.groupBy("component").agg(F.min("id").alias("component_id"))
    by_key = nodes.join(ids, "component").select("k1", "k2", "component_id")
    return own.where("n_shingles > 0").join(by_key, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id").unionByName(
        own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **limits) -> DataFrame:
    """The rows of ``docs`` (needs doc_id and text) of which each component keeps
    the one of the smallest id, with all their columns. Rows without words all
    stay. Rows are numbered once and written with their number: another scan of
    ``docs`` may deal its files to other partitions."""
    place = "k_place"
    while place in docs.columns:
        place += "_"
    marked = stage(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    rows, nodes = nodes_and_components(marked.select("doc_id", F.col("text").cast("string").alias("text"), F.col(place).alias("place")), n, num, den, **limits)
    own = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("x"))
    kept = own.join(nodes.select("k1", "k2", "component"), ["k1", "k2"]).groupBy("component").agg(F.min("x").alias("x")).select(F.col("x.place").alias(place))
    kept = stage(kept, "kept")
    gone = stage(rows.where("n_shingles > 0").select(F.col("place").alias(place)).join(kept, place, "left_anti"), "gone")
    small = gone.count() * 16 <= BROADCAST_BYTES
    return marked.join(F.broadcast(gone) if small else gone, place, "left_anti").select(*docs.columns)


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 100 * o >= 90 * (na.n + nb.n - o)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
