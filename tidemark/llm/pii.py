"""Personal data by patterns and a skip-chain conditional random field.

Patterns find email, ip, card and phone spans. The field labels the *marked*
tokens of a document: those with a digit or an at sign, capitalised ones after a
word that introduces a name (and the same ones elsewhere in the document), and what
stands between a number and a street word. All other tokens are held at the label
"other". Labels are the four kinds of the patterns, which the field also finds in
forms that these do not match, and secret, name and address.

Its factors: token features, adjacent marked tokens, and skip edges from each
marked token to the next one that is equal or similar (same letters and digits,
same digits, same name before the at sign). Loopy sum-product message passing over
a document's graph makes repeats agree; spans that it adds never replace or overlap
those of the patterns.

Training maximises the pseudo-likelihood of all factors together on *made*
documents: words of at most SAMPLE_DOCS documents (without their marked tokens) into
which entities of known labels, repeats of them and look-alikes that are none
(versions, dates, counts, checksums, numbers that fail Luhn) are put by a seeded
generator. So the labels do not come from the patterns. Everything else runs in
place over whole texts, with no shuffle; edges are linear in the marked tokens.

Cases: null and empty texts have no spans; offsets are code points of the text
as it is; repeated rows give repeated results; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, map_arrow

BASE = ("email", "ip", "card", "phone")  #: what the patterns find
KINDS = (*BASE, "secret", "name", "address")
LABELS = ("other", *KINDS)
EMAIL, IP, CARD, PHONE, SECRET, NAME, ADDRESS = range(1, len(LABELS))
SAMPLE_DOCS = 600
DRAWN = 20_000  #: documents that the sample is drawn from, so that few reach the driver
SAMPLE_CHARS = 50_000  #: longer documents are not drawn
MADE_WORDS = 60  #: words of a made document, besides its entities
MAX_FEATURES = 1024
MIN_BELIEF = 0.9  #: of a label, for a span that the field adds
SEED = 11

#: Words that introduce a name, and words that end a street.
NAME_CUES = ("name", "Name", "Mr", "Mrs", "Ms", "Dr", "Dear", "contact", "Contact", "signed", "Signed", "regards", "Regards")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Boulevard", "Blvd", "Drive", "Square")
#: Words that introduce a secret, and those that introduce a checksum (for made documents).
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "access_token", "auth", "bearer", "pwd", "client_secret")
PLAIN_CUES = ("commit", "sha1", "checksum", "digest", "revision", "build", "etag", "md5")

_CUE = re.compile(r"\b(?:" + "|".join(NAME_CUES) + r")\b[.:,]?[ \t]+(?:is[ \t]+)?")
_CAPITAL = re.compile(r"[A-Z][a-z'-]*[a-z][.,;:!?]*\Z")
_STREET = re.compile(r"\b[0-9]+[A-Za-z]?[ \t]+((?:[A-Z][a-z]+[ \t]+){1,3}(?:" + "|".join(STREETS) + r")\b)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can begin inside a run of digits only where it could begin at its start
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_GAP = re.compile(r"[\x20\x09-\x0D]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end), sorted."""
    if not _MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _token_at(text: str, at: int) -> tuple[int, int]:
    start = at
    while start > 0 and text[start - 1] not in " \t\n\v\f\r":
        start -= 1
    stop = _SPACE.search(text, at)
    return start, stop.start() if stop else len(text)


def _names(text: str) -> set[tuple[int, int]]:
    """One or two capitalised tokens after a cue, and the same ones elsewhere."""
    if not any(c in text for c in NAME_CUES):
        return set()
    out: set[tuple[int, int]] = set()
    bare = set()
    for m in _CUE.finditer(text):
        at = m.end()
        for _ in range(2):
            if at >= len(text) or text[at] in " \t\n\v\f\r":
                break
            a, b = _token_at(text, at)
            if a < m.end() or not _CAPITAL.match(text[a:b]):
                break
            out.add((a, b))
            bare.add(text[a:b].rstrip(".,;:!?"))
            if text[b - 1] in ".,;:!?" or not (gap := re.compile(r"[ \t]+").match(text, b)):
                break
            at = gap.end()
    if bare:
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(bare))) + r")\b", text):
            a, b = _token_at(text, m.start())
            if _CAPITAL.match(text[a:b]):
                out.add((a, b))
    return out


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of every marked token (tokens have no spaces in them), in order."""
    out: set[tuple[int, int]] = set()
    end = 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1] in " \t\n\v\f\r":
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.add((start, end))
        m = _MARK.search(text, end)
    if out and any(w in text for w in STREETS):
        for m in _STREET.finditer(text):
            at = m.start(1)
            while at < m.end():
                a, b = _token_at(text, at)
                out.add((a, b))
                gap = _SPACES.match(text, b)
                at = gap.end()
                if at == b:
                    break
    return sorted(out | _names(text))


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))[:16]


def _bucket(n: int) -> int:
    return n if n < 5 else 5 + int(math.log2(n / 5) * 2)


_HEX = re.compile(r"[0-9A-Fa-f]+\Z")
_EDGE = re.compile(r"^[\W_]+|[\W_]+\Z")
_SPACES = re.compile(r"[\x20\x09-\x0D]*")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}\Z")


def _before(text: str, at: int, reach: int = 40) -> list[str]:
    """The two tokens that end before ``at``, the nearer first."""
    near = text[max(0, at - reach) : at].split()[-2:]
    return [(_EDGE.sub("", w).lower() or w[:2]) for w in reversed(near)]


def features(text: str, tokens: list[tuple[int, int]], i: int) -> list[str]:
    a, b = tokens[i]
    t = text[a:b]
    core = _EDGE.sub("", t)
    digits = sum(c.isdigit() for c in t)
    letters = sum(c.isalpha() for c in t)
    out = ["bias", f"shape={_shape(t)}", f"core={_shape(core)}", f"digits={_bucket(digits)}", f"letters={_bucket(letters)}", f"both={digits > 0}{letters > 0}"]
    out += [f"has={c}" for c in "@.+-()=%/:\"'$#" if c in t]
    out.append(f"start={_shape(t[0])}")
    if len(core) >= 12 and _HEX.match(core) and letters:
        out.append(f"hex={_bucket(len(core))}")
    if digits >= 14 and digits <= 19 and letters == 0:
        out.append(f"luhn={luhn(re.sub(r'[^0-9]', '', t))}")
    if _QUAD.match(core):
        out.append(f"quad={all(len(p.lstrip('0')) <= 3 and int(p.lstrip('0') or 0) <= 255 for p in core.split('.'))}")
    if not digits and core in STREETS:
        out.append("street")
    words = _before(text, a)
    out += [f"before{k}={w}" for k, w in enumerate(words)]
    if any(w in _INTRODUCES for w in words):
        out.append("introduced")
    for inside in re.split(r"[=:]", t)[:-1]:
        if _EDGE.sub("", inside).lower() in _INTRODUCES:
            out.append("introduced")
    for step in (-1, 1):
        near = i + step
        beside = 0 <= near < len(tokens) and adjacent(text, tokens, min(i, near))
        out.append(f"beside{step}={_shape(text[slice(*tokens[near])]) if beside else 'other'}")
    return list(dict.fromkeys(out))


_INTRODUCES = frozenset(SECRET_CUES)


def adjacent(text: str, tokens: list[tuple[int, int]], i: int) -> bool:
    """Is nothing but space between tokens i and i + 1?"""
    a, b = tokens[i][1], tokens[i + 1][0]
    return b - a <= 4 and bool(_GAP.match(text[a:b]))


def keys(token: str) -> list[str]:
    """What makes two tokens similar."""
    bare = re.sub(r"[\W_]+", "", token).lower()
    digits = re.sub(r"[^0-9]+", "", token)
    out = [f"t{bare}"] if bare else []
    if len(digits) >= 7:
        out.append(f"d{digits}")
    if "@" in token:
        out.append(f"n{token.partition('@')[0].lower()}")
    return out


def skips(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From each token to the next one with a key of its own."""
    last: dict[str, int] = {}
    out = set()
    for i, (a, b) in enumerate(tokens):
        for k in keys(text[a:b]):
            if k in last and not (last[k] == i - 1 and adjacent(text, tokens, i - 1)):  # neighbours have an edge already
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


class Maker:
    """Documents with entities of known labels."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def _hex(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789abcdef") for _ in range(n))

    def _word(self) -> str:
        return "".join(self.rng.choice(("ba", "ler", "min", "to", "ra", "ken", "so", "vi", "del", "an")) for _ in range(self.rng.randint(1, 3)))

    def _card(self, valid: bool) -> str:
        n = self.rng.choice((15, 16, 16, 16, 19))
        d = [str(self.rng.randrange(10)) for _ in range(n - 1)]
        right = next(c for c in "0123456789" if luhn("".join(d) + c))
        d.append(right if valid else str((int(right) + self.rng.randint(1, 9)) % 10))
        return "".join(d) if n != 16 or self.rng.random() < 0.6 else self.rng.choice((" ", "-")).join("".join(d[i : i + 4]) for i in range(0, 16, 4))

    def entity(self) -> tuple[str, list[tuple[str, int]], str]:
        """(words before it, its tokens with labels, a shorter mention or the same again)."""
        r = self.rng
        kind = r.choice((EMAIL, IP, CARD, PHONE, SECRET, SECRET, NAME, NAME, ADDRESS))
        if kind == EMAIL:
            name = f"{self._word()}{r.choice(('', '.', '_'))}{r.randrange(100)}"
            whole = f"{name}@{self._word()}{r.randrange(10)}.{r.choice(('example.com', 'org', 'net', 'co.uk'))}"
            return "", [(whole, EMAIL)], r.choice((whole, f"{name}@{self._word()}"))
        if kind == IP:
            v = ".".join(str(r.randrange(256)) for _ in range(4))
            return "", [(v, IP)], v
        if kind == CARD:
            v = self._card(True)
            return "", [(x, CARD) for x in v.split(" ")], v
        if kind == PHONE:
            area, rest = f"({r.randrange(1000):03d})", f"{r.choice(('555', str(r.randint(200, 999))))}-{r.randrange(10_000):04d}"
            lead = [f"+{r.randint(1, 99)}"] if r.random() < 0.7 else []
            return "", [(x, PHONE) for x in (*lead, area, rest)], f"{area} {rest}"
        if kind == SECRET:
            v = r.choice((self._hex(40), self._hex(32), self._hex(64), "".join(r.choice("ABCDEFGHKLMNPQRSTabcdefghkmnpqrst23456789") for _ in range(r.randint(16, 40)))))
            cue = r.choice(SECRET_CUES)
            cue = cue if r.random() < 0.6 else cue.upper()
            quoted = r.choice((f'"{v}"', v, f"'{v}'"))
            if r.random() < 0.25:
                return "", [(f"{cue}={quoted}", SECRET)], v
            return f"{cue} {r.choice(('=', ':', 'is', '=>'))} ", [(quoted, SECRET)], v
        if kind == NAME:
            first, last = self._word().capitalize() + "n", self._word().capitalize() + "s"
            cue = r.choice(("my name is", "Name:", "Mr.", "Mrs.", "Ms.", "Dr.", "Dear", "contact", "signed", "regards"))
            return f"{cue} ", [(first, NAME), (last, NAME)], r.choice((first, last))
        number = f"{r.randint(1, 999)}{r.choice(('', '', 'B'))}"
        return "", [(number, ADDRESS), (self._word().capitalize() + "n", ADDRESS), (r.choice(STREETS), ADDRESS)], ""

    def other(self) -> str:
        """What looks like personal data and is none."""
        r = self.rng
        return r.choice((
            lambda: f"{r.randint(0, 12)}.{r.randint(0, 20)}.", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}", lambda: str(r.randint(1900, 2030)),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: self._card(False), lambda: self._card(False), lambda: f"{r.randint(1, 999)},{r.randrange(1000):03d}",
            lambda: f"{r.randint(256, 999)}.{r.randrange(999)}.{r.randrange(999)}.{r.randrange(999)}", lambda: f"#{r.randrange(10**6)}", lambda: f"{r.choice(PLAIN_CUES)} {self._hex(r.choice((32, 40)))}",
            lambda: f"{r.choice(PLAIN_CUES)}: {self._hex(r.choice((8, 32, 40, 64)))}", lambda: f"{r.randrange(24)}:{r.randrange(60):02d}", lambda: f"${r.randrange(1000)}.{r.randrange(100):02d}", lambda: f"{r.randrange(100)}%",
            lambda: f"{r.randint(1, 999)}", lambda: f"({r.randint(1, 99)})", lambda: f"{r.randint(1, 9)}", lambda: f"@{self._word()}", lambda: f"{self._word()}{r.randrange(100)}", lambda: f"{r.randrange(10)}-{r.randrange(10)}",
            lambda: f"name {self._word()}", lambda: f"contact {self._word()} {self._word()}", lambda: f"{r.choice(SECRET_CUES)} {r.choice(('of', 'in', 'for'))} {r.randint(1, 99)}", lambda: f"{r.choice(SECRET_CUES)} = {r.randint(1, 99)}",
        ))()

    def document(self, words: list[str]) -> tuple[str, list[tuple[int, int, int]]]:
        """Text, and (start, label, end) of the tokens of its entities."""
        r = self.rng
        pieces: list[list[tuple[str, int]]] = [[(w, 0)] for w in words]
        for _ in range(r.randint(0, 4)):
            lead, tokens, again = self.entity()
            label = tokens[0][1]
            noise = r.choice(("", "", "", "", ",", ".", "!!", "###"))
            mentions = [[(w, 0) for w in lead.split()] + tokens[:-1] + [(tokens[-1][0] + noise, label)]]
            if again:
                mentions += [[(w, label) for w in again.split(" ")] for _ in range(r.choice((0, 0, 1, 2)))]
            at = sorted(r.randint(0, len(pieces)) for _ in mentions)
            for k, m in reversed(list(zip(at, mentions, strict=True))):
                pieces.insert(k, m)
        for _ in range(r.randint(0, 4)):
            pieces.insert(r.randint(0, len(pieces)), [(w, 0) for w in self.other().split()])
        out, spans, at = [], [], 0
        for w, label in (x for p in pieces for x in p):
            if label:
                spans.append((at, label, at + len(w)))
            out.append(w)
            at += len(w) + 1
        return " ".join(out), spans


def made(texts: list[str], n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` made documents, with words of ``texts`` around the entities."""
    maker = Maker(seed)
    carriers = []
    for text in texts:
        own = [w for w in text[:4000].split() if not _MARK.search(w) and w.strip(".,;:!?") not in (*NAME_CUES, *STREETS)][:MADE_WORDS]
        if own:
            carriers.append(own)
    carriers = carriers or [["lorem", "ipsum", "dolor", "sit", "amet"] * 4]
    return [maker.document(carriers[i % len(carriers)]) for i in range(n)]


MADE = 1500  #: made documents of a training


@dataclass
class Field:
    """The weights: of features, of neighbours, of skip edges (all log scale)."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LABELS))))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS),) * 2))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS),) * 2))

    @classmethod
    def train(cls, examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 150) -> Field:
        """``examples``: texts with (start, label, end) of the tokens of their entities."""
        rows: list[list[str]] = []
        gold: list[int] = []
        chain: list[tuple[int, int]] = []
        skip: list[tuple[int, int]] = []
        for text, spans in examples:
            tokens = marked_tokens(text)
            at = len(gold)
            gold += token_labels(tokens, [(a, label - 1, b) for a, label, b in spans])
            rows += [features(text, tokens, i) for i in range(len(tokens))]
            chain += [(at + i, at + i + 1) for i in range(len(tokens) - 1) if adjacent(text, tokens, i)]
            skip += [(at + i, at + j) for i, j in skips(text, tokens)]
        out = cls()
        if not rows:
            return out
        names = [f for f, _ in sorted(Counter(f for r in rows for f in r).items(), key=lambda x: (-x[1], x[0]))[:MAX_FEATURES]]
        out.index = {f: i for i, f in enumerate(names)}
        n, k = len(rows), len(LABELS)
        x = np.zeros((n, len(names)), np.float32)
        for i, r in enumerate(rows):
            x[i, [out.index[f] for f in r if f in out.index]] = 1
        y = np.eye(k, dtype=np.float32)[gold]
        a, b = (np.array(e, np.int64).reshape(-1, 2).T for e in (chain, skip))
        w, c, s = np.zeros((len(names), k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
        pace = [np.full_like(p, 1e-8) for p in (w, c, s)]
        for _ in range(steps):
            logits = x @ w
            for (i, j), table in ((a, c), (b, s)):
                np.add.at(logits, i, y[j] @ table.T)  # the label of the one, given that of the other
                np.add.at(logits, j, y[i] @ table)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - y) / n
            gc = off[a[0]].T @ y[a[1]] + y[a[0]].T @ off[a[1]]
            gs = off[b[0]].T @ y[b[1]] + y[b[0]].T @ off[b[1]]
            for q, g, h in zip((w, c, s), (x.T @ off + 1e-4 * w, gc + 1e-4 * c, gs + gs.T + 1e-4 * s), pace, strict=True):
                h += g**2
                q -= 0.5 * g / np.sqrt(h)
        out.weights, out.chain, out.skip = w.astype(float), c.astype(float), s.astype(float)
        return out

    def unary(self, text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i in range(len(tokens)):
            for f in features(text, tokens, i):
                if f in self.index:
                    out[i] += self.weights[self.index[f]]
        return out

    def beliefs(self, text: str, tokens: list[tuple[int, int]], rounds: int = 30) -> np.ndarray:
        """Probabilities of the labels of each token, by loopy message passing: until
        it settles, in at least ``rounds`` rounds and what the longest chain needs."""
        phi = self.unary(text, tokens)
        edges = []
        for i in range(len(tokens) - 1):
            if adjacent(text, tokens, i):
                edges.append((i, i + 1, 0))
        edges += [(i, j, 1) for i, j in skips(text, tokens)]
        if edges:
            a, b, kind = np.array(edges).T
            tables = np.stack([self.chain, self.skip])
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.concatenate([tables[kind], tables[kind].transpose(0, 2, 1)])  # [edge, label of source, of target]
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(source), len(LABELS)))
            far = [0] * len(tokens)  # the longest chain that ends in a token
            for i, j, _ in sorted(edges, key=lambda e: e[1]):
                far[j] = max(far[j], far[i] + 1)
            for _ in range(rounds + 4 * max(far)):  # half of a message goes on in a round
                got = phi.copy()
                np.add.at(got, target, sent)
                into = (got[source] - sent[back])[:, :, None] + table
                top = into.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(into - top).sum(axis=1, keepdims=True)))[:, 0, :]
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - sent).max()
                sent = 0.5 * sent + 0.5 * new
                if change < 1e-3:
                    break
            np.add.at(phi, target, sent)
        p = np.exp(phi - phi.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans by the field that touch none of ``base``."""
        tokens = marked_tokens(text)
        if not tokens or not self.index:
            return []
        p = self.beliefs(text, tokens)
        best = p.argmax(axis=1)
        free = token_labels(tokens, base)
        sure = [bool(k) and p[i, k] >= MIN_BELIEF for i, k in enumerate(best)]
        for i in (*range(1, len(sure)), *range(len(sure) - 2, -1, -1)):  # parts of a span that is sure elsewhere
            for near in (i - 1, i + 1):
                if 0 <= near < len(sure) and sure[near] and best[near] == best[i] and p[i, best[i]] >= 0.5 and adjacent(text, tokens, min(i, near)):
                    sure[i] = True
        out: list[tuple[int, int, int]] = []
        joins = -1
        for i, (a, b) in enumerate(tokens):
            k = int(best[i])
            if not sure[i] or free[i]:
                joins = -1
                continue
            if k == SECRET and (cue := re.match(r"[\"']?\w+[\"']?[=:]", text[a:b])) and _EDGE.sub("", cue[0]).lower() in _INTRODUCES:
                a += cue.end()  # the value alone
            while a < b and not text[a].isalnum() and text[a] not in "+(":
                a += 1
            while a < b and not text[b - 1].isalnum() and text[b - 1] != ")":
                b -= 1
            if a == b:
                joins = -1
                continue
            if joins == i - 1 >= 0 and out and out[-1][1] == k - 1 and adjacent(text, tokens, i - 1):
                out[-1] = (out[-1][0], k - 1, b)
            else:
                out.append((a, k - 1, b))
            joins = i
        return [s for s in out if not any(s[0] < e and b < s[2] for b, _, e in base)]


def token_labels(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The label of each token by the spans that overlap it, the first one's."""
    out = [0] * len(tokens)
    at = 0
    for a, kind, b in base:
        while at < len(tokens) and tokens[at][1] <= a:
            at += 1
        i = at
        while i < len(tokens) and tokens[i][0] < b:
            out[i] = out[i] or kind + 1
            i += 1
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """Fitted on made documents with the words of ``sample`` documents, the first
    by hash among about DRAWN of all documents."""
    docs = id_text(df, id_col, text_col)
    share = DRAWN / max(docs.count(), 1)
    h = F.xxhash64("text")
    drawn = docs.where((F.pmod(h, F.lit(1 << 32)) <= int(min(share, 1) * (1 << 32))) & (F.length("text") <= SAMPLE_CHARS))
    some = drawn.select(h.alias("h"), F.substring("text", 1, 4000).alias("text")).distinct().orderBy("h", "text").limit(sample)
    return Field.train(made([r["text"] for r in some.collect()], MADE))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, by pattern or field) of every row."""
    model = model or train(df, id_col, text_col)

    def rows(batch):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            more = model.added(text, base)
            spans = sorted([(s, True) for s in base] + [(s, False) for s in more])
            yield key, [{"kind": KINDS[k], "start": a, "end": b, "pattern": p} for (a, k, b), p in spans]

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        id_text(df, id_col, text_col), rows, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,pattern:boolean>>", lambda r: 40 * len(r[1])
    )


def op5_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["pattern"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["pattern"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    every = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(documents(spark, sf_dir)).select(
        "doc_id", *map(count, BASE), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), *(every(k) for k in KINDS if k not in BASE),
    )


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
