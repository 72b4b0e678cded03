"""Versioned manifest: what a table consists of. A version is one JSON file that
is renamed into place; readers of an older version keep what it names until a vacuum."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass, field

from .storage import Store

#: States of a run, in the order in which a run goes through them.
OPEN, FROZEN, NEW, SINKED = "OPEN", "FROZEN", "NEW", "SINKED"
KEPT = 20  #: versions of the manifest that are kept


@dataclass
class Run:
    """Changes in one folder. OPEN: a written batch; FROZEN: closed by a fence;
    NEW: sorted, one change a key; SINKED: also in the base."""

    id: str
    state: str
    flush_from: int
    flush_to: int
    min_seq: int
    max_seq: int
    rows: int
    bytes: int
    written: float
    min_key: list = field(default_factory=list)
    max_key: list = field(default_factory=list)
    shift: int = 0  #: what the sequences in its files are less than the real ones


@dataclass
class Manifest:
    version: int = 0
    writer_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    next_seq: int = 1
    frozen_seq: int = 0
    flushed_seq: int = 0
    persisted_seq: int = 0
    flushes: int = 0
    commits: int = 0
    runs: list[Run] = field(default_factory=list)
    base: dict[str, str] = field(default_factory=dict)  #: cell (partition and bucket): folder of its one row a key
    base_sizes: dict[str, int] = field(default_factory=dict)  #: bytes of each cell
    prepared: dict | None = None  #: a sink between its two phases
    batches: dict[str, int] = field(default_factory=dict)  #: last batch of each stream

    @property
    def base_bytes(self) -> int:
        return sum(self.base_sizes.values())

    def of(self, *states: str) -> list[Run]:
        return [r for r in self.runs if r.state in states]


def load(store: Store) -> Manifest | None:
    names = [n for n in store.names("manifest") if n.endswith(".json")]
    if not names:
        return None
    d = store.read_json("manifest", names[-1])
    d["runs"] = [Run(**r) for r in d["runs"]]
    return Manifest(**d)


def publish(store: Store, m: Manifest) -> Manifest:
    m.version += 1
    store.write_json(asdict(m), "manifest", f"{m.version:012d}.json")
    if m.version > KEPT:
        store.delete("manifest", f"{m.version - KEPT:012d}.json")
    return m


def now() -> float:
    return time.time()
