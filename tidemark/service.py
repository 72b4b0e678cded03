"""The calls of a table service, with rows as JSON objects."""

from __future__ import annotations

import math
from collections.abc import Mapping

from tidemark.errors import NotSupported, ShuttingDown, TidemarkError
from tidemark.operators import lookup
from tidemark.operators.table import Table
from tidemark.sources.json_rows import from_json, to_json


class Service:
    """One object a table; each method is one call of the service's interface."""

    def __init__(self, table: Table):
        self.table = table

    def health(self) -> dict:
        return {"status": ShuttingDown.status if self.table.closed else "OK"}

    def write(self, row: Mapping) -> dict:
        return {"sequence": self.table.write_batch([("+I", from_json(self.table.spec, row))])}

    def write_batch(self, ops: list[Mapping]) -> dict:
        """Each of ``ops`` has ``kind`` and ``row``."""
        spec = self.table.spec
        return {"sequence": self.table.write_batch([(o["kind"], from_json(spec, o["row"])) for o in ops])}

    def delete(self, key: Mapping) -> dict:
        return {"sequence": self.table.delete_where(from_json(self.table.spec, key, list(key)))}

    def _key(self, key: Mapping) -> dict:
        known = [c for c in key if c in self.table.spec.columns]
        return from_json(self.table.spec, key, known) | {c: key[c] for c in key if c not in known}

    def get(self, key: Mapping) -> dict | None:
        row = lookup.get(self.table, self._key(key))
        return None if row is None else to_json(self.table.spec, row.asDict())

    def get_local(self, key: Mapping) -> dict:
        result, row = lookup.get_local(self.table, self._key(key))
        return {"result": result, "row": None if row is None else to_json(self.table.spec, row.asDict())}

    def prefix_local(self, key: Mapping) -> list[dict]:
        return [to_json(self.table.spec, r.asDict()) for r in lookup.prefix_local(self.table, self._key(key), limit=math.inf)]

    def prefix(self, key: Mapping, allow: bool = True) -> list[dict]:
        """Over all tiers. ``allow=False`` refuses it, for callers that rely on that."""
        if not allow:
            raise NotSupported("prefix reads over all tiers are turned off")
        return [to_json(self.table.spec, r.asDict()) for r in lookup.prefix(self.table, self._key(key))]

    def flush(self) -> dict:
        return {"fence": self.table.request_flush()}

    def sink(self) -> dict:
        return {"fence": self.table.request_sink()}

    def state(self) -> dict:
        return self.table.state()

    def handshake(self) -> dict:
        """Specification, fingerprint and limits."""
        return self.table.describe()

    def call(self, name: str, *args) -> dict:
        """A call by name: its result, or the status and message of its error."""
        try:
            return {"status": "OK", "result": getattr(self, name)(*args)}
        except TidemarkError as e:
            return {"status": e.status, "message": str(e)}
