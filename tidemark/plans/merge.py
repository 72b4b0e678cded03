"""The law of the table as plans: of each key the change of greatest sequence
counts, and if it is a delete the key is absent."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Iterable[str], columns: Iterable[str] | None = None, seq: str = "_seq", form: str = "window") -> DataFrame:
    """The change of greatest ``seq`` of each key, deletes included.

    Both forms have one exchange. ``window`` (group limit before the exchange,
    columns are pruned through it) suits wide rows; ``max_by`` suits few
    columns: its struct holds just what is asked for, as pruning does not reach into it.
    Filters on the key reach the scan in both; filters on values stay above."""
    key = list(key)
    rest = [c for c in (columns if columns is not None else df.columns) if c not in key and c != seq]
    if form == "max_by":
        best = F.max_by(F.struct(*rest, seq) if rest else F.struct(seq), seq).alias("_best")
        return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_best.{c}").alias(c) for c in [*rest, seq]))
    turn = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    return df.select(*key, *rest, seq).withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def live(df: DataFrame, deleted: str = "_deleted") -> DataFrame:
    """Without deleted keys and without the bookkeeping."""
    return df.where(~F.col(deleted)).drop(deleted, "_seq")


def overlay(base: DataFrame, hot: DataFrame, key: Iterable[str], broadcast_hot: bool = False) -> DataFrame:
    """Current rows: hot keys, deleted ones too, hide those of ``base``.

    ``base`` has a row a key and is not aggregated again. ``hot`` is already one
    change a key, with ``_deleted``. Broadcast hot keys only where their size is known to be small."""
    key = list(key)
    keys = hot.select(*key)
    below = base.join(F.broadcast(keys) if broadcast_hot else keys, key, "left_anti")
    return below.unionByName(live(hot).select(*base.columns))


def current(changelog: DataFrame, key: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Current rows of a changelog that has ``_seq`` and ``_deleted``."""
    wanted = [*columns, "_deleted"] if columns is not None else None
    return live(latest(changelog, key, wanted))


def tristate(keys: DataFrame, hot: DataFrame, key: Iterable[str]) -> DataFrame:
    """Each row of ``keys`` with ``result``: HIT, DELETED or MISS among the latest changes ``hot``, and the values of hits."""
    key = list(key)
    rest = [c for c in hot.columns if c not in (*key, "_seq", "_deleted")]
    marked = hot.withColumn("_there", F.lit(True))
    result = F.when(F.col("_there").isNull(), "MISS").when(F.col("_deleted"), "DELETED").otherwise("HIT")
    return keys.join(marked, key, "left").select(*keys.columns, result.alias("result"), *(F.when(~F.col("_deleted"), F.col(c)).alias(c) for c in rest))
