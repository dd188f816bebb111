"""Streams into an index: micro-batches, each committed once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.catalog import Catalog

_UNITS = {"ms": 1, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000}


def milliseconds(duration: str) -> int:
    """The length of a duration such as ``30s``, ``500ms`` or ``1m 30s``."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", duration)
    if not parts or re.sub(r"(\d+)\s*([a-z]+)", "", duration).strip() or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"not a duration: {duration!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def ingest(catalog: Catalog, name: str, lines: DataFrame, commit_interval: str | None = "30s", on_bad_json: str = "fail", source_id: str = "stream") -> StreamingQuery:
    """Start a stream of lines into an index. Without an interval it ends when the source has no more.

    Offsets live in a checkpoint inside the index; the manifest remembers the last batch, so
    that a batch replayed after a crash isn't committed twice.
    """
    catalog.config(name)

    def commit(batch: DataFrame, batch_id: int) -> None:
        catalog.index(name, batch, on_bad_json, (source_id, batch_id))

    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", f"{catalog.root}/{name}/checkpoint/{source_id}")
    trigger = {"availableNow": True} if commit_interval is None else {"processingTime": f"{milliseconds(commit_interval)} milliseconds"}
    return writer.trigger(**trigger).start()
