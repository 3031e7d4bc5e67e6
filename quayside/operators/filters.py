"""Row predicates of the admission path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the watch operation mask.
OP_BITS = {"CREATE": 1, "WRITE": 2, "REMOVE": 4, "RENAME": 8, "CHMOD": 16}
SIDECAR = "Zone.Identifier"


def is_arrival(op: Column | str) -> Column:
    """Operation names that announce content: create or write."""
    return (F.col(op) if isinstance(op, str) else op).isin("CREATE", "WRITE")


def is_arrival_mask(mask: Column | str) -> Column:
    """The same on a bit mask, where one event may carry several operations."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return m.bitwiseAND(OP_BITS["CREATE"] | OP_BITS["WRITE"]) != 0


def is_sidecar(path: Column | str, mode: str = "event") -> Column:
    """Metadata files another system leaves next to a download.

    The event path knows both spellings; a scan only knows the one with a colon.
    """
    p = F.col(path) if isinstance(path, str) else path
    colon = p.endswith(f":{SIDECAR}")
    return colon | p.endswith(f".{SIDECAR}") if mode == "event" else colon


def size_reason(length: Column | str, min_bytes: int, max_bytes: int) -> Column:
    """NULL when the size is accepted; both bounds are inclusive."""
    n = F.col(length) if isinstance(length, str) else length
    return F.when(n < min_bytes, "file_too_small").when(n > max_bytes, "file_too_large")


def arrivals(events: DataFrame, op: str = "op", path: str = "path", mode: str = "event") -> DataFrame:
    return events.filter(is_arrival(op) & ~is_sidecar(path, mode))
