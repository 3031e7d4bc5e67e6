"""Parameters of a landing zone. Plain values with defaults; nothing here is data."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Lanes:
    processing: str = "processing"
    processed: str = "processed"
    failed: str = "failed"
    ignored: str = "ignored"
    tmp: str = "tmp"

    def all(self) -> list[str]:
        return [self.processing, self.processed, self.failed, self.ignored, self.tmp]


@dataclass(frozen=True)
class AdmissionConfig:
    """What a landing zone accepts. Fixed default values."""

    roots: tuple[str, ...] = ("/landing/incoming",)
    working_dir: str = "/landing"
    include: tuple[str, ...] = ("*.xml", "*.zip")
    exclude: tuple[str, ...] = (".*", "*.tmp")
    min_bytes: int = 100
    max_bytes: int = 100 * 1024 * 1024
    stable_attempts: int = 5
    stable_deadline_us: int = 5 * MINUTE_US
    debounce_us: int = SECOND_US
    max_files_per_second: int = 100
    lanes: Lanes = field(default_factory=Lanes)


@dataclass(frozen=True)
class LedgerTtl:
    """How long each kind of ledger entry lives. Fixed default values."""

    enqueued_us: int = DAY_US
    processed_us: int = 7 * DAY_US
    failed_us: int = 7 * DAY_US
    lock_us: int = 30 * SECOND_US


@dataclass(frozen=True)
class RetryConfig:
    """Back-off of publish attempts. Fixed default values."""

    max_attempts: int = 3
    initial_delay_ms: int = 1_000
    max_delay_ms: int = 30_000
    multiplier: float = 2.0


@dataclass(frozen=True)
class Buckets:
    """Exponential histogram bounds: start * factor^i for i in [0, count)."""

    start: float
    factor: float
    count: int

    def bounds(self) -> list[float]:
        return [self.start * self.factor**i for i in range(self.count)]


# Fixed values of the three histograms.
PROCESSING_SECONDS = Buckets(0.001, 2, 15)
STABILITY_SECONDS = Buckets(0.1, 2, 10)
SIZE_BYTES = Buckets(1024, 2, 15)
