"""Data model: samples, metrics, tag matchers, requests and configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from datetime import datetime
from enum import Enum

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("resource_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("time", T.TimestampNTZType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)
STORED_SAMPLES = T.StructType([*SAMPLES.fields, T.StructField("p", T.StringType(), False)])

#: One row a tag. ``tag_key`` may be null: keyless tags exist.
CATALOG_TAGS = T.StructType(
    [
        T.StructField("metric_key", T.StringType(), False),
        T.StructField("tag_type", T.StringType(), False),
        T.StructField("tag_key", T.StringType(), True),
        T.StructField("tag_value", T.StringType(), False),
    ]
)
TAG_TYPES = ("intrinsic", "meta", "external")
TAGS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
#: One row a metric; identity is the intrinsic set.
METRICS = T.StructType([T.StructField("metric_key", T.StringType(), False), *(T.StructField(t, TAGS, False) for t in TAG_TYPES)])

#: Codecs that stored samples may have.
CODECS = {"UNCOMPRESSED": "uncompressed", "LZ4_RAW": "lz4_raw"}


class StorageError(RuntimeError):
    """The store isn't open, or a row can't be stored."""


class Match(Enum):
    EQUALS = "equals"
    NOT_EQUALS = "not_equals"
    EQUALS_REGEX = "equals_regex"
    NOT_EQUALS_REGEX = "not_equals_regex"


@dataclass(frozen=True)
class TagMatcher:
    """A key (None for keyless tags), a kind of match and the value or pattern."""

    key: str | None
    value: str
    type: Match = Match.EQUALS


@dataclass(frozen=True)
class FetchRequest:
    """Samples of one metric strictly between two instants. Only aggregation NONE exists; step is ignored."""

    metric_key: str
    start: datetime
    end: datetime
    aggregation: str = "NONE"
    step: str | None = None


_DURATION = re.compile(r"([+-]?)P(?:([+-]?\d+)D)?(?:T(?:([+-]?\d+)H)?(?:([+-]?\d+)M)?(?:([+-]?\d+)(?:[.,](\d{1,9}))?S)?)?", re.I)


def duration_us(text: str) -> int:
    """Microseconds of an ISO-8601 duration of days and times."""
    m = _DURATION.fullmatch(text.strip())
    if not m or not any(m.group(i) for i in (2, 3, 4, 5)) or text.strip().upper().endswith("T"):
        raise ValueError(f"not a duration: {text!r}")
    days, hours, minutes, seconds = (int(m.group(i) or 0) for i in (2, 3, 4, 5))
    fraction = int((m.group(6) or "0").ljust(9, "0")) // 1000
    whole = ((days * 24 + hours) * 60 + minutes) * 60 + seconds
    us = whole * 1_000_000 + (-fraction if (m.group(5) or "").startswith("-") else fraction)
    return -us if m.group(1) == "-" else us


MINUTE_US = 60_000_000


def check_partition(us: int) -> int:
    """Partitions are whole minutes; shorter ones would share labels."""
    if us <= 0 or us % MINUTE_US:
        raise ValueError("a partition is a positive number of whole minutes")
    return us


def check_codec(name: str) -> str:
    """Spark's name of a codec, whatever its case."""
    try:
        return CODECS[name.strip().upper()]
    except KeyError:
        raise ValueError(f"codec {name!r} isn't supported; one of {', '.join(CODECS)}") from None


@dataclass(frozen=True)
class StoreConfig:
    """The ten settings of a store. ``with_text`` takes them as strings; a blank one keeps the default."""

    base_dir: str = ""
    partition_us: int = field(default_factory=lambda: duration_us("P1D"))
    retention_us: int = field(default_factory=lambda: duration_us("P365D"))
    sweep_us: int = field(default_factory=lambda: duration_us("P1D"))
    compression: str = "uncompressed"
    prune_catalog: bool = True
    flush_rows: int = 8192
    flush_us: int = field(default_factory=lambda: duration_us("PT60S"))
    compact_on: bool = True
    compaction_us: int = field(default_factory=lambda: duration_us("PT1H"))

    def __post_init__(self) -> None:
        check_partition(self.partition_us)
        if self.flush_rows <= 0:
            raise ValueError("flush_rows must be positive")
        if min(self.retention_us, self.sweep_us, self.flush_us, self.compaction_us) <= 0:
            raise ValueError("intervals must be positive")

    def with_text(self, **settings: str | bool | None) -> StoreConfig:
        known = {f.name for f in fields(self)}
        changed: dict = {}
        for name, text in settings.items():
            target = f"{name}_us" if f"{name}_us" in known else name
            if target not in known:
                raise ValueError(f"no such setting: {name}")
            if isinstance(text, bool):
                changed[target] = text
            elif text is None or not text.strip():
                continue
            elif target.endswith("_us"):
                changed[target] = duration_us(text)
            elif target == "compression":
                changed[target] = check_codec(text)
            elif target == "flush_rows":
                changed[target] = int(text)
            elif target in ("prune_catalog", "compact_on"):
                changed[target] = text.strip().lower() == "true"
            else:
                changed[target] = text.strip()
        return replace(self, **changed)
