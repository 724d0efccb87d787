"""Scanning several providers into the queue, with counters of each.

Events are counted where they pass (observed metrics), in the job that writes them; nothing is read a second time for the counts. A provider
that fails leaves the queue as it was, and the others are scanned all the same. Tasks of a shuffle that run twice because an executor
was lost are counted twice; the queue itself isn't affected, since ids decide what it takes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from usagelake.api import load_usage
from usagelake.operators.dedupe import insert_ignore
from usagelake.operators.identity import IDENTITY_FILE
from usagelake.plans.export import queue_rows
from usagelake.plans.log_store import LogStore
from usagelake.providers.base import REGISTRY


@dataclass(frozen=True)
class Counts:
    parsed: int  #: events read
    inserted: int  #: of them, those the queue didn't have


@dataclass
class Scan:
    counts: dict[str, Counts] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def scan_order(dirs: Mapping[str, list[str]]) -> list[str]:
    """Providers with a path that isn't empty: registered ones in the order of registration, then the others by name."""
    wanted = {name for name, paths in dirs.items() if any(paths)}
    return [name for name in REGISTRY if name in wanted] + sorted(wanted - set(REGISTRY))


def insert_counted(store, events: DataFrame) -> Counts:
    """Puts events into the queue of a store."""
    parsed, inserted = Observation(), Observation()
    seen = queue_rows(events).observe(parsed, F.count(F.lit(1)).alias("n"))
    if isinstance(store, LogStore):
        n = store.insert(seen)
        return Counts(parsed.get["n"], n)
    queue = store.read()
    fresh = insert_ignore(queue, seen, "id", ["ts"]).observe(inserted, F.count(F.lit(1)).alias("n"))
    store.replace(queue.unionByName(fresh))
    return Counts(parsed.get["n"], inserted.get["n"])


def scan(spark: SparkSession, store, dirs: Mapping[str, list[str]], identity: str | DataFrame | None = IDENTITY_FILE) -> Scan:
    """Loads each provider's events from its paths and inserts what is new."""
    done = Scan()
    for name in scan_order(dirs):
        try:
            if name not in REGISTRY:
                raise ValueError(f"no provider is called {name}")
            done.counts[name] = insert_counted(store, load_usage(spark, name, [p for p in dirs[name] if p], identity=identity))
        except Exception as e:
            done.errors[name] = str(e)[:4096]
    return done
