"""What a stored run was made of, so that a later one resumes only what is still true.

Every table has a key: a hash of its name, of the settings that it depends on, of the keys of the tables before it and,
at the start, of the input.  The key is written beside a table when it is complete.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from creditflow.settings import Settings
from creditflow.sources import readers, writers

#: table: (tables that it is built from, settings that it depends on); in the order in which they are built.
STEPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "event_base": ((), ("public_suffixes",)),
    "orders": (("event_base",), ()),
    "sessions": (("event_base",), ("storefront", "admin_hosts", "inferred_search_host", "public_suffixes", "resolution_version", "mapping_version")),
    "strict": (("orders", "sessions"), ("lookback_days", "path_version")),
    "revised": (("orders", "sessions"), ("lookback_days", "path_version")),
    "coverage": (("orders", "sessions", "strict", "revised"), ("lookback_days", "admin_hosts", "path_version")),
    "results": (("revised",), ("half_life_seconds",)),
    "journeys": (("orders", "sessions", "revised"), ("inactivity_seconds", "boundary_start", "boundary_end", "journey_version")),
    "effects": (("journeys",), ("markov_version",)),
    "markov_attribution": (("effects", "journeys"), ()),
    "comparison": (("results", "markov_attribution"), ()),
}
COMPLETE, STALE, MISSING = "complete", "stale", "missing"
KEY_FILE = "_KEY"


def input_key(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table."""
    return _hash(readers.files(spark, path))


def frame_key(df: DataFrame) -> str:
    """For an input that is no file: its schema, count and fingerprint."""
    return _hash(list(map(str, readers.snapshot(df).first())))


def _hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def keys(s: Settings, source: str) -> dict[str, str]:
    settings, out = asdict(s), {}
    for name, (upstream, used) in STEPS.items():
        out[name] = _hash([name, {u: settings[u] for u in used}, [out[u] for u in upstream] if upstream else [source]])
    return out


def states(spark: SparkSession, folder: str, wanted: dict[str, str]) -> dict[str, str]:
    """Per table: complete, stale (made of something else, or not finished) or missing."""
    out = {}
    for name, key in wanted.items():
        stored = writers.get_text(spark, f"{folder}/{name}/{KEY_FILE}")
        there = stored is not None or writers.path_exists(spark, f"{folder}/{name}")
        out[name] = COMPLETE if stored == key else STALE if there else MISSING
    return out


def to_build(found: dict[str, str], mode: str) -> list[str]:
    """Tables to build.  ``create``: all, and none may be there.  ``resume``: what follows an exact prefix of complete tables.

    ``rebuild``: all that are not complete, whatever is there.
    """
    names = list(found)
    if mode == "rebuild":
        return [n for n in names if found[n] != COMPLETE]
    there = [n for n in names if found[n] != MISSING]
    if mode == "create":
        if there:
            raise RuntimeError(f"already there: {there}")
        return names
    if mode != "resume":
        raise ValueError(f"mode {mode}")
    first = next((i for i, n in enumerate(names) if found[n] != COMPLETE), len(names))
    if wrong := [n for n in names[first:] if found[n] != MISSING]:
        raise RuntimeError(f"no exact prefix: {names[first]} is {found[names[first]]}, and {wrong} are there")
    return names[first:]


def written(spark: SparkSession, folder: str, name: str, key: str) -> None:
    writers.put_text(spark, f"{folder}/{name}/{KEY_FILE}", key)
