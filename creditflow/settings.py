"""Parameters of an attribution run; nothing about one data set is fixed in the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

# Registries of the public suffix list that most shops meet, by top-level domain.
SECOND_LEVEL = {
    "au": "com edu gov net org",
    "br": "com edu gov net org",
    "cn": "ac com edu gov net org",
    "hk": "com edu gov net org",
    "id": "ac co go or web",
    "il": "ac co gov net org",
    "in": "ac co gov net org",
    "jp": "ac co go ne or",
    "kr": "ac co go ne or",
    "mx": "com edu gob net org",
    "my": "com edu gov net org",
    "nz": "ac co govt net org",
    "pl": "com edu gov net org",
    "sg": "com edu gov net org",
    "th": "ac co go in or",
    "tr": "com edu gov net org",
    "tw": "com edu gov net org",
    "ua": "com edu gov net org",
    "uk": "ac co gov ltd me net org plc",
    "za": "ac co gov net org",
    "io": "github",
    "com": "blogspot",
    "app": "vercel web",
    "ck": "*",
}
SUFFIX_EXCEPTIONS = ("!www.ck",)


@dataclass(frozen=True)
class Settings:
    storefront: str = "store.example"
    admin_hosts: tuple[str, ...] = ("admin.example.net", "console.example.net")
    inferred_search_host: str = "www.google.com"
    lookback_days: int = 7
    inactivity_seconds: int = 86_400
    short_inactivity_seconds: int = 43_200
    boundary_start: datetime = datetime(2024, 1, 1)
    boundary_end: datetime = datetime(2024, 1, 31)
    half_life_seconds: int = 604_800
    scenario_days: tuple[int, ...] = (1, 3, 7)
    #: Suffixes under which names are registered, in the notation of the public suffix list: ``*`` is any label, ``!``
    #: an exception; a top-level domain needs no rule.  ``readers.suffix_rules`` reads a whole list.
    public_suffixes: tuple[str, ...] = (*(f"{x}.{tld}" for tld, names in SECOND_LEVEL.items() for x in names.split()), *SUFFIX_EXCEPTIONS)
    resolution_version: str = "source-1"
    mapping_version: str = "channels-1"
    path_version: str = "paths-1"
    journey_version: str = "journeys-1"
    markov_version: str = "markov-1"
    sensitivity_version: str = "sensitivity-1"
    reporting_version: str = "reporting-1"


DEFAULT = Settings()
RULE_MODELS = ("First Click", "Last Click", "Last Non-direct Click", "Linear", "Time Decay")
START, CONVERSION, NULL = "Start", "Conversion", "Null"
