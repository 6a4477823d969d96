"""Curation settings: loaded once on the driver, turned into column expressions."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

# Decision buckets in report order.
DECISIONS = ("watch", "skim", "transcript", "background", "skip")
# Buckets that are worth a work item.
ELIGIBLE = ("watch", "skim", "transcript")

# Settings used wherever a settings file is silent.
DEFAULT_YEARS = {"default_start_year": 2016, "default_end_year": 2030}
DEFAULT_THRESHOLDS = {"watch": 16, "skim": 10, "transcript": 6, "background": 3}
DEFAULT_WEIGHTS = {
    "event_source": 6,
    "relevant_track": 4,
    "has_transcript": 3,
    "has_video": 2,
    "has_slides": 1,
    "practical_duration": 1,
    "company_fit": 3,
}
DEFAULT_POPULARITY = {"enabled": True, "like_step": 10, "view_step": 1000, "max_bonus": 4}
DEFAULT_SYNC = {
    "eligible_decisions": list(ELIGIBLE),
    "batch_limit": 25,
    "default_status": "Backlog",
}
# Substrings that make a track or topic relevant.
RELEVANT_TRACKS = ("architecture", "devops", "data", "ai", "platform", "sre")
# Track links recognised on a listing card.
TRACK_NAMES = (
    "Architecture & Design",
    "DevOps",
    "AI, ML & Data Engineering",
    "Development",
    "Culture & Methods",
)


@dataclass(frozen=True)
class Site:
    """Where the items live and how their event is called."""

    name: str = "Item Site"
    host: str = "items.example.org"
    feed_host: str = "feed.items.example.org"
    item_path: str = "/presentations/"
    event: str = "Summit"
    tracks: tuple[str, ...] = TRACK_NAMES
    next_words: tuple[str, ...] = ("older", "next", "more presentations")
    generic_card_titles: tuple[str, ...] = ("view presentation", "presentation")
    generic_schedule_titles: tuple[str, ...] = ("presentations", "view presentation")

    @property
    def event_key(self) -> str:
        return self.event.lower()

    @property
    def listing_slug(self) -> str:
        return self.item_path.strip("/").split("/")[-1]


@dataclass(frozen=True)
class Rule:
    """One weighted set of phrases; a rule without tags tags with its own name."""

    name: str
    weight: float
    terms: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    @property
    def effective_tags(self) -> tuple[str, ...]:
        return self.tags or (self.name,)


@dataclass(frozen=True)
class Settings:
    site: Site = field(default_factory=Site)
    rules: tuple[Rule, ...] = ()
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    popularity: Mapping[str, int | bool] = field(default_factory=lambda: dict(DEFAULT_POPULARITY))
    companies: tuple[str, ...] = ()
    relevant_tracks: tuple[str, ...] = RELEVANT_TRACKS
    seed_urls: tuple[str, ...] = ()
    start_year: int = DEFAULT_YEARS["default_start_year"]
    end_year: int = DEFAULT_YEARS["default_end_year"]
    sync: Mapping[str, object] = field(default_factory=lambda: dict(DEFAULT_SYNC))

    @property
    def eligible(self) -> list[str]:
        return [str(d) for d in self.sync["eligible_decisions"]]

    @property
    def batch_limit(self) -> int:
        return int(self.sync["batch_limit"])


def _rule(raw: Mapping, site: Site) -> Rule:
    def fill(value: object) -> str:
        return str(value).replace("{event_key}", site.event_key).replace("{event}", site.event)

    return Rule(
        name=fill(raw["name"]),
        weight=float(raw["weight"]),
        terms=tuple(fill(t) for t in raw.get("terms", ())),
        tags=tuple(fill(t) for t in raw.get("tags", ())),
    )


def settings_from_mapping(raw: Mapping, site: Site | None = None) -> Settings:
    """Merge a settings mapping over the defaults, key by key within each section.

    The event weight may be called ``event_source`` or ``<event>_source``, the
    seeds ``seed_urls`` or ``<event>_seed_urls``: the event name is the site's.
    """
    site = site or Site()
    years = {**DEFAULT_YEARS, **raw.get("backfill", {})}
    weights = dict(raw.get("metadata_weights", {}))
    sources = dict(raw.get("sources", {}))
    own_weight = weights.pop(f"{site.event_key}_source", None)
    if own_weight is not None:
        weights.setdefault("event_source", own_weight)
    seeds = sources.get("seed_urls", sources.get(f"{site.event_key}_seed_urls", ()))
    return Settings(
        site=site,
        rules=tuple(_rule(r, site) for r in raw.get("signals", ())),
        thresholds={**DEFAULT_THRESHOLDS, **raw.get("thresholds", {})},
        weights={**DEFAULT_WEIGHTS, **weights},
        popularity={**DEFAULT_POPULARITY, **raw.get("popularity", {})},
        companies=tuple(str(c) for c in raw.get("companies", {}).get("preferred", ())),
        seed_urls=tuple(str(u) for u in seeds),
        start_year=int(years["default_start_year"]),
        end_year=int(years["default_end_year"]),
        sync={**DEFAULT_SYNC, **raw.get("github", {})},
    )


def load_settings(path: str | Path | None = None, site: Site | None = None) -> Settings:
    """Read a TOML settings file; a missing file means the plain defaults."""
    if path is None or not Path(path).exists():
        return Settings(site=site or Site())
    with open(path, "rb") as handle:
        return settings_from_mapping(tomllib.load(handle), site)


def shipped_settings(site: Site | None = None) -> Settings:
    """The rule set shipped with the package: 12 rules, 108 terms."""
    text = resources.files("quillrank.resources").joinpath("rules.toml").read_text("utf-8")
    return settings_from_mapping(tomllib.loads(text), site)


def rules_frame(spark, rules: Sequence[Rule]):
    """The rules as a small table, for audit joins."""
    rows = [(i, r.name, float(r.weight), list(r.terms), list(r.effective_tags)) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_no int, name string, weight double, terms array<string>, tags array<string>"
    )
