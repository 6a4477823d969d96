"""Scoring: weighted metadata and phrase rules, decision bucket, reason and tags.

One chain of projections, no shuffle. Text is split into words once per row and
cut down to the few words that open any configured phrase; single-word terms are
then settled by that short list, longer ones only look at the text when their
first word is on it. Cost per row therefore hardly grows with the rule set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import Rule, Settings
from quillrank.functions.rows import unnest
from quillrank.functions.text import (
    contains_any,
    fold,
    fold_text,
    is_word_char,
    joined_fold,
    padded_words,
    phrase_pattern,
    spaced,
    text_or_empty,
)

# Wording of reasons and tags.
NO_REASON = "No strong configured signals matched"
RELEVANT_TAG = "relevant-track"
COMPANY_TAG = "company-fit"

SEARCHED = ("title", "summary", "speaker", "company", "source", "conference", "track")


def searchable_text() -> Column:
    """All human text of an item, caseless, joined by one blank each."""
    parts = [text_or_empty(F.col(c)) for c in SEARCHED]
    return fold(F.concat_ws(" ", *parts, F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")))


def _first_word(term: str) -> str | None:
    words = spaced(term).split()
    return words[0] if words else None


def with_phrase_words(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Add ``_padded`` and ``_words``: what the phrase conditions read."""
    openers = sorted({w for w in map(_first_word, map(fold_text, terms)) if w})
    df = df.withColumn("_padded", padded_words(F.col(text)))
    wanted = F.array(*[F.lit(w) for w in openers]).cast("array<string>")
    return df.withColumn("_words", F.array_intersect(F.split("_padded", " "), wanted))


def term_found(text: str, term: str) -> Column:
    """The term is in the text as a whole phrase. Needs ``with_phrase_words``."""
    folded = fold_text(term)
    opener = _first_word(folded)
    exact = F.col(text).rlike(phrase_pattern(folded))
    if opener is None:
        return F.contains(text, F.lit(folded)) & exact
    starts = F.array_contains("_words", opener)
    if all(map(is_word_char, folded)):
        return starts
    return starts & F.contains("_padded", F.lit(spaced(folded))) & exact


def matched_terms(text: str, rule: Rule) -> Column:
    """Terms of a rule found in the text: rule order, original spelling."""
    hits = [F.when(term_found(text, t), F.lit(t)) for t in rule.terms]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def with_matches(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_hits_<n>``: the matched terms of every rule."""
    if not rules:
        return df
    df = with_phrase_words(df, text, [t for r in rules for t in r.terms])
    return df.withColumns({f"_hits_{i}": matched_terms(text, r) for i, r in enumerate(rules)})


class _Signal:
    """A condition with what it is worth, what it says and how it tags."""

    def __init__(self, condition: Column, weight: float, reason: Column, tags: Sequence[str] = ()):
        self.condition, self.weight, self.reason, self.tags = condition, float(weight), reason, tags


def metadata_signals(settings: Settings) -> list[_Signal]:
    site, weights = settings.site, settings.weights

    def weight(name: str) -> float:
        return float(weights.get(name, 0))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    topics = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")
    company = fold(text_or_empty(F.col("company")))
    minutes = F.col("duration_minutes")
    return [
        _Signal(
            contains_any(joined_fold(F.col("source"), F.col("conference"), F.col("url")), [site.event_key]),
            weight("event_source"),
            F.lit(f"{site.event} source"),
            (site.event_key,),
        ),
        _Signal(
            contains_any(joined_fold(F.col("track"), topics), settings.relevant_tracks),
            weight("relevant_track"),
            F.lit("relevant track/topic metadata"),
            (RELEVANT_TAG,),
        ),
        _Signal(flag("has_transcript"), weight("has_transcript"), F.lit("has transcript")),
        _Signal(flag("has_video"), weight("has_video"), F.lit("has video")),
        _Signal(flag("has_slides"), weight("has_slides"), F.lit("has slides")),
        _Signal(
            F.coalesce(minutes.between(25, 70), F.lit(False)),
            weight("practical_duration"),
            F.lit("practical duration"),
        ),
        _Signal(
            (company != "") & contains_any(company, settings.companies),
            weight("company_fit"),
            F.lit("preferred company"),
            (COMPANY_TAG,),
        ),
    ]


def popularity_bonus(settings: Settings) -> Column:
    """Likes and views in whole steps, up to a ceiling."""
    conf = {"enabled": True, "max_bonus": 4, "like_step": 10, "view_step": 1000, **settings.popularity}
    if not conf["enabled"]:
        return F.lit(0).cast("bigint")
    bonus = F.lit(0).cast("bigint")
    for count, step in (("like_count", int(conf["like_step"])), ("view_count", int(conf["view_step"]))):
        if step > 0:
            bonus = bonus + F.coalesce(F.floor(F.col(count) / step), F.lit(0)).cast("bigint")
    return F.least(F.lit(int(conf["max_bonus"])).cast("bigint"), bonus)


def decision_of(score: Column, settings: Settings) -> Column:
    t = settings.thresholds
    return (
        F.when(score >= float(t["watch"]), "watch")
        .when(score >= float(t["skim"]), "skim")
        .when(score >= float(t["transcript"]), "transcript")
        .when(score >= float(t["background"]), "background")
        .otherwise("skip")
    )


def score_items(items: DataFrame, settings: Settings) -> DataFrame:
    """Replace score, decision, reason and tags; stored tags are kept and added to."""
    columns = [c for c in items.columns if c not in ("score", "decision", "reason", "tags")]
    had_tags = F.col("tags") if "tags" in items.columns else F.lit(None).cast("array<string>")
    df = items.withColumn("_tags", F.coalesce(had_tags, F.array().cast("array<string>")))
    df = with_matches(df.withColumn("_text", searchable_text()), "_text", settings.rules)

    signals = metadata_signals(settings)
    df = df.withColumns(
        {
            **{f"_meta_{i}": s.condition for i, s in enumerate(signals)},
            "_bonus": popularity_bonus(settings),
        }
    )

    # The order of additions is fixed, so fractional weights sum the same everywhere.
    total, reasons, tags = F.lit(0.0), [], [F.col("_tags")]
    for i, s in enumerate(signals):
        on = F.col(f"_meta_{i}")
        total = total + F.when(on, s.weight).otherwise(0.0)
        reasons.append(F.when(on, s.reason))
        if s.tags:
            tags.append(F.when(on, F.array(*map(F.lit, s.tags))).otherwise(F.array().cast("array<string>")))
    bonus = F.col("_bonus")
    total = total + bonus.cast("double")
    reasons.append(F.when(bonus != 0, F.concat(F.lit("popularity +"), bonus.cast("string"))))
    for i, rule in enumerate(settings.rules):
        hits = F.col(f"_hits_{i}")
        on = F.size(hits) > 0
        total = total + F.when(on, float(rule.weight)).otherwise(0.0)
        reasons.append(F.when(on, F.concat(F.lit(f"{rule.name}: "), F.array_join(F.slice(hits, 1, 3), ", "))))
        tags.append(
            F.when(on, F.array(*map(F.lit, rule.effective_tags))).otherwise(F.array().cast("array<string>"))
        )

    result = F.struct(
        total.alias("score"),
        F.coalesce(F.nullif(F.concat_ws("; ", *reasons), F.lit("")), F.lit(NO_REASON)).alias("reason"),
        F.sort_array(F.array_distinct(F.concat(*tags))).alias("tags"),
    )
    # As generated columns, scores stay put: a later filter on them is not pushed
    # into the projections above, where every mention would be worked out again.
    # Filters on the item's own columns still pass through to the scan.
    scored = df.select(*columns, F.inline_outer(F.array(result)))
    return scored.select(*columns, "score", decision_of(F.col("score"), settings).alias("decision"), "reason", "tags")


def phrase_hits(df: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Long form: one row per row, rule and matched term."""
    folded = df.select(key, fold(F.col(text)).alias("_text"))
    matched = with_matches(folded, "_text", rules)
    per_rule = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.weight).alias("weight"), F.col(f"_hits_{i}").alias("terms"))
            for i, r in enumerate(rules)
        ]
    )
    rows = unnest(matched, [key], F.filter(per_rule, lambda r: F.size(r["terms"]) > 0), "r")
    return rows.select(key, "r.rule", "r.weight", F.posexplode_outer("r.terms").alias("term_no", "term"))


def rule_totals(df: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Per row: each firing rule once, with its weight and its first three terms."""
    folded = df.select(key, fold(F.col(text)).alias("_text"))
    matched = with_matches(folded, "_text", rules)
    total, reasons = F.lit(0.0), []
    for i, rule in enumerate(rules):
        hits = F.col(f"_hits_{i}")
        total = total + F.when(F.size(hits) > 0, float(rule.weight)).otherwise(0.0)
        reasons.append(
            F.when(F.size(hits) > 0, F.concat(F.lit(f"{rule.name}: "), F.array_join(F.slice(hits, 1, 3), ", ")))
        )
    return matched.select(key, total.alias("total"), F.concat_ws("; ", *reasons).alias("reason"))
