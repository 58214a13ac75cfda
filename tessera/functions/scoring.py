"""Reads, labels and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights and bounds that results depend on.
DECAY = {"routine": 0.35, "ordinary": 0.45, "notable": 0.55, "significant": 0.66, "extraordinary": 0.76}
PRIMARY_LIFT, CONFIDENCE_CAP, CONTRADICTED_FACTOR, CONFIRM_AT = 0.5, 0.97, 0.4, 3
NEUTRAL_REPUTATION, GROUP_FLOOR, COLD_START_CAP, DISPUTED_PENALTY, SUPPORT_BONUS, SUPPORT_CAP, STRONG_SUPPORT = 0.5, 0.6, 0.70, 0.30, 0.03, 0.09, 0.70
MIN_EVIDENCE, MAX_WEIGHT, FLOOR_WEIGHT, DIVERSITY_MINIMUM = 5, 0.30, 0.02, 8
CORROBORATOR_BONUS, SOLO_FACTOR, SOLO_SHARE, UNPROVEN_RATE = 1.20, 0.60, 0.25, 0.35
# End of fixed values.

BIG = ("significant", "extraordinary")


def decay_of(extremity: Column, decay: dict[str, float] | None = None) -> Column:
    """Doubt that each originator leaves, by extremity; unknown levels count as notable."""
    c = F.lit(0.55)
    for level, d in (decay or DECAY).items():
        c = F.when(extremity == level, F.lit(d)).otherwise(c)
    return c


def confidence_raw(n: Column, primary: Column, decay: Column, grounding: Column | None = None, lift: float = PRIMARY_LIFT, cap: float = CONFIDENCE_CAP) -> Column:
    """The confidence read, not rounded."""
    g = F.coalesce(grounding, F.lit("")) if grounding is not None else F.lit("")
    base = 1 - F.pow(decay, F.greatest(F.lit(0), n))
    lifted = F.when(F.coalesce(primary, F.lit(False)) & ~g.isin("not_addressed", "contradicted"), base + (1 - base) * lift).otherwise(base)
    return F.least(F.when(g == "contradicted", lifted * CONTRADICTED_FACTOR).otherwise(lifted), F.lit(cap))


def confidence_read(n: Column, primary: Column, extremity: Column, grounding: Column | None = None, digits: int = 2, **over) -> Column:
    """Diminishing returns per independent originator, half the gap for a primary source, capped."""
    decay = over.pop("decay", None)
    return F.round(confidence_raw(n, primary, decay_of(extremity, decay), grounding, **over), digits)


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.85, "hi").when(c >= 0.60, "mid").when(c >= 0.40, "lo").otherwise("floor")


def confidence_label(c: Column, n: Column | None = None, primary: Column | None = None, extremity: Column | None = None) -> Column:
    """Verdict in words; weak reads name what is missing if the signals are given."""
    weak = F.when(c >= 0.40, "Limited corroboration").otherwise("Thinly sourced")
    if n is not None:
        big = F.coalesce(extremity, F.lit("")).isin(*BIG)
        single = (n <= 1) & ~F.coalesce(primary, F.lit(False))
        named = (
            F.when(single & big, "Single source · extraordinary claim").when(single, "Single source").when(big, "Not yet established · extraordinary claim").otherwise("Thinly corroborated")
        )
        weak = F.when(n.isNull(), weak).otherwise(named)
    return F.when(c >= 0.85, "Well corroborated").when(c >= 0.60, "Corroborated").otherwise(weak)


def resolve_outcome(first_n: Column, last_n: Column, last_primary: Column, corrected: Column, grounding: Column | None = None, confirm_at: int = CONFIRM_AT) -> Column:
    """How a fact turned out: refuted, confirmed, corroborating or unconfirmed."""
    g = F.coalesce(grounding, F.lit("")) if grounding is not None else F.lit("")
    return (
        F.when(F.coalesce(corrected, F.lit(False)) | (g == "contradicted"), "refuted")
        .when((last_n >= confirm_at) | F.coalesce(last_primary, F.lit(False)), "confirmed")
        .when(last_n > first_n, "corroborating")
        .otherwise("unconfirmed")
    )


def is_terminal(outcome: Column) -> Column:
    return outcome.isin("confirmed", "refuted")


def lifecycle(outcome: Column, n_events: Column, first_n: Column, last_n: Column, first_primary: Column, last_primary: Column, silent_s: Column, stale_after: float = 86400.0) -> Column:
    """Where a fact stands: extended, resolved, decayed, resolving or dormant; silent_s is null without a time."""
    grown = (n_events > 1) & ((last_n > first_n) | (first_primary != last_primary))
    return (
        F.when(is_terminal(outcome) & grown, "extended")
        .when(is_terminal(outcome), "resolved")
        .when(F.coalesce(silent_s > stale_after, F.lit(False)), "decayed")
        .when(last_n > first_n, "resolving")
        .otherwise("dormant")
    )


def is_independent(source_primary: Column, n_groups: Column) -> Column:
    """No group: no; one group: a primary source only; more: yes."""
    return F.when(n_groups <= 0, False).when(n_groups == 1, source_primary).otherwise(True)


def reputation_score(confirmation: Column, independent: Column) -> Column:
    return F.round(F.when(confirmation.isNotNull(), 0.7 * confirmation + 0.3 * independent).otherwise(0.5 * independent), 3)


def reliability_rank(confirmation: Column, independent: Column) -> Column:
    return F.when(confirmation.isNotNull(), confirmation * 0.7 + independent * 0.3).otherwise(-1.0 + independent * 0.3)


def preference_raw(appearances: Column, confirmation: Column, independent: Column, attribution: Column) -> Column:
    """How far a source is preferred, before bonus and penalty."""
    little = appearances < MIN_EVIDENCE
    rate = F.when(little, 0.50).otherwise(F.coalesce(confirmation, F.lit(UNPROVEN_RATE)))
    return 0.50 * rate + 0.35 * F.when(little, 0.50).otherwise(independent) + 0.15 * attribution


def solo_ratio(solo: Column, independent_n: Column) -> Column:
    return F.coalesce(F.try_divide(solo, independent_n), F.lit(0.0))


def preference_adjusted(raw: Column, confirmation: Column, independent: Column, solo_share: Column) -> Column:
    bonus = F.when((F.coalesce(confirmation, F.lit(0.0)) >= 0.70) & (independent >= 0.60), raw * CORROBORATOR_BONUS).otherwise(raw)
    return F.when(solo_share > SOLO_SHARE, bonus * SOLO_FACTOR).otherwise(bonus)


def group_weight(reputation: Column) -> Column:
    return GROUP_FLOOR + (1 - GROUP_FLOOR) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(reputation, F.lit(NEUTRAL_REPUTATION))))


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "established").when(score >= 65, "corroborated").when(score >= 45, "developing").when(score >= 25, "thin").otherwise("single")


def source_tier(reputation: Column, cold_start: Column) -> Column:
    """Standing of a source in words; without outcomes it is not yet rated."""
    return (
        F.when(cold_start, "not yet rated")
        .when(reputation >= 0.85, "highly reliable")
        .when(reputation >= 0.7, "generally reliable")
        .when(reputation >= 0.5, "mixed reliability")
        .when(reputation >= 0.3, "generally unreliable")
        .otherwise("unreliable")
    )


def freshness(age_s: Column) -> Column:
    return F.when(age_s.isNull(), "never").when(age_s < 3600, "fresh").when(age_s < 86400, "stale").otherwise("stalled")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamped_preference(base: Column, proposed: Column, reach: float = 0.30) -> Column:
    """A proposal within reach of the base and within [0, 1]."""
    return F.round(F.greatest(base - reach, F.least(base + reach, clamp(proposed))), 4)


def arbitrate(grounding_a: Column, confidence_a: Column, grounding_b: Column, confidence_b: Column, margin: float = 0.2) -> Column:
    """Which of two contradicting claims loses: the worse grounded, else the clearly less confident; null if neither."""
    rank = lambda g: F.when(g == "supported", 2).when(g == "not_addressed", 0).when(g == "contradicted", -1).otherwise(1)
    a, b = rank(grounding_a), rank(grounding_b)
    return (
        F.when(a < b, "a").when(b < a, "b").when(confidence_b - confidence_a >= margin, "a").when(confidence_a - confidence_b >= margin, "b")
    )


def cap_status(today: Column, cap: Column) -> Column:
    """Whether a run may start under a daily cap; a cap of 0 or less is none."""
    capped = cap > 0
    return F.struct(
        (~capped | (today < cap)).alias("allowed"),
        F.round(today, 4).alias("today_usd"),
        F.when(capped, F.round(cap, 4)).alias("cap_usd"),
        F.when(capped, F.round(F.greatest(F.lit(0.0), cap - today), 4)).alias("remaining_usd"),
        capped.alias("capped"),
    )


def novelty(seen_at: Column, now: Column, keep_s: float = 30 * 86400.0) -> Column:
    """1 if never seen, or seen longer ago than keep_s; else 0."""
    return F.when(seen_at.isNull() | (now - seen_at > keep_s), 1).otherwise(0)


def passes_gate(spine_a: Column, spine_b: Column, ts_a: Column, ts_b: Column, tau: float = 0.40, window_s: float = 72 * 3600.0) -> Column:
    """Two stories may belong together: enough common entities, close enough in time."""
    from tessera.functions.vectors import jaccard

    return (jaccard(spine_a, spine_b) >= tau) & F.arrays_overlap(spine_a, spine_b) & (F.abs(ts_a - ts_b) <= window_s)
