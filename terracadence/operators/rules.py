"""Row rules that give structs (G-01 to G-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clip, finite
from ..functions.texts import reasons



def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _changes(value: Column, delta: Column, drop: Column, nbr_delta: Column, bais2_delta: Column) -> dict[str, Column]:
    big_drop, sharp = _holds(drop <= -0.25), _holds(delta <= -0.2)
    fell = big_drop | sharp
    grown = ~fell & _holds(delta >= 0.12) & _holds(value >= 0.3)
    stands = ~fell & ~grown & _holds(value >= 0.55) & (delta.isNull() | _holds(delta > -0.15))
    return {"big_drop": big_drop, "sharp": sharp, "fell": fell, "nbr": _holds(nbr_delta <= -0.15), "bais": _holds(bais2_delta >= 0.1), "grown": grown, "stands": stands}


def status_and_band(value: Column, delta: Column, drop: Column, nbr_delta: Column, bais2_delta: Column) -> tuple[Column, Column]:
    """G-01 as two plain columns of finite numbers."""
    x = _changes(value, delta, drop, nbr_delta, bais2_delta)
    status = F.when(value.isNull(), None).when(x["fell"] & x["nbr"] & x["bais"], "BURNT").when(x["fell"], "HARVESTED").when(x["grown"], "SOWN").when(x["stands"], "STANDING")
    return status, F.when(value.isNotNull() & x["fell"] & x["nbr"], "MODERATE").otherwise("LOW")


def status_evidence(value: Column, delta: Column, drop: Column, nbr_delta: Column, bais2_delta: Column, recent_fire: Column) -> Column:
    """G-01: what the status rests on. A description, never ground truth."""
    known, x = value.isNotNull(), _changes(value, delta, drop, nbr_delta, bais2_delta)
    return reasons([
        (~known, "index unavailable"), (known & x["big_drop"], "far below the peak so far"), (known & x["sharp"], "sharp fall since the last observation"),
        (known & x["nbr"], "burn ratio fell"), (known & x["bais"], "burned-area index rose"), (known & _holds(recent_fire), "recent fire nearby (supporting only)"),
        (known & x["grown"], "index rose"), (known & x["stands"], "index high and steady"), (known & ~x["fell"] & ~x["grown"] & ~x["stands"], "not enough evidence"),
    ])


def status_candidate(value: Column, delta: Column, drop: Column, nbr_delta: Column, bais2_delta: Column, recent_fire: Column) -> Column:
    """G-01: struct of status, band and evidence, whatever the numbers hold."""
    clean = [finite(x) for x in (value, delta, drop, nbr_delta, bais2_delta)]
    status, band = status_and_band(*clean)
    return F.struct(status.alias("status"), band.alias("band"), status_evidence(*clean, recent_fire).alias("evidence"))


def straw_estimate(status: Column, band: Column, area: Column, peak: Column, per_ha: float = 6.0, reference: float = 0.75, coefficient: float = 0.25, low: float = 0.85, high: float = 1.10, spread: float = 0.30) -> Column:
    """G-02: struct of state, baseline, factor, estimate, lower, upper; numbers only for a credible harvest with a positive area."""
    area, peak = finite(area), finite(peak)
    credible = _holds((status == "HARVESTED") & band.isin("MODERATE", "HIGH"))
    ok = credible & _holds(area > 0)
    state = F.when(ok, "PRELIMINARY_ESTIMATE").when(credible, "INSUFFICIENT_INPUT").otherwise("NOT_ELIGIBLE")
    factor = F.coalesce(clip(1 + coefficient * (peak - reference), low, high), F.lit(1.0))
    base = area * per_ha
    return F.struct(state.alias("state"), *[F.when(ok, x).alias(n) for n, x in (("baseline_t", base), ("factor", factor), ("estimate_t", base * factor), ("lower_t", base * factor * (1 - spread)), ("upper_t", base * factor * (1 + spread)))])


# Weights of the components, in the published order, and upper limits of the levels.
RISK_WEIGHTS = {
    "time_pressure": 0.25, "dry_weather": 0.20, "forecast_dryness": 0.15, "low_humidity": 0.10, "historical_burn_tendency": 0.15,
    "baler_access": 0.05, "buyer_access": 0.02, "straw_volume": 0.04, "nearby_fire_activity": 0.04,
}
RISK_LEVELS = (("LOW", 0.25), ("MEDIUM", 0.50), ("HIGH", 0.75))
RISK_LIMITS = {"days": 10.0, "rain": 12.0, "forecast": 12.0, "baler": 20_000.0, "buyer": 50_000.0, "straw": 20.0}


def risk_components(days_since_harvest: Column, harvest_state: Column, rain_72h: Column, forecast_rain: Column, forecast_known: Column, humidity: Column, baler_m: Column, buyer_m: Column, burn_rate: Column, straw_t: Column, fire: Column) -> dict[str, Column]:
    """G-03: the components in [0, 1], NULL where their input is missing or not admissible."""
    dated = F.when(harvest_state.isin("CONFIRMED", "MODEL_INFERRED", "RULE_CANDIDATE") & (days_since_harvest >= 0), finite(days_since_harvest))
    raw = {
        "time_pressure": dated / RISK_LIMITS["days"],
        "dry_weather": 1 - finite(rain_72h) / RISK_LIMITS["rain"],
        "forecast_dryness": F.when(_holds(forecast_known), 1 - finite(forecast_rain) / RISK_LIMITS["forecast"]),
        "low_humidity": (100 - finite(humidity)) / 100,
        "historical_burn_tendency": finite(burn_rate),
        "baler_access": finite(baler_m) / RISK_LIMITS["baler"],
        "buyer_access": finite(buyer_m) / RISK_LIMITS["buyer"],
        "straw_volume": finite(straw_t) / RISK_LIMITS["straw"],
        "nearby_fire_activity": fire.cast("double"),
    }
    return {k: clip(v, 0.0, 1.0) for k, v in raw.items()}


def risk_total(components: dict[str, Column], weights: dict[str, float] = RISK_WEIGHTS) -> Column:
    """G-03: the score alone, weights renormalised over the components that are there."""
    known = {k: w for k, w in weights.items() if k in components}
    weight, total = F.lit(0.0), F.lit(0.0)
    for k, w in known.items():
        weight = weight + F.when(components[k].isNotNull(), w).otherwise(0.0)
        total = total + F.coalesce(components[k] * w, F.lit(0.0))
    return F.try_divide(total, F.when(weight > 0, weight))


def risk_level(score: Column) -> Column:
    """G-03: LOW to CRITICAL by the upper limits of the levels."""
    level = F.when(score.isNull(), "INSUFFICIENT_DATA")
    for name, limit in RISK_LEVELS:
        level = level.when(score < limit, name)
    return level.otherwise("CRITICAL")


def top_factors(components: dict[str, Column], weights: dict[str, float] = RISK_WEIGHTS, top: int = 3) -> Column:
    """T-06: names of the components that weigh most, ties by name."""
    parts = F.array(*[F.when(components[k].isNotNull(), F.struct((-(components[k] * w)).alias("k"), F.lit(k).alias("name"))) for k, w in weights.items() if k in components])
    return F.transform(F.slice(F.sort_array(F.array_compact(parts)), 1, top), lambda p: p["name"])


def risk_score(components: dict[str, Column], weights: dict[str, float] = RISK_WEIGHTS, top: int = 3) -> Column:
    """G-03, T-06: struct of score, level and the top weighted factors."""
    score = risk_total(components, weights)
    return F.struct(score.alias("score"), risk_level(score).alias("level"), top_factors(components, weights, top).alias("top"))


def forecast_admissible(issued: Column, observed: Column) -> Column:
    """G-04: a forecast counts only if it was issued by the time of the observation."""
    return _holds(issued <= observed)


def agreed_candidate(sparse_label: Column, dense_label: Column, dense_date: Column, index_label: Column, index_date: Column) -> Column:
    """G-06: the sparse label if there is one; else the dense and the index rule must say the same of the same date."""
    both = _holds((dense_label == index_label) & (dense_date == index_date))
    return F.coalesce(F.when(sparse_label != "UNKNOWN", sparse_label), F.when(both, dense_label))


def suitability_group(n_usable: Column, has_harvest: Column, has_burn: Column, largest_gap: Column) -> Column:
    """G-07: A (both events, dense series) to E (too few usable observations)."""
    return (
        F.when(_holds(n_usable < 3), "E").when(_holds(has_harvest) & _holds(has_burn) & _holds(largest_gap <= 14), "A")
        .when(_holds(has_harvest) & _holds(has_burn), "B").when(_holds(has_harvest), "C").otherwise("D")
    )


def eligibility(latitude: Column, longitude: Column, status: Column, evidence: Column, confidence: Column, source: Column, straw: Column, quality: Column, weather: Column, score: Column, unknown_weather: str = "WARN", accepted: tuple[str, ...] = ("GOOD",), high_risk_only: bool = False) -> Column:
    """G-08: struct of eligible, reasons and warnings; unknown_weather is BLOCK, WARN or PERMIT."""
    if unknown_weather not in ("BLOCK", "WARN", "PERMIT"):
        raise ValueError(f"unknown policy {unknown_weather}")
    credible = _holds(F.upper(status).isin("HARVESTED", "HARVESTED_CANDIDATE")) & _holds(F.upper(evidence).isin("CANDIDATE", "SUPPORTED", "CONFIRMED")) & _holds(F.upper(confidence).isin("MODERATE", "HIGH", "VALIDATED"))
    unknown = _holds(weather == "UNKNOWN")
    why = reasons([
        (latitude.isNull() | longitude.isNull(), "INVALID_LOCATION"), (~credible, "HARVEST_EVIDENCE_INSUFFICIENT"),
        (_holds(F.upper(source).isin("SYNTHETIC_TEST_MODEL", "SYNTHETIC_MODEL")), "UNTRUSTED_SYNTHETIC_MODEL"), (~_holds(straw > 0), "NO_POSITIVE_STRAW_ESTIMATE"),
        (~_holds(quality.isin(*accepted)), "OBSERVATION_QUALITY_UNACCEPTABLE"), (_holds(weather == "UNSUITABLE"), "WEATHER_UNSUITABLE"),
        (unknown & F.lit(unknown_weather == "BLOCK"), "WEATHER_UNKNOWN_BLOCKED_BY_POLICY"), (F.lit(high_risk_only) & ~_holds(score >= 0.6), "HIGH_RISK_PRIORITY_FILTER"),
    ])
    warn = reasons([(unknown & F.lit(unknown_weather == "WARN"), "WEATHER_UNKNOWN")])
    return F.struct((F.size(why) == 0).alias("eligible"), why.alias("reasons"), warn.alias("warnings"))


def burn_evidence(quality: Column, nbr: Column, bais2: Column, ndvi: Column, fire: Column) -> Column:
    """G-09: STRONG with all three strong changes, MODERATE with two moderate ones, NO_BURN without any, else UNCLEAR; poor or empty observations are UNCLEAR."""
    count = lambda a, b, c: sum(_holds(x).cast("int") for x in (nbr <= a, bais2 >= b, ndvi <= c))
    strong, moderate = count(-0.20, 0.12, -0.20), count(-0.15, 0.10, -0.15)
    blind = ~_holds(F.upper(quality) == "GOOD") | (nbr.isNull() & bais2.isNull() & ndvi.isNull())
    return F.when(blind, "UNCLEAR").when(strong == 3, "STRONG").when(moderate >= 2, "MODERATE").when(_holds(fire), "UNCLEAR").when(moderate == 0, "NO_BURN").otherwise("UNCLEAR")


def case_state(n: Column, strong: Column, doubtful: Column, span_days: Column, sown: Column, past_deadline: Column, closed: Column | None = None, least: int = 3, least_span: float = 20.0) -> Column:
    """G-10: state of a case from counts of its observations (n, strong, moderate or unclear), their span, a confident sowing and the deadline."""
    enough = (n >= least) & (span_days >= least_span)
    state = (
        F.when(F.coalesce(closed, F.lit(False)) if closed is not None else F.lit(False), "CLOSED").when(strong > 0, "BURN_SIGNAL_DETECTED").when(doubtful > 0, "MANUAL_REVIEW_REQUIRED")
        .when(enough & (_holds(past_deadline) | _holds(sown)), "NO_BURN_VERIFIED").when(_holds(past_deadline), "INSUFFICIENT_EVIDENCE")
    )
    return state.when(n > 0, "MONITORING").otherwise("INSUFFICIENT_EVIDENCE")


def paddy(low_db: Column, canopy_db: Column, low: float = -18.0, rise: float = 4.0) -> Column:
    """G-11: a flooded minimum followed by a rise."""
    return _holds((low_db <= low) & (canopy_db - low_db >= rise))


TRUST = ("VALIDATED_MODEL", "UNVALIDATED_MODEL", "SYNTHETIC_TEST_MODEL", "RULE_BASED_CANDIDATE")


def may_decide(trust: Column) -> Column:
    """G-14: only a validated model decides."""
    return _holds(trust == TRUST[0])


def certifiable(state: Column, n: Column) -> Column:
    """G-15."""
    return _holds((state == "NO_BURN_VERIFIED") & (n >= 1))


def policy_priority(policy: str, age: Column, area: Column, score: Column, dynamic: Column, burned: Column, days_left: Column, seed: int = 0, key: Column | None = None) -> Column:
    """G-13: daily priority of a field under a policy; the random one hashes the key."""
    return {
        "random": F.xxhash64(key if key is not None else F.lit(0), F.lit(seed)).cast("double"), "fifo": age, "largest_first": area, "risk": score + 1e-4 * age,
        "risk_urgency": score * (1 + age / 10), "dynamic": F.coalesce(dynamic, score * 1e-3) + 1e-4 * age,
        "oracle": F.when(burned, 1000 - F.coalesce(days_left, F.lit(999.0))).otherwise(age * 1e-3),
    }[policy]
