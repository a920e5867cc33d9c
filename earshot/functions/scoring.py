"""Scores and gates of single rows: significance, track quality, range modes, display modes, tiers, health verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Weights of significance, scores of capability tiers, decibels of full signal excess, sensors of full corroboration.
WEIGHTS = {"track_affinity": 0.35, "localization_confidence": 0.25, "capability_tier": 0.15, "signal_excess": 0.15, "corroboration": 0.10}
TIER_SCORES = {"full_3d": 1.0, "2d": 0.6, "classification_only": 0.3, "alerting_only": 0.1}
EXCESS_DB, FULL_SENSORS = 18.0, 4.0
#: Older names of range modes; caps of (confidence, observability) by mode; least observability that is drawn as a place.
MODE_ALIASES = {"prior_projected": "range_asymptotic", "bounded_grid_boundary": "range_boundary"}
MODE_CAPS = {"range_asymptotic": (0.20, 0.05), "range_boundary": (0.20, 0.05), "range_bearing_projected": (0.85, 0.05)}
WEAK_OBSERVABILITY = 0.10
#: Weight by how well clocks agree.
SYNC_GRADES = {"gps_locked": "gps_pps", "gps_holdover": "gps_pps", "ntp_disciplined": "ntp", "ntp_sync": "ntp"}
SYNC_WEIGHTS = {"gps_pps": 1.0, "ptp": 1.0, "ntp": 0.25, "free": 0.05}


def looked_up(column, table: dict, other) -> F.Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def clamp(x, low: float = 0.0, high: float = 1.0) -> F.Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def signal_excess(rms, trigger) -> F.Column:
    """Level over the trigger, as a share of 18 dB."""
    loud = (rms > 0) & (trigger > 0)
    return F.when(loud, clamp(20.0 * F.log10(rms / trigger) / EXCESS_DB)).otherwise(F.lit(0.0))


def corroboration(sensors) -> F.Column:
    return clamp((sensors - 1) / F.lit(FULL_SENSORS - 1))


def affinity(distance_m, radius_m: float) -> F.Column:
    """1 on a track, 0 from ``radius_m`` on."""
    return F.coalesce(clamp(F.lit(1.0) - distance_m / F.lit(radius_m)), F.lit(0.0))


def significance(distance_m, confidence, tier, rms, trigger, sensors, degraded, radius_m: float = 50.0) -> F.Column:
    terms = {"track_affinity": affinity(distance_m, radius_m), "localization_confidence": clamp(F.coalesce(confidence, F.lit(0.0))), "capability_tier": looked_up(F.lower(tier), TIER_SCORES, 0.3), "signal_excess": signal_excess(rms, trigger), "corroboration": corroboration(sensors)}
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * terms[name]
    return clamp(F.when(degraded, total * 0.5).otherwise(total))


def priority_bucket(score, buckets: int = 10) -> F.Column:
    """Coarse significance: rows are then ordered by (bucket, time), both descending. Halves go to the even bucket."""
    return F.bround(clamp(score) * F.lit(float(buckets)), 0).cast("int")


def track_quality(confidence, updates, idle_seconds, sensors, nodes, weights=(0.3, 0.3, 0.2, 0.2)) -> F.Column:
    agreed = F.greatest(F.least(updates / F.lit(5.0), F.lit(1.0)), F.least(F.greatest(nodes - 1, F.lit(0)) / F.lit(1.0), F.lit(1.0)))
    recent = F.lit(1.0) / (F.lit(1.0) + idle_seconds / F.lit(30.0))
    return clamp(weights[0] * confidence + weights[1] * agreed + weights[2] * recent + weights[3] * F.least(sensors / F.lit(4.0), F.lit(1.0)))


def range_mode(mode) -> F.Column:
    return F.coalesce(looked_up(mode, MODE_ALIASES, None).cast("string"), mode)


def haircut(mode, confidence, observability) -> tuple[F.Column, F.Column]:
    """Confidence and observability, capped where the range can't be observed."""
    m = range_mode(mode)
    for name, (c, o) in MODE_CAPS.items():
        confidence = F.when(m == name, F.least(confidence, F.lit(c))).otherwise(confidence)
        observability = F.when((m == name) & observability.isNotNull(), F.least(observability, F.lit(o))).otherwise(observability)
    return confidence, observability


def display_mode(modality, mode, observability) -> F.Column:
    """How a detection is drawn: at its node, as a bearing, or at its place."""
    far = mode.isin("range_asymptotic", "range_boundary")
    return F.when(modality == "omni", "node_only").when(far, "bearing_only").when(mode == "range_bearing_projected", "localized").when(observability <= WEAK_OBSERVABILITY, "bearing_only").otherwise("localized")


def retention_tier(label, category, confidence, suppressed, permanent: tuple[str, ...], least: float) -> F.Column:
    return F.when(suppressed, "ephemeral").when(F.lower(F.trim(label)).isin(*permanent), "permanent").when((category == "security") & (confidence >= least), "long").otherwise("short")


def ingest_verdict(boot_changed, dropped, queue_depth, capacity, publish_errors, rssi, gaps, ratio: float = 0.95, weak_dbm: int = -75) -> F.Column:
    full = F.coalesce((capacity > 0) & (queue_depth >= F.floor(capacity * F.lit(ratio))), F.lit(False))
    weak = (publish_errors > 0) | F.coalesce(rssi <= weak_dbm, F.lit(False))
    return F.when(boot_changed, "NODE_RESTARTED").when((dropped > 0) | full, "LOSSY_RATE_LIMITED").when(weak, "LOSSY_WIFI").when(gaps > 0, "SERVER_GAP_ONLY").otherwise("HEALTHY")


def link_state(age_seconds, failures, timeout: float) -> F.Column:
    return F.when(age_seconds.isNull(), "offline").when((age_seconds <= timeout) & (failures <= 1), "active").when(age_seconds <= 2 * timeout, "degraded").otherwise("offline")


def reportable(x, y, z, cx, cy, cz, most_m: float, backstop_m: float) -> F.Column:
    """Whether a place is finite, within the backstop of the origin, and within reach of the sensors."""
    far = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))
    origin = F.sqrt(x * x + y * y + z * z)
    finite = ~(F.isnan(origin) | (origin == float("inf")))
    return F.coalesce(finite & (origin <= backstop_m) & ((F.lit(most_m) <= 0) | (far <= most_m)), F.lit(False))


def heuristic_scores(rms, centroid, crest, zcr, flatness, bandwidth) -> F.Column:
    """Scores by name of simple sounds from spectral features; limits are the defaults of the classifier's settings."""
    quiet, zero = rms < 0.01, F.lit(0.0)
    impulse = F.when(~quiet & (crest > 10.0) & (bandwidth > 1200.0), F.least(F.lit(0.95), 0.35 + crest / 25.0)).otherwise(zero)
    bird = F.when(~quiet & (centroid > 2200.0) & (zcr > 0.12), F.least(F.lit(0.95), 0.25 + centroid / 8000.0)).otherwise(zero)
    speech = F.when(~quiet & (centroid > 200.0) & (centroid < 2200.0) & (zcr > 0.04) & (zcr < 0.2) & (flatness < 0.75), F.least(F.lit(0.9), 0.25 + (1.0 - F.abs(centroid - 1000.0) / 1200.0))).otherwise(zero)
    hum = F.when(~quiet & (centroid < 450.0) & (flatness < 0.55), F.least(F.lit(0.9), 0.3 + (450.0 - centroid) / 700.0)).otherwise(zero)
    none = ~quiet & (F.greatest(impulse, bird, speech, hum) < 0.2)
    return F.create_map(F.lit("ambient"), F.when(quiet, 0.95).otherwise(zero), F.lit("bird_like"), bird, F.lit("speech_like"), speech, F.lit("impulse"), impulse, F.lit("machine_hum"), hum, F.lit("unknown"), F.when(none, 0.6).otherwise(zero))


def alike(a, b) -> F.Column:
    """Cosine of two maps of class scores, between 0 and 1; null where one is missing or empty."""
    add = lambda x, y: x + y
    zero = F.lit(0.0)
    dot = F.aggregate(F.transform(F.map_entries(a), lambda e: e.value * F.coalesce(F.try_element_at(b, e.key), zero)), zero, add)
    size = lambda m: F.aggregate(F.transform(F.map_values(m), lambda x: x * x), zero, add)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(F.least(F.coalesce(F.try_divide(dot, F.sqrt(size(a) * size(b))), zero), F.lit(1.0)), zero))
