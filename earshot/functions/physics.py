"""Sound, radio and score formulas."""

from __future__ import annotations

from pyspark.sql import functions as F


def speed_of_sound(temperature_c, humidity_fraction) -> F.Column:
    return F.lit(331.3) + F.lit(0.606) * temperature_c + F.lit(0.0124) * (humidity_fraction * 100.0)


def rssi_to_range(rssi, at_1m: float = -59.0, exponent: float = 2.0) -> F.Column:
    """Log-distance path loss, between 0.25 and 1,000 m."""
    return F.least(F.greatest(F.pow(F.lit(10.0), (F.lit(at_1m) - rssi) / (10.0 * exponent)), F.lit(0.25)), F.lit(1000.0))


def level_db(rms, gain_db: float = 0.0) -> F.Column:
    return F.lit(20.0) * F.log10(F.greatest(rms, F.lit(1e-9))) + gain_db


def capability_tier(sensors) -> F.Column:
    return F.when(sensors >= 4, "full_3d").when(sensors >= 3, "bearing_2d").when(sensors >= 1, "class_only").otherwise("alert_only")


def finite(x) -> F.Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)



def amplitude_range(level, reference: float, least: float, most: float) -> tuple[F.Column, F.Column]:
    """Distance from a level by spherical spreading, and whether it had to be drawn into the given band."""
    raw = F.pow(F.lit(10.0), (F.lit(reference) - level) / 20.0)
    known = ~(F.isnan(level) | (F.abs(level) == float("inf")))
    return F.when(known, F.least(F.greatest(raw, F.lit(least)), F.lit(most))).otherwise(F.lit(least)), F.when(known, (raw < least) | (raw > most)).otherwise(F.lit(True))
