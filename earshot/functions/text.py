"""Text: slugs, keyword categories, normalised sets."""

from __future__ import annotations

from pyspark.sql import functions as F


def slug(column, fallback: str = "unknown") -> F.Column:
    """Lower case; runs of anything but a-z and 0-9 become one "-", none at the ends; ``fallback`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", F.lit(fallback)).otherwise(F.coalesce(plain, F.lit(fallback)))


def first_containing(column, needles: dict[str, tuple[str, ...]], default: str) -> F.Column:
    """The first key, in order, of which a needle occurs in the column."""
    out = F.lit(default)
    for name, some in reversed(needles.items()):
        found = F.lit(False)
        for x in some:
            found = found | column.contains(x)
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def normal_set(column) -> F.Column:
    """Trimmed, lower case, distinct, without blanks."""
    return F.array_distinct(F.filter(F.transform(column, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def topic_slug(column, most: int = 48, tail: int = 6) -> F.Column:
    """Lower case with "_" between runs of a-z, 0-9 and "_"; what is too long or empty ends in a piece of the SHA-1 of the
    original, so that different ids stay different."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    mark = F.substring(F.sha1(column), 1, tail)
    short = F.concat(F.regexp_replace(F.substring(plain, 1, most - tail - 1), "_+$", ""), F.lit("_"), mark)
    return F.when(plain == "", F.concat(F.lit("x_"), mark)).when(F.length(plain) <= most, plain).otherwise(short)


def mac(column) -> F.Column:
    """Twelve hexadecimal digits as six pairs; anything else trimmed and in lower case."""
    digits = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), "[^0-9a-fA-F]", ""))
    pairs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2))), ":")
    return F.when(F.length(digits) == 12, pairs).otherwise(F.lower(F.trim(F.coalesce(column, F.lit("")))))


def common_name(column) -> F.Column:
    """What follows the first "_" of "Scientific_Common", else all; trimmed, lower case."""
    after = F.substring(column, F.instr(column, "_") + 1, F.length(column))
    return F.lower(F.trim(F.when(F.instr(column, "_") > 0, after).otherwise(column)))


#: Words in a label's name that tell its category, in order.
CATEGORY_WORDS = {
    "wildlife": ("bird", "wild", "animal", "canid", "feline", "dog", "cat", "hawk", "coyote"),
    "human": ("speech", "voice", "shout", "scream", "human", "talk"),
    "vehicle": ("engine", "machine", "car", "truck", "vehicle", "drone", "aircraft"),
    "security": ("gun", "glass", "alarm", "fire", "explosion", "impulse", "siren"),
}


def category_of(label) -> F.Column:
    return first_containing(F.lower(F.trim(label)), CATEGORY_WORDS, "unknown")
