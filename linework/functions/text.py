"""Reading annotation texts: classes, numbers, tolerances, pairs and noise as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.functions.geometry import rounded

# Fixed values of the drawing rules.
OPERATORS = ("±", "+", "-", "−")
STANDARD_TOLERANCES = (0.1, 0.2, 0.25, 0.5, 0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0)
LARGEST_TOLERANCE, LARGEST_SHARE = 10.0, 0.5
QUANTITY_WORDS = ("nos", "no.", "pcs", "pc", "qty", "quantity", "holes", "hole", "slots", "slot", "off", "ea", "each", "places", "place")
ORPHANS = ("THK", "±", "+", "-", "REF")
HORIZONTAL = ("horizontal", "unresolved_horizontal_fragment", "rotated")
VERTICAL = ("vertical", "unresolved_vertical_fragment")
NOISE = (
    r"^\d{1,2}[./](\d{1,2}[./]\d{2,4}|\d{2})$",  # a date
    r"^(\d{5,}|0\d+)$",  # a part's number
    r"^\d+[A-Za-z]{1,4}$",  # a number with a unit
    r"^([^(]*\(|\d+\.)$",  # cut short
)
FAR, WEAK = 18.0, 12.0
LEAST_CONFIDENCE = 0.35

_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_NUMBER = r"^(\d+\.?\d*|\.\d+)$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _BLANK, "")


def to_double(text: Column) -> Column:
    """A plain decimal number, else null (no exponents, suffixes or signs)."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def is_tolerance_modifier(text: Column) -> Column:
    return strip(text).startswith("±")


def is_operator(text: Column) -> Column:
    return strip(text).isin(*OPERATORS)


def is_nominal(text: Column) -> Column:
    return ~is_tolerance_modifier(text) & text.rlike(r"(?iu)^R\s*\d|^Ø\s*\d|^\d|°|THK|\d+\.\d+")


def is_dimension(text: Column) -> Column:
    return is_nominal(text) | is_tolerance_modifier(text)


def is_number_token(text: Column) -> Column:
    return strip(text).rlike(r"^[\d.]+$")


def lexeme(text: Column) -> Column:
    """operator, number, fused_tolerance, nominal or other."""
    return F.when(is_operator(text), "operator").when(is_number_token(text), "number").when(strip(text).contains("±"), "fused_tolerance").when(is_nominal(strip(text)), "nominal").otherwise("other")


def entity_type(text: Column) -> Column:
    t = F.upper(strip(text))
    kind = F.when(t.rlike(r"^R\s*\d"), "radius").when(t.contains("Ø") | t.rlike(r"^O\s*\d"), "diameter").when(t.contains("°"), "angular").when(t.contains("THK"), "thickness").when(t.contains("(REF)"), "reference").otherwise("linear")
    return F.concat(kind, F.lit("_dimension"))


def tolerance_text(text: Column) -> Column:
    """The digits after the first ±, else null."""
    found = F.regexp_extract(text, r"±\s*([\d.]+)", 1)
    return F.when(found != "", found)


def parse_tolerance(text: Column) -> Column:
    """The value after the first ±; null without one or if it is no number."""
    return to_double(tolerance_text(text))


def nominal_text(text: Column) -> Column:
    """The text without tolerances and a leading R or Ø."""
    return strip(F.regexp_replace(strip(F.regexp_replace(text, r"±\s*[\d.]+", "")), r"(?iu)^[RØ]\s*", ""))


def parse_nominal(text: Column) -> Column:
    return to_double(F.regexp_extract(nominal_text(text), r"([\d.]+)", 1))


def short_number(value: Column) -> Column:
    """Whole numbers without a point, others with up to four places; null is empty."""
    whole = F.abs(value - F.rint(value)) < 1e-6
    return F.when(value.isNull(), "").when(whole, F.rint(value).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", ""))


def plain_number(value: Column) -> Column:
    """A number as its shortest decimal text with a point, never with an exponent (0.2, 1.0, 0.0005)."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value), r"0+$", ""), r"\.$", ".0")
    return F.when(value.isNotNull(), text)


def limits(nominal: Column, tolerance: Column) -> Column:
    """struct(min, max), null if either is missing."""
    return F.when(nominal.isNotNull() & tolerance.isNotNull(), F.struct(rounded(nominal - tolerance, 6).alias("min"), rounded(nominal + tolerance, 6).alias("max")))


def has_decimals(value: Column) -> Column:
    return F.abs(value - F.rint(value)) > 1e-6


def plausible_pair(left: Column, right: Column, tail: Column) -> Column:
    """A side of 10 or more, a decimal side, or an angle in the tail."""
    return strip(tail).contains("°") | (left >= 10) | (right >= 10) | has_decimals(left) | has_decimals(right)


def valid_pair(left: Column, right: Column, right_text: Column, tail: Column) -> Column:
    """A plausible pair A X B whose right side and tail are a dimension, not a quantity or thread."""
    t = strip(tail)
    both = F.lower(F.concat(right_text, t))
    counted = both.rlike("|".join(map(re.escape, QUANTITY_WORDS)))
    letters = F.regexp_replace(t, r"[\d.\s()°±\-+]", "") != ""
    return F.coalesce(plausible_pair(left, right, t) & ~counted & ~both.contains("ø") & ~both.rlike(r"(?i)\bM\d") & right_text.rlike(r"^\d") & ~letters, F.lit(False))


#: Pairs of so few glyphs need a side that is plausible by itself.
FEW_GLYPHS = 4


def pair_may_form(left: Column, right: Column, right_text: Column, tail: Column, orientation: Column, glyphs: Column | None = None) -> Column:
    """A valid pair that isn't a loose fragment; of few glyphs (where they are counted) only with a side
    of 10 or more or a decimal one, whatever its tail."""
    fits = ~F.coalesce(orientation.startswith("unresolved"), F.lit(False)) & valid_pair(left, right, right_text, tail)
    if glyphs is not None:
        fits &= ~F.coalesce((glyphs <= FEW_GLYPHS) & ~plausible_pair(left, right, F.lit("")), F.lit(False))
    return fits


def valid_tolerance(value: Column) -> Column:
    t = F.abs(value)
    standard = reduce(or_, (F.abs(t - s) < 0.02 for s in STANDARD_TOLERANCES))  # no lambda: those aren't compiled, nor is what they read
    small = (t < 1) & (F.abs(t - rounded(t, 2)) < 0.001)
    whole = t.between(1, 4) & (F.abs(t - F.rint(t)) < 0.001)
    return (t <= LARGEST_TOLERANCE) & (standard | small | whole)


def tolerance_fits(nominal: Column, tolerance: Column) -> Column:
    """No tolerance fits; one fits if it is valid and at most half of a nominal that isn't 0."""
    n, t = F.abs(nominal), F.abs(tolerance)
    return tolerance.isNull() | (valid_tolerance(tolerance) & (nominal.isNull() | (n == 0) | ((t < n) & (t <= LARGEST_SHARE * n))))


def same_reading(a: Column, b: Column) -> Column:
    """Equal orientations (none counts as one) or two of one family."""
    return reading_family(a).eqNullSafe(reading_family(b))


def reading_family(orientation: Column) -> Column:
    """One name for the orientations that read alike; others stand for themselves."""
    return F.when(orientation.isin(*HORIZONTAL), HORIZONTAL[0]).when(orientation.isin(*VERTICAL), VERTICAL[0]).otherwise(orientation)


def reading_direction(axis: Column) -> Column:
    return F.when(axis == "vertical", "bottom_to_top").when(axis == "angled", "along_vector").otherwise("left_to_right")


def is_noise(text: Column) -> Column:
    """Dates, part numbers, cut-off texts, numbers with a unit and the like."""
    t = strip(F.coalesce(text, F.lit("")))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (t == "") | t.rlike("|".join(NOISE)) | ((F.length(t) >= 7) & (digits / F.length(t) > 0.85))


def is_orphan(text: Column) -> Column:
    return F.upper(strip(F.coalesce(text, F.lit("")))).isin(*ORPHANS)


def mostly_digits(text: Column) -> Column:
    """Six digits in ten, or a dimension's mark."""
    t = strip(text)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (t != "") & ((digits >= 0.6 * F.length(t)) | t.rlike(r"(?iu)^[RØ±]|THK|°"))


def in_margin(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Title block, revision strip and sheet edge."""
    return (y > height * 0.86) | ((x > width * 0.60) & (y > height * 0.68)) | (y < height * 0.05)


def confidence(kind: Column, orientation: Column, glyphs: Column, gap: Column, rebuilt: Column) -> Column:
    """The export score: a product of what speaks against an entity, to three places.

    gap is the distance from the nearest drawing, null where none was looked for.
    """
    n = F.coalesce(glyphs, F.lit(0))
    score = F.when(F.coalesce(rebuilt, F.lit(False)), 0.92).otherwise(1.0)
    score *= F.when(n <= 1, 0.45).when(n <= 2, 0.65).otherwise(1.0)
    score *= F.when(gap > FAR, 0.35).when(gap > WEAK, 0.75).otherwise(1.0)
    score *= F.when((kind == "SRC_dimension") & (gap > WEAK), 0.55).otherwise(1.0)
    score *= F.when(orientation == "isolated_glyph", 0.4).otherwise(1.0)
    return F.when(orientation.startswith("unresolved"), 0.0).otherwise(rounded(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3))


def pair_confidence(gap: Column, most: float) -> Column:
    """The score of a pair when it forms; the export score replaces it."""
    return rounded(F.greatest(F.lit(0.55), F.lit(1.0) - gap / most * 0.35), 3)
