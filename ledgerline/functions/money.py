"""Scales of money amounts and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.labels import is_per_share_or_ratio

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Words for scales; the first that fits is it.
BILLION = "bn|billion|miljards?"
UNIT_MILLION = f"{_B}eurm{_E}|million|mln|milj|{_B}mn{_E}"
UNIT_THOUSAND = rf"thousand|tuhat|tūkst|tukst|tis\.?\s*eur|tk\.?\s*eur|{_B}k\s*eur|eur\s*k{_E}"
TEXT_MILLION = rf"million|mln|milj|eur\s*m|€\s*m|{_B}m\s*eur{_E}|{_B}mn{_E}"
TEXT_THOUSAND = rf"thousand|tuhat|tūkst|tukst|eur\s*k|€\s*k|{_B}k\s*eur{_E}"


def unit_multiplier(unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    tight = F.regexp_replace(u, r"\s+", "")
    short_million = tight.rlike(f"{_B}m{_E}") & tight.rlike(r"eur|€|usd|\$") & ~tight.rlike(f"thousand|k{_E}")
    return F.when(u == "", 1).when(u.rlike(BILLION), 1_000_000_000).when(tight.rlike(UNIT_MILLION) | short_million, 1_000_000).when(u.rlike(UNIT_THOUSAND), 1_000).otherwise(1)


def evidence_multiplier(snippet: Column, rationale: Column | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", F.nullif(snippet, F.lit("")), F.nullif(rationale, F.lit("")) if rationale is not None else F.lit(None).cast("string")))
    return F.when(text.rlike(BILLION), 1_000_000_000).when(text.rlike(TEXT_MILLION), 1_000_000).when(text.rlike(TEXT_THOUSAND), 1_000).otherwise(1)


def is_plain_euro(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"\s+", "").isin("", "eur", "€", "euro")


def by_unit(value: Column, unit: Column, label: Column) -> Column:
    """The amount in whole euro as its unit says; figures per share and ratios stay."""
    return F.when(F.coalesce(is_per_share_or_ratio(label), F.lit(False)) | ~is_finite(value), value).otherwise(value * unit_multiplier(unit))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def change(now: Column, before: Column) -> Column:
    """Per cent of the amount before; null without one or if it is 0."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds half up, also negative numbers (-0.5 to 0)."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def fixed(value: Column, digits: int) -> Column:
    """With so many decimals, half away from zero."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.signum(value) * half_up(F.abs(value), digits)))


def grouped(value: Column, digits: int = 2) -> Column:
    """1,234.5: with thousands commas, up to so many decimals, half away from zero."""
    text = F.format_string(f"%,.{digits}f", F.signum(value) * half_up(F.abs(value), digits))
    return F.when(value.isNotNull(), F.regexp_replace(text, r"\.?0+$", "") if digits else text)


def _short(value: Column, billions: int, millions: int, small: Column) -> Column:
    size = F.abs(value)
    return F.when(size >= 1e9, F.concat(fixed(value / 1e9, billions), F.lit("B"))).when(size >= 1e6, F.concat(fixed(value / 1e6, millions), F.lit("M"))).when(size >= 1e3, F.concat(fixed(value / 1e3, 0), F.lit("K"))).otherwise(small)


def plain_number(value: Column) -> Column:
    """As few digits as tell the number."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def compact_euro(value: Column, billions: int = 1, millions: int = 0) -> Column:
    """€1.2B, €34M, €56K, €7.25, or a dash; small values keep all their digits."""
    return F.coalesce(F.concat(F.lit("€"), _short(value, billions, millions, plain_number(value))), F.lit("—"))


def axis_number(value: Column) -> Column:
    """1.2B, 3.4M, 56K, 7.25, as on the axis of a chart."""
    return _short(value, 1, 1, plain_number(value))


def metric_text(value: Column, unit: Column) -> Column:
    """A metric's value with its unit: amounts of money as €1.23B, €3.4M, €56K or €7.25, others as 1,234.5 and the unit, or a dash."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    money = F.concat(F.lit("€"), _short(value, 2, 1, grouped(value, 3)))
    other = F.when(u == "", grouped(value)).otherwise(F.concat(grouped(value), F.lit(" "), u))
    return F.coalesce(F.when(F.lower(u).rlike(r"€|eur|usd|\$"), money).otherwise(other), F.lit("—"))


def signed_percent(value: Column) -> Column:
    """+12.3% or -4.0%."""
    return F.concat(F.when(value > 0, "+").otherwise(""), fixed(value, 1), F.lit("%"))


def share_percent(value: Column) -> Column:
    """12.3% from ten on, else 1.23%."""
    return F.concat(F.when(value >= 10, fixed(value, 1)).otherwise(fixed(value, 2)), F.lit("%"))


def delta(a: Column, b: Column, higher_better: Column) -> Column:
    """struct(absolute, percent, favorable) of b against a."""
    d = b - a
    favorable = F.when(d != 0, F.when(higher_better, d > 0).otherwise(d < 0))
    return F.struct(d.alias("absolute"), F.when(a != 0, d / F.abs(a) * 100).alias("percent"), favorable.alias("favorable"))


def clamp(value: Column, low: float, high: float) -> Column:
    """Null if it is no finite number."""
    return F.when(is_finite(value), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def parse_amount(text: Column) -> Column:
    """A double of "1,200"; null of per cents and anything else."""
    s = F.trim(text)
    return F.when((s != "") & ~F.contains(s, F.lit("%")), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
