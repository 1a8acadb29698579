"""Small column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def clamp(x: Column, lo, hi) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.least(x, F.lit(hi) if not isinstance(hi, Column) else hi), F.lit(lo) if not isinstance(lo, Column) else lo))


def round_to_level(x: Column, lo: float = -2.0, hi: float = 1.0) -> Column:
    """Nearest whole number, halves to even, kept within the range of levels."""
    return clamp(F.rint(x), lo, hi)


def normal_name(x: Column, known: dict[str, str] | None = None, other: str | None = None) -> Column:
    """Lower case without blanks, underscores and dashes; then by a table of known names."""
    bare = F.lower(F.regexp_replace(x, r"[\s_-]", ""))
    if known is None:
        return bare
    return F.coalesce(F.create_map(*[F.lit(v) for v in chain.from_iterable(known.items())])[bare], F.lit(other))


def year_of_column(name: Column) -> Column:
    """The year in names such as x1850 or X1850; null for others."""
    return F.when(name.rlike("^[Xx]?[0-9]{4}$"), F.regexp_replace(name, "^[Xx]", "").cast("int"))


def month_of_column(name: Column) -> tuple[Column, Column]:
    """Year and month in names such as T_1850_01."""
    part = lambda k: F.regexp_extract(name, "^T_([0-9]{4})_([0-9]{2})$", k).cast("int")
    return part(1), part(2)


def p_value_text(p: Column) -> Column:
    """'< 2 × 10^-16', 'm × 10^e' below 0.0001, else four decimals."""
    e = F.floor(F.log10(p)).cast("int")
    small = F.concat(F.format_string("%.2f", p / F.pow(F.lit(10.0), e.cast("double"))), F.lit(" × 10^"), e.cast("string"))
    return F.when(p.isNull(), F.lit("")).when(p < 2e-16, F.lit("< 2 × 10^-16")).when(p < 1e-4, small).otherwise(F.format_string("%.4f", p))


def ranked_by(x: Column, levels: list[str]) -> Column:
    """Place of x in an explicit order, from 1; null for others."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), x)
    return F.when(place > 0, place)


def fixed(x: Column, decimals: int = 6) -> Column:
    """A portable rounding for comparison across engines: floor of the scaled value plus 0.501."""
    s = float(10**decimals)
    return F.floor(x * s + 0.501) / s


def fixed_sql(x: str, decimals: int = 6) -> str:
    s = f"{float(10**decimals):.1f}"
    return f"floor(({x}) * {s} + 0.501) / {s}"
