"""Scalar building blocks; each returns a Column unless it says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monday first.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAYS_ES = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(now: Column, before: Column) -> Column:
    return divide(now, before) - 1


def log_change(now: Column, before: Column) -> Column:
    ratio = divide(now, before)
    return F.when(ratio > 0, F.ln(ratio))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clipped(signal: Column) -> Column:
    """A signal as a position between 0 and 1, null as 0."""
    return F.least(F.greatest(F.coalesce(signal.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0, null too."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def weekday(ts: Column) -> Column:
    return F.weekday(ts)


def shifted_weekday(ts: Column, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return F.weekday(ts + F.make_interval(hours=hours))


def day_name(number: Column, names: tuple[str, ...] = DAYS) -> Column:
    return F.try_element_at(F.array(*[F.lit(d) for d in names]), (number + 1).cast("int"))


def percent(x: Column, digits: int = 2, half_even: bool = False) -> Column:
    return (F.bround if half_even else F.round)(x * 100, digits)


def formatted_percent(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x * 100)).otherwise(F.lit("N/A"))


def formatted_number(x: Column, digits: int = 4) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%,.{digits}f", x)).otherwise(F.lit("N/A"))


def params_json(params: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def json_params(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in order, joined by "; "; a null condition does not hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), "; ")


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def epoch_to_timestamp(x: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by their size; smaller numbers are null."""
    n = F.abs(x)
    micros = (
        F.when(n >= F.lit(10**17), F.floor(x / 1000))
        .when(n >= F.lit(10**14), x)
        .when(n >= F.lit(10**11), x * 1000)
        .when(n >= F.lit(10**8), x * 1_000_000)
    )
    return F.timestamp_micros(micros.cast("long"))


#: Bars a year of one unit of an interval text.
_A_YEAR = {"s": 365.0 * 86_400, "m": 365.0 * 1440, "h": 365.0 * 24, "d": 365.0, "w": 52.1775, "mo": 12.0}


def bars_a_year(interval: str) -> float | None:
    """Bars a year of "1s", "15m", "4h", "3d", "1w" or "1mo"; None for other texts.  A plain number."""
    m = re.fullmatch(r"([0-9.]+)(mo|[smhdw])", interval.strip().lower())
    try:
        return _A_YEAR[m[2]] / float(m[1]) if m else None
    except (ValueError, ZeroDivisionError):
        return None
