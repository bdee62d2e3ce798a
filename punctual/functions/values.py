"""Number and text parsing, buckets, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.contracts import DEFAULT_MARKERS, PROMPT_FIELDS

#: Eighteen digits are the most that stay a plain number inside Spark: six decimals, and up to 10**12.
#: A larger value fails the job; a finer one has to bring its own type.
EXACT = "decimal(18,6)"


def to_number(c: Column) -> Column:
    """Double value; text that is no number and NaN become null."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def exact(c: Column, kind: str = EXACT) -> Column:
    """Exact value with six decimals, so that sums do not depend on row order."""
    return c.cast(kind)


def threshold_label(c: Column, limit: float = 15) -> Column:
    """1 at or above the limit; 0 below, for null and for NaN."""
    return F.coalesce((F.nanvl(c.cast("double"), F.lit(None).cast("double")) >= limit).cast("int"), F.lit(0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def interaction(amount: Column, flag: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0)) * flag


# --- comma-packed report fields -------------------------------------------------------
def compound_numeric(
    c: Column,
    part: int = 0,
    scale: float = 1.0,
    markers: Sequence[str] = DEFAULT_MARKERS,
    reference_compat: bool = False,
) -> Column:
    """Number in one part of a packed field; missing markers and absent parts are null.

    A marker may carry a sign.  ``reference_compat=True`` compares the text as it is, so
    that a signed marker such as ``+9999`` counts as a measurement.
    """
    text = F.trim(F.get(F.split(c, ","), part))
    seen = text if reference_compat else F.regexp_replace(text, r"^[+-]", "")
    return to_number(F.when(~seen.isin(*markers), text)) / scale


def compound_text(c: Column, part: int = 0, reference_compat: bool = False) -> Column:
    """Text in one part of a packed field.  In compat mode a null field gives an empty text."""
    source = F.coalesce(c, F.lit("")) if reference_compat else c
    return F.trim(F.get(F.split(source, ","), part))


def first_present(columns: Sequence[Column], kind: str = "double") -> Column:
    return F.coalesce(*columns) if columns else F.lit(None).cast(kind)


def relative_humidity(temp: Column, dew: Column) -> Column:
    """Percent, from temperature and dew point in Celsius (Magnus form), not clamped."""
    curve = lambda t: F.exp(F.lit(17.625) * t / (F.lit(243.04) + t))
    return F.lit(100.0) * (curve(dew) / curve(temp))


# --- buckets --------------------------------------------------------------------------
# fixed values: amount classes, closed on the right
AMOUNT_BUCKETS = [("0", -0.001, 0.0), ("(0,1]", 0.0, 1.0), ("(1,5]", 1.0, 5.0), ("(5,10]", 5.0, 10.0), ("10+", 10.0, None)]


def amount_bucket(c: Column) -> Column:
    """Label of the amount class; null counts as 0, amounts below the first class are null."""
    value = F.coalesce(c, F.lit(0.0))
    out = F.lit(None).cast("string")
    for label, low, high in AMOUNT_BUCKETS:
        inside = value > low if high is None else (value > low) & (value <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def equal_width_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of a value clipped to [low, high]; the top edge belongs to the last bin."""
    width = (high - low) / bins
    return F.least(F.floor((clip(c, low, high) - low) / width), F.lit(bins - 1)).cast("int")


# --- names, prompts and labels ---------------------------------------------------------
def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def two_decimals(c: Column) -> Column:
    """Value with two decimals, ``NA`` for null, rounded by the value the double really has."""
    return F.coalesce(F.call_function("format_number", c.cast("double"), F.lit("0.00")), F.lit("NA"))


def row_text(names: dict[str, str]) -> Column:
    """``key=value; ...`` description of a row; ``names`` maps contract names to columns."""
    col = lambda n: F.col(names.get(n, n))
    hour = F.coalesce(col("scheduled_departure_hour_local").cast("int").cast("string"), F.lit("NA"))
    parts = [
        F.concat(F.lit("origin="), col("Origin")),
        F.concat(F.lit("dest="), col("Dest")),
        F.concat(F.lit("carrier="), col("Reporting_Airline")),
        F.concat(F.lit("dep_hour_local="), hour),
    ]
    parts += [F.concat(F.lit(f"{label}="), two_decimals(col(n))) for label, n in PROMPT_FIELDS]
    return F.concat_ws("; ", *parts)


# fixed values: wording of the prompt
PROMPT_HEAD = [
    "Predict whether the flight will be delayed by 15+ minutes.",
    "Use only the provided row features.",
    "Respond with exactly one label: DELAY or ON_TIME.",
]


def label_name(label: Column) -> Column:
    return F.when(label == 1, "DELAY").otherwise("ON_TIME")


def parse_label(text: Column) -> Column:
    """0 or 1 from a free answer: ON_TIME or DELAY, whichever comes first, else YES or NO."""
    upper = F.upper(text)
    delay, on_time = F.instr(upper, "DELAY"), F.instr(upper, "ON_TIME")
    return (
        F.when((on_time > 0) & ((delay == 0) | (on_time < delay)), 0)
        .when(delay > 0, 1)
        .when(F.instr(upper, "YES") > 0, 1)
        .when(F.instr(upper, "NO") > 0, 0)
    )
