"""Text fields of a contest record as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")


def _int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def landed_attempted(c: Column) -> Column:
    """``'25 of 50'`` -> struct(landed, attempted); anything else gives zeros."""
    parts = F.split(c, " of ")
    landed, attempted = _int(F.get(parts, F.lit(0))), _int(F.get(parts, F.lit(1)))
    good = (F.size(parts) == 2) & landed.isNotNull() & attempted.isNotNull()
    return F.struct(
        F.when(good, landed).otherwise(F.lit(0)).alias("landed"),
        F.when(good, attempted).otherwise(F.lit(0)).alias("attempted"),
    )


def landed_attempted_prefix(c: Column) -> Column:
    """Lenient form: a leading ``<digits> of <digits>``, trailing text ignored."""
    pattern = r"^(\d+)\s+of\s+(\d+)"
    return F.struct(*[
        F.coalesce(F.regexp_extract(F.trim(c), pattern, i).try_cast("int"), F.lit(0)).alias(name)
        for i, name in ((1, "landed"), (2, "attempted"))
    ])


def mmss_seconds(c: Column) -> Column:
    parts = F.split(c, ":")
    minutes, seconds = _int(F.get(parts, F.lit(0))), _int(F.get(parts, F.lit(1)))
    total = F.when(F.size(parts) == 2, minutes * 60 + seconds)
    return F.coalesce(total, F.lit(0))


def mmss_seconds_prefix(c: Column) -> Column:
    pattern = r"^(\d+):(\d+)"
    minutes, seconds = (F.regexp_extract(F.trim(c), pattern, i).try_cast("int") for i in (1, 2))
    return F.coalesce(minutes * 60 + seconds, F.lit(0))


def percent(c: Column) -> Column:
    """Share in [0, 1]; values above one are read as percentages, so ``'1%'`` is 1.0."""
    value = F.trim(F.regexp_replace(c, "%", "")).try_cast("double")
    share = F.when(value > 1, value / 100).otherwise(value)
    return F.when(value.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def first_int(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(c), r"^(\S+)", 1).try_cast("int"), F.lit(0))


def accuracy_percent(landed: Column, attempted: Column) -> Column:
    return F.coalesce(F.try_divide(landed * F.lit(100.0), attempted.cast("double")), F.lit(0.0))


def accuracy_text(landed: Column, attempted: Column) -> Column:
    return F.format_string("%.0f%%", accuracy_percent(landed, attempted))


def height_inches(c: Column) -> Column:
    pattern = r"(\d+)'\s*(\d+)"
    feet, inches = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))
    return feet * 12 + inches


def reach_inches(c: Column) -> Column:
    value = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    return F.when(value > 0, value)


def record(c: Column) -> Column:
    """``'Record: W-L-D'`` -> struct(wins, losses, draws, total), null fields when absent."""
    pattern = r"(\d+)-(\d+)-(\d+)"
    wins, losses, draws = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.struct(wins.alias("wins"), losses.alias("losses"), draws.alias("draws"),
                    (wins + losses + draws).alias("total"))


def any_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that reads the text wins."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def missing_to_null(c: Column) -> Column:
    text = F.trim(c)
    return F.when(~text.isin("", "N/A", "--"), text)


def age_at(day: Column, born: Column, default: Column) -> Column:
    age = F.date_diff(day, born) / F.lit(365.25)
    return F.when(age.between(18, 60), age).otherwise(default)


def calendar_age(born: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def elapsed_seconds(round_no: Column, clock_s: Column, null_when_missing: bool = False) -> Column:
    """Five-minute rounds; a missing round counts as round zero unless asked for null."""
    base = round_no if null_when_missing else F.coalesce(round_no, F.lit(0))
    return (base - 1) * 300 + clock_s
