"""Row-level helpers: coercion, calendar arithmetic and month text. Everything stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """Numeric or NULL; NaN becomes NULL because Spark aggregates would propagate it."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


#: Days outside this calendar (nanosecond timestamps end there) count as no date, so that open-ended
#: periods cannot grow into thousands of months.
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"


def to_date(c: Column) -> Column:
    """Date or NULL for text that is not a date of the calendar."""
    day = c.try_cast("date")
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), day)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def month_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def months_between(first: Column, last: Column) -> Column:
    """Month starts first..last (both month starts); an empty array when the range is empty."""
    empty = F.array().cast("array<date>")
    return F.when(
        first <= last, F.sequence(first, last, F.expr("interval 1 month"))
    ).otherwise(empty)


def months_covered(start: Column, end: Column) -> Column:
    """Every month touched by [start, end], a partial first month included."""
    return months_between(month_start(start), month_start(end))


def full_month_starts(start: Column, end: Column) -> Column:
    """Month starts inside [start, end]: a partial first month is skipped."""
    first = F.when(F.dayofmonth(start) == 1, start).otherwise(
        F.add_months(month_start(start), 1)
    )
    return months_between(first, month_start(end))


def normalise_month(c: Column) -> Column:
    """'YYYYMM', dates and parseable text become 'YYYY-MM'; other text is left as it is."""
    text = F.regexp_replace(c.cast("string"), r"^(\d{4})(\d{2})$", "$1-$2")
    return F.coalesce(month_text(text.try_cast("date")), text)


def factor_class(name: Column) -> Column:
    """0 = influencing ('fi_' prefix), 1 = usage, NULL = a degree-day name, never a factor."""
    return (
        F.when(name.startswith("hdd") | name.startswith("cdd"), F.lit(None))
        .when(name.startswith("fi_"), F.lit(0))
        .otherwise(F.lit(1))
    )
