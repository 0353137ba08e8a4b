"""Days, ages and dates in texts as column expressions; what is now is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start(day: Column, zone: str = ZONE) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end(day: Column, zone: str = ZONE) -> Column:
    """The instant at which the next local day begins."""
    return day_start(F.date_add(day, 1), zone)


def whole_days_between(earlier: Column, later: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def days_since(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def years_in(text: Column) -> Column:
    """Distinct years 1900 to 2099 that a text names, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(19[0-9]{2}|20[0-9]{2})"), 1))


DAY = r"((?:19|20)[0-9]{2})\s*[.\-/년]\s*([0-9]{1,2})\s*[.\-/월]\s*([0-9]{1,2})"


def iso_days(text: Column) -> Column:
    """Days that a text names as year, month and day, as ISO strings; months to 12 and days to 31 count, whatever the month."""
    part = lambda g: F.regexp_extract_all(text, F.lit(DAY), g)
    days = F.zip_with(
        F.zip_with(part(1), part(2), lambda y, m: F.struct(y.alias("y"), m.cast("int").alias("m"))),
        part(3),
        lambda ym, d: F.when(
            ym["m"].between(1, 12) & d.cast("int").between(1, 31),
            F.concat_ws("-", ym["y"], F.lpad(ym["m"].cast("string"), 2, "0"), F.lpad(d.cast("int").cast("string"), 2, "0")),
        ),
    )
    return F.array_compact(days)


def first_and_last_day(text: Column) -> Column:
    days = iso_days(text)
    return F.struct(F.array_min(days).alias("first_day"), F.array_max(days).alias("last_day"))


def without_copyright_years(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(copyright|\(c\)|©)\s*(19|20)[0-9]{2}(\s*[-~]\s*(19|20)[0-9]{2})?", " ")


def backoff_days(base: Column, failures: Column, most: int = 14) -> Column:
    """Days to wait after so many failures in a row: the base once, twice, three, then seven times."""
    times = F.when(failures <= 0, 1).when(failures == 1, 2).when(failures == 2, 3).otherwise(7)
    return F.least(F.lit(most), base * times)


def stale(ts: Column, as_of: Column, seconds: int, least: int = 30) -> Column:
    return F.coalesce(F.unix_micros(ts) < F.unix_micros(as_of) - max(seconds, least) * 1_000_000, F.lit(False))


def checked_day(year: Column, month: Column, day: Column) -> Column:
    """ISO day of three numbers given as text, null unless the month is 1 to 12 and the day 1 to 31; every month has 31 here."""
    m, d = month.try_cast("int"), day.try_cast("int")
    return F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


YEAR, MD, TO = r"((?:19|20)[0-9]{2})", r"([0-9]{1,2})", r"\s*[일.]?\s*(?:\([월화수목금토일]\))?\s*(?:부터|[~\-–—]|내지)+\s*"
#: Two days with a sign between them, the second with or without a year; and two days without a year at all.
PERIOD = rf"{YEAR}\s*[.\-/년]\s*{MD}\s*[.\-/월]\s*{MD}{TO}(?:{YEAR}\s*[.\-/년]\s*)?{MD}\s*[.\-/월]\s*{MD}"
SHORT_PERIOD = rf"(?<![0-9.\-]){MD}\s*\.\s*{MD}\s*\.?\s*(?:\([월화수목금토일]\))?\s*[~\-–—]\s*{MD}\s*\.\s*{MD}"


def periods(text: Column, year: int) -> Column:
    """first_day and last_day of the periods that a text names, as ISO strings; without a year it is ``year``, where no dated period is named."""
    part = lambda pattern, g: F.regexp_extract_all(text, F.lit(pattern), g)
    whole = F.arrays_zip(*[part(PERIOD, g).alias(f"g{g}") for g in range(1, 7)])
    second_year = lambda x: F.when(x["g4"] == "", x["g1"]).otherwise(x["g4"])
    dated = F.transform(whole, lambda x: F.struct(checked_day(x["g1"], x["g2"], x["g3"]).alias("a"), checked_day(second_year(x), x["g5"], x["g6"]).alias("b")))
    short = F.transform(F.arrays_zip(*[part(SHORT_PERIOD, g).alias(f"g{g}") for g in range(1, 5)]), lambda x: F.struct(checked_day(F.lit(str(year)), x["g1"], x["g2"]).alias("a"), checked_day(F.lit(str(year)), x["g3"], x["g4"]).alias("b")))
    ends = lambda found: F.struct(F.array_min(F.transform(found, lambda x: x["a"])).alias("first_day"), F.array_max(F.transform(found, lambda x: x["b"])).alias("last_day"))
    return F.when(F.size(dated) > 0, ends(dated)).otherwise(ends(short))


POSTED = r"(?i)(?:등록일|작성일|게시일|공고일|posted|date posted)\s*[:：]?\s*(.{0,40})"


def posted_day(text: Column) -> Column:
    """The day behind a label of posting: year first, or month, day and year, with the first two changed over where only that gives a day."""
    rest = F.regexp_extract(without_copyright_years(text), POSTED, 1)
    year_first, year_last = rf"{YEAR}\s*[.\-/년]\s*{MD}\s*[.\-/월]\s*{MD}", rf"{MD}[.\-/]{MD}[.\-/]{YEAR}"
    g = lambda pattern, k: F.regexp_extract(rest, pattern, k)
    a, b = g(year_last, 1).try_cast("int"), g(year_last, 2).try_cast("int")
    swapped = (a > 12) & (b <= 12)
    by_year_last = F.when(swapped, checked_day(g(year_last, 3), g(year_last, 2), g(year_last, 1))).otherwise(checked_day(g(year_last, 3), g(year_last, 1), g(year_last, 2)))
    return F.when(rest.rlike(year_first), checked_day(g(year_first, 1), g(year_first, 2), g(year_first, 3))).when(rest.rlike(year_last), by_year_last)
