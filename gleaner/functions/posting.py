"""Column functions over posting fields: places, dates, seniority, quality and risk labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import mapped, or_null, stripped

#: States of the United States by name (fixed values).
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
REMOTE = r"(?i)\b(remote|anywhere|work\s*from\s*home|wfh)\b"
#: The first day that a date may name (fixed value).
FIRST_DAY = "2020-01-01"


def place(location: Column) -> Column:
    """A struct of city, state, country and remote, read from "City, ST", "City, State[, Country]", "State", "Country"."""
    text = or_null(stripped(location))
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    one, two, three = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    n = F.size(parts)
    short = (n >= 2) & F.length(two).eqNullSafe(2) & F.upper(two).isin(*STATES.values())
    named = F.when(n >= 2, mapped(F.lower(two), STATES))
    alone = mapped(F.lower(text), STATES)
    first = mapped(F.lower(one), STATES)
    home = (n == 2) & (two == "United States")
    only_remote = F.regexp_like(one, F.lit(r"(?i)^(remote|anywhere|work\s*from\s*home|wfh)$"))
    state = F.when(short, F.upper(two)).when(named.isNotNull(), named).when(home, first).when(n == 1, alone)
    country = (
        F.when(short, F.when(n >= 3, three).otherwise("US"))
        .when(named.isNotNull() | home, "US")
        .when(n >= 3, three)
        .when(n == 2, two)
        .when((text == "United States") | alone.isNotNull(), "US")
    )
    city = (
        F.when(home & first.isNotNull(), None)
        .when(n >= 2, F.when(~only_remote | short | named.isNotNull(), one))
        .when((text == "United States") | alone.isNotNull() | only_remote, None)
        .otherwise(text)
    )
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"), F.coalesce(text.rlike(REMOTE), F.lit(False)).alias("remote"))


def metro(search: Column, alias: Column, lookup: Column, reference: Column, remote: Column) -> Column:
    """A struct of the metro and where it is from: the first candidate that is there, none for remote postings."""
    out = F.when(F.coalesce(remote, F.lit(False)), F.struct(F.lit(None).cast("string").alias("metro"), F.lit("unresolved").alias("source")))
    for candidate, name in ((search, "search_metro"), (alias, "manual_alias"), (lookup, "city_state_lookup"), (reference, "city_state_reference")):
        out = out.when(candidate.isNotNull(), F.struct(candidate.alias("metro"), F.lit(name).alias("source")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("metro"), F.lit("unresolved").alias("source")))


def date_flags(**dates: Column) -> Column:
    """What is wrong with the given dates, by name: invalid, out of range, joined by "|"; missing dates are fine."""
    flags = []
    for name, c in dates.items():
        text = or_null(stripped(c.cast("string")))
        parsed = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        flags += [F.when(text.isNotNull() & parsed.isNull(), f"{name}_invalid"), F.when(parsed < F.lit(FIRST_DAY).cast("timestamp"), f"{name}_out_of_range")]
    found = F.array_join(F.array_compact(F.array(*flags)), "|")
    return F.when(found == "", "ok").otherwise(found)


def contradicts(seniority: Column, years: Column) -> Column:
    """Whether the years asked for speak against the label: entry from 3, associate from 5."""
    return F.coalesce(((seniority == "entry") & (years >= 3)) | ((seniority == "associate") & (years >= 5)), F.lit(False))


def ghost_risk(seniority: Column, years: Column, contradiction: Column) -> Column:
    entry = F.coalesce(F.lower(F.trim(seniority)) == "entry", F.lit(False)) & years.isNotNull()
    return F.when(~entry, "low").when(years >= 5, "high").when(F.coalesce(contradiction, F.lit(False)) | (years >= 3), "medium").otherwise("low")


def quality(description: Column) -> Column:
    n = F.length(stripped(F.coalesce(description, F.lit(""))))
    return F.when(n == 0, "empty").when(n < 50, "too_short").otherwise("ok")


def posted_quality(posted: Column, seen: Column) -> Column:
    """missing, parse_failed, future, stale_gt_60d or valid, against the day seen."""
    text = or_null(stripped(posted.cast("string")))
    day = F.to_date(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    age = F.datediff(seen.cast("date"), day)
    return F.when(text.isNull(), "missing").when(day.isNull(), "parse_failed").when(age < 0, "future").when(age > 60, "stale_gt_60d").otherwise("valid")


def period(source: Column, seen: Column, fixed: dict[str, str]) -> Column:
    """The month seen for scraped rows, a constant for the sources in ``fixed``, else "unknown"."""
    month = F.date_format(F.try_to_timestamp(seen.cast("string")), "yyyy-MM")
    out = F.when(source == "scraped", F.coalesce(month, F.lit("unknown")))
    for name, value in fixed.items():
        out = out.when(source == name, value)
    return out.otherwise("unknown")

