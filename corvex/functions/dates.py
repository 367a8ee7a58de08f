"""Points in time from words, dates in headings and calendar days."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000

# Units of time in milliseconds, and number words.
UNITS = {
    "s": 1000, "sec": 1000, "second": 1000,
    "m": 60_000, "min": 60_000, "minute": 60_000,
    "h": 3_600_000, "hr": 3_600_000, "hour": 3_600_000,
    "d": DAY, "day": DAY,
    "w": 7 * DAY, "wk": 7 * DAY, "week": 7 * DAY,
    "mo": 30 * DAY, "mon": 30 * DAY, "month": 30 * DAY,
    "y": 365 * DAY, "yr": 365 * DAY, "year": 365 * DAY,
}
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "ten": 10}
# Month names, English and French.
MONTHS = {
    "january": 1, "jan": 1, "janvier": 1, "janv": 1,
    "february": 2, "feb": 2, "février": 2, "fevrier": 2, "févr": 2, "fevr": 2, "fév": 2, "fev": 2,
    "march": 3, "mar": 3, "mars": 3,
    "april": 4, "apr": 4, "avril": 4, "avr": 4,
    "may": 5, "mai": 5,
    "june": 6, "jun": 6, "juin": 6,
    "july": 7, "jul": 7, "juillet": 7, "juil": 7, "juill": 7,
    "august": 8, "aug": 8, "août": 8, "aout": 8,
    "september": 9, "sept": 9, "sep": 9, "septembre": 9,
    "october": 10, "oct": 10, "octobre": 10,
    "november": 11, "nov": 11, "novembre": 11,
    "december": 12, "dec": 12, "décembre": 12, "decembre": 12, "déc": 12,
}
ENGLISH = "january february march april may june july august september october november december".split()

# ---- timeframes: words become symbols, and a table tells what a row of symbols stands for ----

SYMBOLS = {w: "ago" for w in ("ago",)} | {w: "last" for w in ("last", "past", "this")} | {w: "th" for w in ("st", "nd", "rd", "th")} | {",": "", ".": ""}


def _symbol(token: str) -> tuple[str, float | int | None]:
    """The kind of a token (n: number, u: unit, m: month, other words by SYMBOLS) and its value."""
    if token[0].isdigit():
        return "n", float(token) if "." in token else int(token)
    if token in SYMBOLS:
        return SYMBOLS[token], None
    if token in NUMBERS:
        return "n", NUMBERS[token]
    unit = UNITS.get(token, UNITS.get(token.removesuffix("s")))
    if unit:
        return "u", unit
    month = next((i for i, name in enumerate(ENGLISH, 1) if name[:3] == token[:3]), None) if len(token) >= 3 else None
    return ("m", month) if month else ("?", None)


def _calendar(now: datetime, month: int, day, year=None) -> int | None:
    """The day of a month, of the year given or else of the latest such day that is not to come."""
    if isinstance(day, float) or not 1 <= day <= 31:
        return None
    at = lambda y: int(datetime(y, month, 1, tzinfo=UTC).timestamp()) * 1000 + (day - 1) * DAY
    if year is not None:
        return at(year) if isinstance(year, int) and 1 <= year <= 9999 else None
    t = at(now.year)
    return t if t <= now.timestamp() * 1000 else at(now.year - 1)


def _before(now: datetime, ms: float) -> int:
    return round(now.timestamp() * 1000 - ms)


RULES: dict[str, Callable[..., int | None]] = {
    "n": lambda now, n: _before(now, n * DAY),
    "n u": lambda now, n, u: _before(now, n * u),
    "n u ago": lambda now, n, u: _before(now, n * u),
    "last u": lambda now, u: _before(now, u),
    "last n u": lambda now, n, u: _before(now, n * u),
} | {
    form: (lambda now, *v, order=order: _calendar(now, *[v[i] for i in order]))
    for form, order in {
        "m n": (0, 1), "m n th": (0, 1), "m n n": (0, 1, 2), "m n th n": (0, 1, 2),
        "n m": (1, 0), "n th m": (1, 0), "n m n": (1, 0, 2), "n th m n": (1, 0, 2),
    }.items()
}


def parse_timeframe(value, now_ms: int) -> int | None:
    """Epoch milliseconds that "7d", "two weeks ago", "last month", "yesterday", "Jan 5" or an ISO date
    stand for; None if it is none of these. Days are UTC; months have 30 days and years 365; a number is days."""
    if value is None or isinstance(value, bool):
        return None
    now, text = datetime.fromtimestamp(now_ms / 1000, UTC), str(value).strip().lower()
    days = {"now": None, "today": 0, "yesterday": 1}
    if text in days:
        return now_ms if days[text] is None else int((now.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=days[text])).timestamp() * 1000)
    if text[4:5] == "-" and text[:4].isdigit():
        try:
            t = datetime.fromisoformat(text.upper())
        except ValueError:
            return None
        return round((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)
    tokens = re.findall(r"\d+(?:\.\d+)?|[a-z]+|\S", text)
    found = list(map(_symbol, tokens))
    rule = RULES.get(" ".join(k for k, _ in found if k))
    return rule(now, *[v for _, v in found if v is not None]) if rule else None


# ---- dates in headings ----

#: What a heading's words and signs are, a letter each: Y a year, D a day or month in figures, O a day such as 5th, N a
#: month's name, _ space; `-`, `/`, `.` and `,` themselves; x anything else.
SHAPES = (  # families in the order in which they count; in one, the first place counts, then the longest shape
    ("Y-D-D",), ("D/D/Y",), ("D/D",), ("D_N", "D_N.", "D_N_Y", "D_N._Y", "D_N.Y"),
    tuple(f"N{dot}_{day}{comma}{year}" for dot in ("", ".") for day in "DO" for comma in ("", ",") for year in ("", "_Y")),
)
#: Which of a shape's figures is what; numeric dates are read day first.
READ = {"Y-D-D": "YMD", "D/D/Y": "DMY", "D/D": "DM"}


def _kind(word: Column, months: Column) -> Column:
    digits = word.rlike("^[0-9]+$")
    return (
        F.when(word.rlike(r"^\s+$"), "_").when(word.isin("-", "/", ".", ","), word).when(digits & (F.length(word) == 4), "Y").when(digits & (F.length(word) <= 2), "D")
        .when(word.rlike("^[0-9]{1,2}(st|nd|rd|th)$"), "O").when(F.map_contains_key(months, word), "N").otherwise("x")
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _read(words: Column, shape: Column, family: tuple[str, ...], months: Column) -> Column:
    """The date of the family's first shape in a heading, null if there is none or if it is no date."""
    fields = {f: READ.get(f) or "".join({"D": "D", "O": "D", "N": "M", "Y": "Y"}.get(c, "") for c in f) for f in family}
    places = {f: [i for i, c in enumerate(f) if c in "YDON"] for f in family}
    offsets = {c: F.array(*[F.lit(places[f][fields[f].index(c)] if c in fields[f] else None).cast("int") for f in family]) for c in "YMD"}
    seen = F.array(*[F.struct(F.instr(shape, f).alias("at"), F.lit(-len(f)).alias("longest"), F.lit(k).alias("k")) for k, f in enumerate(family)])

    def told(hit: Column) -> Column:
        word = {c: F.get(words, hit["at"] - 1 + F.get(offsets[c], hit["k"])) for c in "YMD"}
        year, day = (F.regexp_extract(word[c], "^[0-9]+", 0).try_cast("int") for c in "YD")
        month = F.coalesce(F.try_element_at(months, word["M"]), word["M"].try_cast("int"))
        real = month.between(1, 12) & day.between(1, 31) & F.coalesce(year.between(1900, 2999), F.lit(True))
        return F.when(real, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))

    return _bound(F.array_min(F.filter(seen, lambda p: p["at"] > 0)), told)


def heading_date(title: Column) -> Column:
    """struct(year, month, day) of the first known form in a heading, else null; the year may be null. The heading is
    read word by word; forms are shapes of neighbouring words."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}\p{N}_]+|\s+|.)"), 1)

    def read(words: Column) -> Column:
        shape = F.array_join(F.transform(words, lambda w: _kind(w, months)), "")
        return _bound(shape, lambda s: F.coalesce(*[_read(words, s, family, months) for family in SHAPES]))

    return _bound(words, read)


def _midnight(year: Column, month: Column, day: Column) -> Column:
    """UTC milliseconds; days past a month's end run on into the next."""
    first = F.make_date(year, month, F.lit(1))
    return (F.unix_date(first).cast("bigint") + day - 1) * DAY


def infer_years(dates: Column, anchor_ms: Column) -> Column:
    """Dates in document order with years filled in from the end: a date without a year is the latest such
    day that is not after the dated section that follows it, or after `anchor_ms`. array<bigint> of UTC
    midnights in milliseconds."""
    def date_of(later, d):
        latest = F.year(F.timestamp_millis(later))
        past = (_midnight(latest, d["month"], d["day"]) > later).cast("int")
        return _midnight(F.coalesce(d["year"], latest - past), d["month"], d["day"])

    # the list grows from the back, its last entry is the section that follows; the anchor is taken off in the end
    back = F.aggregate(F.reverse(dates), F.array(anchor_ms.cast("bigint")), lambda acc, d: F.concat(acc, F.array(date_of(F.element_at(acc, -1), d))))
    return F.reverse(F.slice(back, F.lit(2), F.size(back)))


def latest_iso_date(text: Column) -> Column:
    return F.array_max(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1))
