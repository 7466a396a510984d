"""Post filters: parsing, warnings and predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.sources.settings import DAY_MS, PAGE, PAGE_MOST, PLATFORMS, TIMEFRAMES

#: Windows of boards and the most days of a growth report.
WINDOWS, MOST_DAYS = (1, 7, 30), 365
SORTS = ("recent", "likes", "xfactor", "xscore", "relevance")


@dataclass(frozen=True)
class PostFilters:
    """What a search asks for; every field is optional and all that are given must hold."""

    platforms: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    match: str = "any"
    authors: tuple[str, ...] = ()
    min_likes: float | None = None
    min_shares: float | None = None
    min_x_factor: float | None = None
    min_x_score: float | None = None
    include_provisional: bool = True
    timeframe: str = "all"
    date_from: str | None = None
    date_to: str | None = None
    market: str | None = None
    sort: str = "recent"
    page: int = 1
    page_size: int = PAGE
    ignored: tuple[str, ...] = field(default=())


def _number(text: str | None) -> float | None:
    try:
        value = float(text) if text not in (None, "") else None
    except ValueError:
        return None
    return value if value is not None and value == value and abs(value) != float("inf") else None


def clamp_page(page: float | None, page_size: float | None) -> tuple[int, int]:
    """Whole numbers, at least 1, pages of at most PAGE_MOST rows; what is not a number takes the default."""
    p = max(1, int(page // 1)) if page is not None else 1
    s = min(PAGE_MOST, max(1, int(page_size // 1))) if page_size is not None else PAGE
    return p, s


def parse(query: Mapping[str, str]) -> PostFilters:
    """Filters of a query string's parameters. What has no effect is told in ``ignored``, one line each."""
    ignored: list[str] = []

    def listed(*names: str) -> tuple[str, ...]:
        return tuple(x.strip() for n in names for x in query.get(n, "").split(",") if x.strip())

    def choice(name: str, known: tuple[str, ...], default: str) -> str:
        value = query.get(name, "")
        if value and value not in known:
            ignored.append(f"{name}='{value}' is not known and was ignored; expected one of {', '.join(known)}")
        return value if value in known else default

    def number(name: str) -> float | None:
        value = _number(query.get(name))
        if query.get(name) and value is None:
            ignored.append(f"{name}='{query[name]}' is not a number and was ignored")
        return value

    asked = listed("platforms", "platform")
    platforms = tuple(dict.fromkeys(p.lower() for p in asked if p.lower() in PLATFORMS))
    unknown = [p for p in asked if p.lower() not in PLATFORMS and p.lower() != "all"]
    if unknown:
        ignored.append(f"platforms not known and ignored: {', '.join(unknown)}; expected {', '.join(PLATFORMS)}")
    if "all" in [p.lower() for p in asked] or len(platforms) == len(PLATFORMS):
        platforms = ()
    dates = {n: query.get(n) or None for n in ("dateFrom", "dateTo")}
    timeframe = choice("timeframe", (*TIMEFRAMES, "all", "custom"), "custom" if any(dates.values()) and not query.get("timeframe") else "all")
    if timeframe != "custom" and any(dates.values()):
        ignored.append(f"{' and '.join(n for n, v in dates.items() if v)} ignored: timeframe='{timeframe}' goes before, only custom takes dates")
    if query.get("semantic") == "true" and not (query.get("q") or query.get("keywords")):
        ignored.append("semantic=true ignored: there are no keywords to embed")
    for name in ("imageThreshold", "textThreshold"):
        number(name)
    page, size = clamp_page(number("page"), number("pageSize"))
    return PostFilters(
        platforms=platforms, keywords=listed("q", "keywords"), match=choice("match", ("any", "all"), "any"), authors=listed("authors"),
        min_likes=number("minLikes"), min_shares=number("minShares"), min_x_factor=number("minXFactor"), min_x_score=number("minXScore"),
        include_provisional=query.get("includeProvisional", "true") != "false", timeframe=timeframe, date_from=dates["dateFrom"], date_to=dates["dateTo"],
        market=query.get("market") or None, sort=choice("sort", SORTS, "recent"), page=page, page_size=size, ignored=tuple(ignored),
    )


def warnings(filters: PostFilters, has_text: bool | None = None) -> list[str]:
    """One line for everything that was asked for and has no effect."""
    out = list(filters.ignored)
    if filters.sort == "relevance" and not filters.keywords:
        out.append("sort by relevance needs keywords; sorted by date instead")
    if has_text is False:
        out.append("no keyword holds a letter or digit; nothing matches")
    if filters.date_from and filters.date_to and filters.date_from > filters.date_to:
        out.append("dateFrom is after dateTo; nothing matches")
    return out


def _whole(text: str | None, default: int) -> float | None:
    """A parameter's number: the default if absent, 0 if empty, None if it is none."""
    if text is None:
        return default
    return _number(text) if text.strip() else 0


def window_days(text: str | None) -> int:
    """the window of a board, one of WINDOWS; 1 by default, anything else raises ValueError."""
    value = _whole(text, 1)
    if value not in WINDOWS:
        raise ValueError(f"window must be one of {', '.join(map(str, WINDOWS))}")
    return int(value)


def growth_days(text: str | None) -> int:
    """a whole number of days from 1 to MOST_DAYS; 7 by default, anything else raises ValueError."""
    value = _whole(text, 7)
    if value is None or value != int(value) or not 1 <= value <= MOST_DAYS:
        raise ValueError(f"days must be a whole number between 1 and {MOST_DAYS}")
    return int(value)


def day_key(text: str | None) -> str | None:
    """a day as ``yyyy-MM-dd``; None if absent. What has another form raises ValueError rather than taking another day."""
    if text is not None and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise ValueError("the day must be given as yyyy-MM-dd")
    return text


def narrows(filters: PostFilters) -> bool:
    """Whether anything but keywords, order and paging restricts the result."""
    free = replace(filters, keywords=(), match="any", sort="recent", page=1, page_size=PAGE, ignored=())
    return free != PostFilters()


def iso(column: str = "posted_at") -> Column:
    """An instant as ISO 8601 text in UTC with milliseconds, the form custom dates are compared in."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def predicate(filters: PostFilters, now_ms: int) -> Column:
    """The conjunction over post columns, keywords apart.

    A minimum of 0 likes or shares is no filter; a minimum of 0 for the scores is one and leaves out nulls. Custom
    dates compare as text, so a date without a time ends before that day's first instant.
    """
    out = F.lit(True)
    if filters.platforms:
        out &= F.col("platform").isin(*filters.platforms)
    if filters.authors:
        out &= F.col("author_id").isin(*filters.authors)
    for column, least in (("likes", filters.min_likes), ("shares", filters.min_shares)):
        if least:
            out &= F.col(column) >= least
    for column, least in (("x_factor", filters.min_x_factor), ("x_score", filters.min_x_score)):
        if least is not None:
            out &= F.col(column) >= least
    if not filters.include_provisional:
        out &= F.col("x_provisional") == 0
    if filters.market:
        out &= F.col("market") == filters.market
    if filters.timeframe in TIMEFRAMES:
        out &= F.unix_millis("posted_at") >= now_ms - TIMEFRAMES[filters.timeframe] * DAY_MS
    if filters.timeframe == "custom":
        if filters.date_from:
            out &= iso() >= filters.date_from
        if filters.date_to:
            out &= iso() <= filters.date_to
    return out


FILTERED = ("platform", "author_id", "likes", "shares", "x_factor", "x_score", "x_provisional", "market", "posted_at")

_KEYS = {"recent": "posted_at", "likes": "likes", "xfactor": "x_factor", "xscore": "x_score"}


def order(sort: str) -> list[Column]:
    """Descending with nulls (and NaN scores) last, then by id; relevance by ascending rank."""
    if sort == "relevance":
        return [F.col("bm25").asc(), F.col("posted_at").desc_nulls_last(), F.col("id")]
    key = F.col(_KEYS.get(sort, "posted_at"))
    if sort in ("xfactor", "xscore"):
        key = F.when(~F.isnan(key), key)
    return [key.desc_nulls_last(), F.col("id")]


def page(df: DataFrame, filters: PostFilters) -> DataFrame:
    """One page in the filters' order; rows beyond the last page are none."""
    return df.orderBy(*order(filters.sort)).offset((filters.page - 1) * filters.page_size).limit(filters.page_size)


def script_share(text: Column) -> Column:
    """The share of letters that are not Latin; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, (letters - F.regexp_count(text, F.lit(r"\p{IsLatin}"))) / letters)


def mostly_latin(text: Column) -> Column:
    """The language gate: kept unless more than 30 % of the letters are not Latin; texts without letters are kept."""
    return F.coalesce(script_share(text) <= 0.3, F.lit(True))
