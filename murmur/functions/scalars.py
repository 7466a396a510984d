"""Scalar functions over urls, names, times and scores, as expressions that stay in generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.sources import settings as S


def _match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def host(c: Column) -> Column:
    """The lower-cased host of a url, null without one; underscores are let through."""
    return F.lower(_match(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"))


def path(c: Column) -> Column:
    """The path of a url with a host, null without one."""
    return _match(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)")


# --- scores -----------------------------------------------------------------


def bucket(likes: Column) -> Column:
    """A word for a number of likes."""
    score = likes
    return F.when(score >= 1000, "viral").when(score >= 750, "great").when(score >= 500, "good").when(score >= 200, "ok").otherwise("flop")


def badge_tone(z: Column, provisional: Column) -> Column:
    """The tone of an outlier score; unscored posts are pending or have none."""
    return F.when(z.isNull(), F.when(provisional == 1, "pending").otherwise("none")).when(z >= S.RARE_Z, "green").when(z >= S.NOTABLE_Z, "amber").when(z <= S.LOW_Z, "red").otherwise("gray")


def one_decimal(x: Column) -> Column:
    """A number to one decimal, as text: the nearest to its stored binary value, ties away from zero."""
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    part = size - whole  # exact
    place = F.floor(part * 10 + 0.5)
    # part * 10 was rounded: whether 20 part reaches 2 place - 1 is told by 16 part + 4 part as a sum and its rounding error
    a, b = part * 16, part * 4
    total = a + b
    error = (a - (total - (total - a))) + (b - (total - a))
    place = F.when((total - (2 * place - 1)) + error < 0, place - 1).otherwise(place)
    n = whole * 10 + place
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def badge_label(z: Column, factor: Column, provisional: Column, age_days: Column) -> Column:
    """The score, the factor and, of provisional posts, the day of the measurement; unscored provisional posts are new."""
    ratio = F.when(factor.isNotNull(), F.concat(F.lit(" · "), one_decimal(factor), F.lit("×"))).otherwise("")
    day = F.when((provisional == 1) & age_days.isNotNull(), F.concat(F.lit(" (day "), age_days.cast("string"), F.lit(")"))).otherwise("")
    return F.when(z.isNotNull(), F.concat(one_decimal(z), F.lit("σ"), ratio, day)).when(provisional == 1, "new")


# --- times ------------------------------------------------------------------


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """C4: how long ago, in the largest whole unit; the future is just now, null is never."""
    s = F.floor(F.greatest(now_ms - then_ms, F.lit(0)) / 1000)
    out = F.when(then_ms.isNull(), F.lit("never"))
    for unit, seconds in (("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60)):
        n = F.floor(s / seconds)
        out = out.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")))
    return out.otherwise("just now")


def instant(text: Column) -> Column:
    """An ISO instant, null where it is none."""
    return F.try_to_timestamp(text)


def micro_blog_instant(text: Column) -> Column:
    """An instant written as weekday, month, day, time, zone and year; the weekday is not read."""
    return F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def age_days(from_ms: Column, to_ms: Column) -> Column:
    """Days to one decimal, halves up, none below zero."""
    raw = (to_ms - from_ms) / float(S.DAY_MS)
    return F.when(raw > 0, F.floor(raw * 10 + 0.5) / 10).otherwise(F.lit(0.0))


def cutoff_day(timeframe: str, as_of: Column) -> Column | None:
    """The first day of a time frame; None for an open one."""
    days = S.TIMEFRAMES.get(timeframe)
    return None if days is None else F.date_sub(as_of, days)


# --- urls -------------------------------------------------------------------


def activity_id(c: Column) -> Column:
    """The number of a post's urn."""
    return _match(c, r"(?:activity|ugcPost|share)[-:](\d+)")


def plain_url(c: Column) -> Column:
    """Without query, fragment and one closing slash."""
    return F.regexp_replace(F.regexp_extract(c, r"^([^?#]*)", 1), r"/$", "")


def profile_slug(c: Column) -> Column:
    """The slug of a person's or company's page."""
    return _match(c, r"(?i)/(?:in|company)/([^/?#]+)")


def _typed_url(c: Column) -> Column:
    """What a user typed as a url: without a scheme it is taken as https."""
    return F.when(c.rlike(r"(?i)^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def _mentions(c: Column, *domains: str) -> Column:
    return F.lower(c).rlike("|".join(re.escape(d) for d in domains))


def newsletter_handle(c: Column, domain: str = S.SITES["substack"][0]) -> Column:
    """The handle of a newsletter: /@handle at ``domain`` itself, or its sub-domain unless that is reserved.

    Bare words and own domains are none.
    """
    url = _typed_url(F.trim(c))
    own = host(url)
    sub = _match(own, rf"^([a-z0-9-]+)\.{re.escape(domain)}$")
    at = _match(path(url), r"^/@([A-Za-z0-9_-]+)")
    out = F.when(own.isin(domain, f"www.{domain}"), at).otherwise(F.when(~sub.isin(*NEWSLETTER_RESERVED), sub))
    return F.when(_mentions(c, domain), out)


#: Sub-domains that are no publication (fixed values).
NEWSLETTER_RESERVED = ("www", "open")
#: First path segments that are features, not profiles (fixed values).
PHOTO_RESERVED = ("p", "reel", "reels", "tv", "explore", "stories", "s", "accounts")


def photo_handle(c: Column, domain: str = S.SITES["instagram"][0]) -> Column:
    """The first path segment, lower case and without @, unless it is reserved; only of urls that name ``domain``."""
    url = _typed_url(F.trim(c))
    first = F.lower(_match(path(url), r"^/@?([A-Za-z0-9._]+)"))
    return F.when(_mentions(c, domain) & host(url).isNotNull() & ~first.isin(*PHOTO_RESERVED), first)


def photo_shortcode(c: Column, domain: str = S.SITES["instagram"][0]) -> Column:
    """The code of a photo or reel at ``domain``."""
    return _match(c, rf"(?i){re.escape(domain)}/(?:p|reel|tv)/([^/?#]+)")


def micro_blog_handle(c: Column, domains: Sequence[str] = S.SITES["twitter"]) -> Column:
    """C11: from a url that names one of ``domains``, or from @name or a bare name."""
    x = F.trim(c)
    named = _match(x, rf"(?i)(?:{'|'.join(re.escape(d) for d in domains)})/@?([A-Za-z0-9_]+)")
    return F.when(x.rlike(r"(?i)^https?://"), named).otherwise(_match(x, r"^@?([A-Za-z0-9_]+)$"))


def creator_input(c: Column, sites: dict[str, Sequence[str]] = S.SITES) -> dict[str, Column]:
    """Platform, profile_url and slug of a typed line, all null where it is no account.

    A network url counts without a slug too; what names no site is a short-post handle.
    """
    x = F.trim(c)
    named = lambda p: _mentions(x, *sites[p])
    letters, pics, chirp = sites["substack"][0], sites["instagram"][0], sites["twitter"]
    handle = F.when(named("linkedin"), profile_slug(plain_url(x))).when(named("substack"), newsletter_handle(x, letters)).when(named("instagram"), photo_handle(x, pics)).otherwise(micro_blog_handle(x, chirp))
    platform = F.when(named("linkedin"), "linkedin").when(handle.isNull(), None).when(named("substack"), "substack").when(named("instagram"), "instagram").otherwise("twitter")
    own = F.when(F.lower(x).contains(f"{letters}/@"), F.concat(F.lit(f"https://{letters}/@"), handle)).otherwise(F.concat(F.lit("https://"), handle, F.lit(f".{letters}")))
    url = F.when(platform == "linkedin", plain_url(x)).when(platform == "substack", own).when(platform == "instagram", F.concat(F.lit(f"https://www.{pics}/"), handle, F.lit("/"))).otherwise(F.concat(F.lit(f"https://{chirp[-1]}/"), handle))
    return {"platform": platform, "slug": handle, "profile_url": F.when(platform.isNotNull(), url)}


def safe_href(c: Column) -> Column:
    """The link if it is http or https, else null."""
    return F.when(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin("http", "https"), c)


def host_within(c: Column, *domains: str) -> Column:
    """Whether the host is one of the domains or below one."""
    own = host(c)
    out = F.lit(False)
    for d in domains:
        out |= (own == d) | own.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def expiry_seconds(c: Column) -> Column:
    """C14: when a signed url ends: hexadecimal oe=, without one decimal e=; null outside 2001 to 2100."""
    hexa = _match(c, r"[?&]oe=([0-9A-Fa-f]+)(?:&|$)")
    dec = _match(c, r"[?&]e=(\d+)(?:&|$)")
    seconds = F.when(hexa.isNotNull(), F.conv(hexa, 16, 10)).otherwise(dec).cast("double")
    return F.when(seconds.between(1_000_000_000, 4_102_444_800), seconds.cast("long"))


def expired(c: Column, now_s: Column) -> Column:
    """F16: whether a signed url has ended; unsigned ones never do."""
    return F.coalesce(expiry_seconds(c) <= now_s, F.lit(False))


def decoded_slug(c: Column) -> Column:
    """C17: the percent-decoded slug, or the raw one where decoding fails."""
    raw = profile_slug(c)
    return F.coalesce(F.try_url_decode(raw), raw)


def comment_ids(c: Column, group: int) -> Column:
    """Post (1) and comment (2) of a comment urn, raw or percent-encoded."""
    return _match(c, r"(?i)urn(?::|%3A)li(?::|%3A)comment(?::|%3A)(?:\(|%28)(?:urn(?::|%3A)li(?::|%3A))?(?:activity|ugcPost|share)(?::|%3A)(\d+)(?:,|%2C)(\d+)", group)


# --- texts and names ---------------------------------------------------------


def first_sentence(c: Column, most: int = 100) -> Column:
    """C20: up to the first full stop, exclamation or question mark; null for empty texts."""
    cut = F.substring(F.trim(F.regexp_extract(c, r"^([^.!?]*)", 1)), 1, most)
    return F.when(c != "", cut)


def looks_human(c: Column) -> Column:
    """Has white space or a capital letter."""
    return F.coalesce(c.rlike(r"\s|[A-Z]"), F.lit(False))


def fingerprint(author_id: Column, author_name: Column, content: Column) -> Column:
    """What tells two scrapes of one post apart from two posts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", text(author_id), text(author_name), F.substring(text(content), 1, 200))


def embedding_text(content: Column, image_description: Column) -> Column:
    """What is embedded: the trimmed text and, in brackets, what the image shows."""
    text = F.trim(F.coalesce(content, F.lit("")))
    image = F.trim(F.coalesce(image_description, F.lit("")))
    return F.when(image == "", text).when(text == "", F.concat(F.lit("[Image content: "), image, F.lit("]"))).otherwise(F.concat(text, F.lit("\n\n[Image content: "), image, F.lit("]")))


def account_label(name: Column, author_id: Column, url: Column) -> Column:
    """Name, else id, else the last part of the profile's path."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(author_id, F.lit("")), F.regexp_extract(plain_url(url), r"([^/]+)$", 1))


def media_type(media: Column) -> Column:
    """The type of a media value of a right shape; null if it is malformed or of another shape.

    An image has ``images``, all strings; a video a ``url`` and a ``poster``; a document a ``url``, ``title``, ``pages`` and ``cover``.
    All but the url may be null, but none may be absent.
    """
    v = F.try_parse_json(media)
    kind = F.try_variant_get(v, "$.type", "string")
    shape = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = lambda name: shape(name).isin("STRING", "VOID")
    number = shape("pages").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$")
    images = F.from_json(F.get_json_object(media, "$.images"), "array<string>")
    image = shape("images").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(images, lambda x: x.isNull())
    url = shape("url") == "STRING"
    ok = ((shape("type") == "STRING") & (((kind == "image") & image) | ((kind == "video") & url & text("poster")) | ((kind == "document") & url & text("title") & number & text("cover"))))
    return F.when(ok, kind)


def embedding_cost(characters: Column, per_million: float = 0.06) -> Column:
    """Four characters a token."""
    return F.ceil(characters / 4) / 1e6 * per_million
