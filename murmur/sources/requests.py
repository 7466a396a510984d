"""Inputs of remote collectors, as plain values; nothing here reaches a network."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

#: Time frames as the collectors name them; posts and notes that one account may give within them (fixed values).
POSTED_LIMIT = {"all": "any", "24h": "24h", "3d": "week", "week": "week", "month": "month", "3months": "3months", "custom": "any"}
POSTS_A_PROFILE = {"all": 500, "24h": 10, "3d": 20, "week": 30, "month": 50, "3months": 100, "custom": 50}
NOTES_AN_AUTHOR = {"all": 500, "24h": 20, "3d": 40, "week": 60, "month": 150, "3months": 300, "custom": 100}
#: What is collected where nothing else is stored (fixed values).
DEFAULT_PREFERENCES = {
    "linkedin": {"creators": True, "keywords": True, "timeframe": "week"},
    "twitter": {"creators": True, "keywords": True, "timeframe": "week", "minimumFavorites": 250},
    "substack": {"creators": True, "keywords": True, "timeframe": "week", "includeNotes": False},
    "instagram": {"creators": True, "keywords": False, "timeframe": "week"},
}
#: Platforms without a search by keywords.
NO_KEYWORDS = ("instagram",)
#: The largest image that is fetched.
MOST_IMAGE_BYTES = 8 << 20


def _given(**values: object) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def network_keywords(keywords: Sequence[str], timeframe: str) -> dict:
    """Posts of the professional network by keywords."""
    return {"searchQueries": list(keywords), "sortBy": "relevance", "postedLimit": POSTED_LIMIT[timeframe], "maxPosts": 200, "scrapeComments": False, "scrapeReactions": False}


def network_accounts(urls: Sequence[str], timeframe: str) -> dict:
    """Posts of its accounts, bounded by number and by date."""
    return {"targetUrls": list(urls), "maxPosts": POSTS_A_PROFILE[timeframe], "postedLimit": POSTED_LIMIT[timeframe]}


def network_comments(urls: Sequence[str]) -> dict:
    """All comments of posts, with replies."""
    return {"posts": list(urls), "maxItems": 0, "scrapeReplies": True}


def network_profiles(queries: Sequence[str], mode: str = "Profile details no email ($4 per 1k)") -> dict:
    """Profiles by url or identifier; ``mode`` is a fixed value of the collector."""
    return {"queries": list(queries), "profileScraperMode": mode}


def micro_blog_keywords(keywords: Sequence[str], favorites: int | None = None, start: str | None = None, end: str | None = None, language: str | None = None) -> dict:
    """Short posts by keywords."""
    return {"searchTerms": list(keywords), "maxItems": 200, "sort": "Top", **_given(minimumFavorites=favorites, start=start, end=end, tweetLanguage=language)}


def micro_blog_accounts(handles: Sequence[str], favorites: int | None = None) -> dict:
    """Short posts of accounts."""
    return {"twitterHandles": list(handles), "maxItems": 50, "sort": "Latest", **_given(minimumFavorites=favorites)}


def newsletter_keywords(keywords: Sequence[str], timeframe: str, since: str | None = None, until: str | None = None, reactions: int | None = None) -> dict:
    """Newsletters by keywords."""
    return {"searchQueries": list(keywords), "maxSearchResults": 25, "maxPostsPerPublication": POSTS_A_PROFILE[timeframe], **_given(dateFrom=since, dateTo=until, minReactions=reactions)}


def newsletter_accounts(handles: Sequence[str], timeframe: str, notes: bool = False, since: str | None = None, until: str | None = None, reactions: int | None = None) -> dict:
    """Articles of publications and, if asked for, the notes of their authors."""
    more = {"userHandles": list(handles), "includeNotes": True, "maxNotesPerAuthor": NOTES_AN_AUTHOR[timeframe]} if notes else {}
    return {"publicationHandles": list(handles), **more, "maxPostsPerPublication": POSTS_A_PROFILE[timeframe], **_given(dateFrom=since, dateTo=until, minReactions=reactions)}


def photo_accounts(targets: Sequence[str], timeframe: str, newer_than: str | None = None) -> dict:
    """Posts of photo accounts; there is no search by keywords."""
    return {"username": list(targets), "resultsLimit": POSTS_A_PROFILE[timeframe], **_given(onlyPostsNewerThan=newer_than)}


def preferences(stored: str | None) -> dict[str, dict]:
    """What to collect, from stored JSON over the defaults; whatever is broken or of another type takes its default.

    A floor of favourites holds above zero only and is a whole number.
    """
    try:
        given = json.loads(stored) if stored else {}
    except ValueError:
        given = {}
    given = given if isinstance(given, dict) else {}

    def one(platform: str) -> dict:
        base, own = DEFAULT_PREFERENCES[platform], given.get(platform)
        if not isinstance(own, dict):
            return dict(base)
        flag = lambda name: own[name] if isinstance(own.get(name), bool) else base[name]
        out = {"creators": flag("creators"), "keywords": platform not in NO_KEYWORDS and flag("keywords"), "timeframe": own["timeframe"] if isinstance(own.get("timeframe"), str) and own["timeframe"] in POSTED_LIMIT else base["timeframe"]}
        least = own.get("minimumFavorites", base.get("minimumFavorites"))
        if isinstance(least, (int, float)) and not isinstance(least, bool) and math.isfinite(least) and least > 0:
            out["minimumFavorites"] = math.floor(least)
        if "includeNotes" in base:
            out["includeNotes"] = flag("includeNotes")
        return out

    return {p: one(p) for p in DEFAULT_PREFERENCES}


def mode(preference: dict) -> str | None:
    """Both, creator or keyword; None if nothing is to be collected."""
    return {(True, True): "both", (True, False): "creator", (False, True): "keyword"}.get((preference["creators"], preference["keywords"]))


def image_refused(url: str, content_type: str | None = None, size: int | None = None) -> str | None:
    """Why an image is not embedded: it is no http(s) url, no image or too large; None if nothing is against it."""
    if not url.lower().startswith(("http://", "https://")):
        return "no http or https url"
    if content_type is not None and not content_type.split(";")[0].strip().startswith("image/"):
        return "no image"
    return "too large" if size is not None and size > MOST_IMAGE_BYTES else None
