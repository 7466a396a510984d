"""Raw source records (JSON text) to post, profile and comment rows.

Fields are read with an explicit subset schema; a record that cannot be mapped has its reason in ``error`` and null fields, so one
bad record never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import scalars as sc
from murmur.operators.filters import mostly_latin
from murmur.sources import settings as S

POST = ("id", "platform", "url", "content", "author_name", "author_url", "author_id", "author_type", "likes", "shares", "comments", "posted_at", "is_repost", "market", "media", "image_url", "error")


def _s(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, "$." + path)


def _n(raw: Column, path: str) -> Column:
    return F.coalesce(_s(raw, path).try_cast("double").try_cast("long"), F.lit(0))


def _finish(df: DataFrame, **columns: Column) -> DataFrame:
    """The post columns; where ``error`` is set everything else is null."""
    bad = columns["error"].isNotNull()
    return df.select(*[columns[c].alias(c) if c == "error" else F.when(~bad, columns[c]).alias(c) for c in POST], "raw")


def _error(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.try_parse_json("raw").isNull(), "not JSON")
    for when, text in rules:
        out = out.when(when, text)
    return out


def image_media(urls: Column) -> Column:
    return F.when(F.size(urls) > 0, F.to_json(F.struct(F.lit("image").alias("type"), urls.alias("images"))))


def video_media(url: Column, poster: Column) -> Column:
    return F.when(url.isNotNull(), F.to_json(F.struct(F.lit("video").alias("type"), url.alias("url"), poster.alias("poster")), {"ignoreNullFields": "false"}))


def document_media(url: Column, title: Column, pages: Column, cover: Column) -> Column:
    return F.when(url.isNotNull(), F.to_json(F.struct(F.lit("document").alias("type"), url.alias("url"), title.alias("title"), pages.alias("pages"), cover.alias("cover")), {"ignoreNullFields": "false"}))


def _strings(raw: Column, path: str) -> Column:
    return F.coalesce(F.from_json(_s(raw, path), "array<string>"), F.array().cast("array<string>"))


def _present(c: Column) -> Column:
    """Not null and not empty."""
    return F.coalesce(c != "", F.lit(False))


def _at(*parts: Column | str) -> Column:
    """A url of parts; null if one is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def network_posts(df: DataFrame, market: str | None = None, site: str = S.SITES["linkedin"][0]) -> DataFrame:
    """M1: posts of the professional network. The id is the number of the urn in the url, else the record's id; the url is rebuilt from it.

    C15: a document goes before a video, a video before images; what is shown small is the last image of the document's first page, the
    poster or the first image.
    """
    r = F.col("raw")
    number = F.coalesce(sc.activity_id(_s(r, "linkedinUrl")), F.nullif(_s(r, "id"), F.lit("")))
    images = F.filter(F.transform(F.coalesce(F.from_json(_s(r, "postImages"), "array<struct<url:string>>"), F.array().cast("array<struct<url:string>>")), lambda x: x["url"]), _present)
    pages = F.from_json(_s(r, "document.coverPages"), "array<struct<imageUrls:array<string>>>")
    cover = F.when(F.size(F.get(pages, F.lit(0))["imageUrls"]) > 0, F.element_at(F.get(pages, F.lit(0))["imageUrls"], -1))
    document, video, poster = F.nullif(_s(r, "document.transcribedDocumentUrl"), F.lit("")), F.nullif(_s(r, "postVideo.videoUrl"), F.lit("")), _s(r, "postVideo.thumbnailUrl")
    media = F.coalesce(document_media(document, _s(r, "document.title"), _s(r, "document.totalPageCount").try_cast("int"), cover), video_media(video, poster), image_media(images))
    shown = F.when(document.isNotNull(), cover).when(video.isNotNull(), poster).otherwise(F.get(images, F.lit(0)))
    return _finish(
        df, id=number, platform=F.lit("linkedin"), url=_at(f"https://www.{site}/feed/update/urn:li:activity:", number, "/"), content=_s(r, "content"), author_name=_s(r, "author.name"), author_url=_s(r, "author.linkedinUrl"),
        author_id=F.coalesce(_s(r, "author.universalName"), _s(r, "author.publicIdentifier")), author_type=_s(r, "author.type"), likes=_n(r, "engagement.likes"), shares=_n(r, "engagement.shares"), comments=_n(r, "engagement.comments"),
        posted_at=sc.instant(_s(r, "postedAt.date")), is_repost=_s(r, "repostedBy").isNotNull().cast("int"), market=F.lit(market).cast("string"), media=media, image_url=shown, error=_error((number.isNull(), "no id")),
    )


def micro_blog_posts(df: DataFrame, market: str | None = None, site: str = S.SITES["twitter"][-1]) -> DataFrame:
    """M2: short posts; a broken date is an error, the name is the handle; media are not mapped."""
    r = F.col("raw")
    at = sc.micro_blog_instant(_s(r, "createdAt"))
    handle = _s(r, "author.userName")
    number = F.nullif(_s(r, "id"), F.lit(""))
    none = F.lit(None).cast("string")
    return _finish(
        df, id=F.concat(F.lit("tweet-"), number), platform=F.lit("twitter"), url=F.coalesce(_s(r, "url"), _s(r, "twitterUrl")), content=_s(r, "text"), author_name=handle, author_url=F.when(_present(handle), _at(f"https://{site}/", handle)),
        author_id=handle, author_type=F.when(_s(r, "author.isBlueVerified") == "true", "verified").otherwise("profile"), likes=_n(r, "likeCount"), shares=_n(r, "retweetCount"), comments=_n(r, "replyCount"), posted_at=at,
        is_repost=(F.coalesce(_s(r, "isRetweet"), F.lit("false")) == "true").cast("int"), market=F.lit(market).cast("string"), media=none, image_url=none, error=_error((number.isNull(), "no id"), (at.isNull(), "bad date")),
    )


def _joined(*parts: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.array(*parts), _present), "\n\n"), F.lit(""))


def newsletter_posts(df: DataFrame, market: str | None = None, site: str = S.SITES["substack"][0]) -> DataFrame:
    """M3, M4: articles, and notes where ``type`` says so; a note without text takes the title of what it passes on.

    F15: records of another type (authors, publications) and notes that hold no text, image or passed-on article are errors.
    """
    r = F.col("raw")
    kind = F.coalesce(_s(r, "type"), F.lit("post"))
    note = kind == "note"
    number = F.nullif(F.when(note, _s(r, "id")).otherwise(F.coalesce(_s(r, "id"), _s(r, "slug"))), F.lit(""))
    body = F.when(_present(F.trim(_s(r, "body"))), _s(r, "body"))
    handle = F.when(note, _s(r, "authorHandle")).otherwise(_s(r, "publicationHandle"))
    images = F.when(note, F.filter(_strings(r, "attachmentUrls"), _present)).otherwise(F.filter(F.array(_s(r, "coverImage")), _present))
    empty = note & body.isNull() & (F.size(_strings(r, "attachmentUrls")) == 0) & _s(r, "restackedPost").isNull() & _s(r, "restackedPublication").isNull()
    whose = F.when(_present(handle), F.when(note, _at(f"https://{site}/@", handle)).otherwise(_at("https://", handle, f".{site}")))
    return _finish(
        df, id=F.concat(F.when(note, "substack-note-").otherwise("substack-"), number), platform=F.lit("substack"), url=F.when(note, _at(whose, "/note/c-", number)).otherwise(_s(r, "url")),
        content=F.when(note, F.coalesce(body, _s(r, "restackedPost.title"))).otherwise(_joined(_s(r, "title"), _s(r, "subtitle"), _s(r, "bodyMarkdown"))),
        author_name=F.when(note, F.coalesce(_s(r, "authorName"), handle)).otherwise(F.coalesce(_s(r, "author.name"), _s(r, "publicationName"), handle)), author_url=F.when(note, whose).otherwise(F.coalesce(_s(r, "publicationUrl"), whose)),
        author_id=handle, author_type=F.lit("profile"), likes=_n(r, "reactionCount"), shares=F.when(note, 0).otherwise(_n(r, "restackCount")), comments=F.when(note, 0).otherwise(_n(r, "commentCount")),
        posted_at=sc.instant(F.when(note, _s(r, "createdAt")).otherwise(_s(r, "publishedAt"))), is_repost=(note & (F.coalesce(_s(r, "kind"), F.lit("")) == "restack")).cast("int"), market=F.lit(market).cast("string"),
        media=image_media(images), image_url=F.get(images, F.lit(0)), error=_error((~kind.isin("post", "note"), "no content"), (number.isNull(), "no id"), (empty, "empty note")),
    )


def photo_posts(df: DataFrame, market: str | None = None, site: str = S.SITES["instagram"][0]) -> DataFrame:
    """M5: photos, videos and albums; there are no shares. A video without a file counts as its poster."""
    r = F.col("raw")
    code = F.nullif(F.coalesce(_s(r, "shortCode"), _s(r, "id")), F.lit(""))
    album = F.filter(_strings(r, "images"), _present)
    images = F.when(F.size(album) > 0, album).otherwise(F.filter(F.array(_s(r, "displayUrl")), _present))
    video = F.when(_s(r, "type") == "Video", F.nullif(_s(r, "videoUrl"), F.lit("")))
    owner = _s(r, "ownerUsername")
    return _finish(
        df, id=F.concat(F.lit("instagram-"), code), platform=F.lit("instagram"), url=F.coalesce(_s(r, "url"), _at(f"https://www.{site}/p/", F.nullif(_s(r, "shortCode"), F.lit("")), "/")), content=_s(r, "caption"), author_name=F.coalesce(_s(r, "ownerFullName"), owner),
        author_url=F.when(_present(owner), _at(f"https://www.{site}/", owner, "/")), author_id=owner, author_type=F.lit("profile"), likes=_n(r, "likesCount"), shares=F.lit(0).cast("long"), comments=_n(r, "commentsCount"),
        posted_at=sc.instant(_s(r, "timestamp")), is_repost=F.lit(0), market=F.lit(market).cast("string"), media=F.coalesce(video_media(video, _s(r, "displayUrl")), image_media(images)), image_url=F.when(video.isNotNull(), _s(r, "displayUrl")).otherwise(F.get(images, F.lit(0))), error=_error((code.isNull(), "no id")),
    )


def profiles(df: DataFrame) -> DataFrame:
    """M6: profiles; the name is put together from its parts, where there are none it is the record's; empty lists are null, missing counts 0."""
    r = F.col("raw")
    listed = lambda p: F.when(F.coalesce(F.json_array_length(_s(r, p)), F.lit(0)) > 0, _s(r, p))
    name = F.coalesce(F.nullif(F.array_join(F.filter(F.array(_s(r, "firstName"), _s(r, "lastName")), _present), " "), F.lit("")), F.nullif(_s(r, "name"), F.lit("")))
    place = F.coalesce(_s(r, "location.linkedinText"), _s(r, "location.text"), F.when(~F.coalesce(_s(r, "location"), F.lit("")).startswith("{"), _s(r, "location")))
    slug = F.coalesce(_s(r, "publicIdentifier"), sc.profile_slug(_s(r, "linkedinUrl")))
    return df.select(
        slug.alias("id"), name.alias("name"), _s(r, "headline").alias("headline"), place.alias("location"), _n(r, "followerCount").alias("followers"), _n(r, "connectionsCount").alias("connections"),
        *[listed(p).alias(p) for p in ("experience", "education", "skills")], "raw",
    )


_REPLY = "id:string,linkedinUrl:string,commentary:string,createdAt:string,pinned:boolean,edited:boolean,engagement:struct<likes:long,comments:long>,actor:struct<type:string,universalName:string,publicIdentifier:string,name:string,linkedinUrl:string,position:string,author:boolean>"
_COMMENT = f"struct<{_REPLY},postId:string,replies:array<struct<{_REPLY}>>>"


def comments(df: DataFrame) -> DataFrame:
    """M7: a comment and its replies, one row each; a reply names its parent and takes its post."""
    top = df.select(F.from_json("raw", _COMMENT).alias("c"))
    number = lambda x: F.coalesce(sc.comment_ids(x["linkedinUrl"], 2), x["id"])
    post = F.coalesce(sc.comment_ids(F.col("c.linkedinUrl"), 1), F.col("c.postId"))
    flat = lambda x, parent: F.struct(number(x).alias("id"), parent.alias("parent_comment_id"), x["actor"]["name"].alias("author_name"), F.coalesce(x["actor"]["universalName"], x["actor"]["publicIdentifier"]).alias("author_id"), F.coalesce(x["actor"]["author"], F.lit(False)).cast("int").alias("is_post_author"), x["commentary"].alias("text"), F.coalesce(x["engagement"]["likes"], F.lit(0)).alias("likes"), F.coalesce(x["engagement"]["comments"], F.lit(0)).alias("replies"), F.coalesce(x["pinned"], F.lit(False)).cast("int").alias("pinned"), F.coalesce(x["edited"], F.lit(False)).cast("int").alias("edited"), sc.instant(x["createdAt"]).alias("commented_at"))
    replies = F.coalesce(F.transform("c.replies", lambda x: flat(x, number(F.col("c")))), F.array())
    rows = top.withColumn("post_id", post).select("post_id", F.explode(F.concat(F.array(flat(F.col("c"), F.lit(None).cast("string"))), replies)).alias("r"))
    return rows.select("post_id", "r.*").where("id IS NOT NULL")


def accepted(mapped: DataFrame) -> DataFrame:
    """M8: mapped rows without an error that pass the language gate."""
    return mapped.where(F.col("error").isNull() & mostly_latin(F.col("content"))).drop("error")
