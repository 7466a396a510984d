"""Scalar functions over whole tables and over literal edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import scalars as c
from murmur.functions.persona import persona_key
from murmur.plans.corpus import CREATORS, POSTS, creators, posts
from murmur.plans.registry import query
from murmur.sources import settings as S
from murmur.sources.tables import table


def literals(spark: SparkSession, values: list[str | None], name: str = "x") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _values(values: list[str | None], name: str = "x") -> str:
    return "(VALUES " + ", ".join("(NULL)" if v is None else "('" + v.replace("'", "''") + "')" for v in values) + f") v({name})"


@query("C1_log", f"SELECT id, round(ln(1 + weighted_score), 6) AS lg, round(exp(ln(1 + weighted_score)) - 1, 4) AS back FROM {POSTS} WHERE weighted_score IS NOT NULL")
def logs(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["weighted_score"]).where("weighted_score IS NOT NULL")
    return rows.select("id", F.round(F.log1p("weighted_score"), 6).alias("lg"), F.round(F.expm1(F.log1p("weighted_score")), 4).alias("back"))


_BUCKET = "CASE WHEN likes >= 1000 THEN 'viral' WHEN likes >= 750 THEN 'great' WHEN likes >= 500 THEN 'good' WHEN likes >= 200 THEN 'ok' ELSE 'flop' END"


@query("C2_bucket", f"SELECT {_BUCKET} AS bucket, count(*) AS posts FROM {POSTS} GROUP BY 1")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["likes"]).groupBy(c.bucket(F.col("likes")).alias("bucket")).agg(F.count("*").alias("posts"))


def _decimal(x: str) -> str:
    """The text of a number to one decimal by its exact binary value, in DuckDB: printf rounds that value, ties to even, so those are told apart."""
    return f"CASE WHEN {x} * 20 = floor({x} * 20) AND {x} * 4 = floor({x} * 4) AND abs({x} * 2) <> floor(abs({x} * 2)) THEN printf('%.1f', {x} + sign({x}) * 0.01::DOUBLE) ELSE printf('%.1f', {x} + 0::DOUBLE) END"


@query("C3_badge", f"""SELECT id, CASE WHEN x_score IS NULL THEN CASE WHEN x_provisional = 1 THEN 'pending' ELSE 'none' END WHEN x_score >= 2.5 THEN 'green' WHEN x_score >= 1.5 THEN 'amber' WHEN x_score <= -1.5 THEN 'red' ELSE 'gray' END AS tone,
    CASE WHEN x_score IS NULL THEN CASE WHEN x_provisional = 1 THEN 'new' END ELSE {_decimal("x_score")} || 'σ' || coalesce(' · ' || CASE WHEN NOT isnan(x_factor) THEN {_decimal("x_factor")} END || '×', '') || CASE WHEN x_provisional = 1 AND age IS NOT NULL THEN ' (day ' || age || ')' ELSE '' END END AS label
    FROM (SELECT *, (epoch_ms(measured_at) - epoch_ms(posted_at)) // {S.DAY_MS} AS age FROM {POSTS})""")
def badges(spark: SparkSession, sf: str) -> DataFrame:
    """Tone and label of every post; the age is that at its last measurement, in whole days."""
    rows = posts(spark, sf, ["x_score", "x_factor", "x_provisional", "measured_at", "posted_at"])
    age = F.floor((F.unix_millis("measured_at") - F.unix_millis("posted_at")) / S.DAY_MS)
    z, p = F.col("x_score"), F.col("x_provisional")
    return rows.select("id", c.badge_tone(z, p).alias("tone"), c.badge_label(z, F.when(~F.isnan("x_factor"), F.col("x_factor")), p, age).alias("label"))


@query("C4_relative_time", f"""SELECT id, CASE WHEN posted_at IS NULL THEN 'never' WHEN s >= 2592000 THEN s // 2592000 || ' month' || CASE WHEN s // 2592000 = 1 THEN '' ELSE 's' END || ' ago' WHEN s >= 604800 THEN s // 604800 || ' week' || CASE WHEN s // 604800 = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s >= 86400 THEN s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN s >= 3600 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' WHEN s >= 60 THEN s // 60 || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' ELSE 'just now' END AS ago
    FROM (SELECT id, posted_at, greatest({S.NOW_MS} - epoch_ms(posted_at), 0) // 1000 AS s FROM {POSTS})""")
def ago(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["posted_at"]).select("id", c.relative_time(F.unix_millis("posted_at"), F.lit(S.NOW_MS)).alias("ago"))


@query("C5_Q25_persona", f"""SELECT profile_url, nullif(trim(regexp_replace(lower(regexp_replace(nfd, '[\u0300-\u036f]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '') AS persona FROM
    (SELECT profile_url, strip_accents(split_part(display_name, ',', 1)) AS nfd FROM {CREATORS} WHERE persona IS NULL OR persona = '')""")
def personas(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts without a persona and the key their name gives."""
    rows = creators(spark, sf, ["display_name", "persona"]).where("persona IS NULL OR persona = ''")
    return rows.select("profile_url", persona_key("display_name").alias("persona"))


@query("C6_C35_activity_id", f"SELECT id, nullif(regexp_extract(url, '(?:activity|ugcPost|share)[-:](\\d+)', 1), '') AS activity, coalesce(url, 'https://links.example/post/' || id) AS link FROM {POSTS}")
def activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["url"])
    return rows.select("id", c.activity_id(F.col("url")).alias("activity"), F.coalesce("url", F.concat(F.lit("https://links.example/post/"), "id")).alias("link"))


@query("C7_C8_C17_profile", "SELECT DISTINCT author_url, regexp_replace(regexp_extract(author_url, '^([^?#]*)', 1), '/$', '') AS plain, nullif(regexp_extract(author_url, '(?i)/(?:in|company)/([^/?#]+)', 1), '') AS slug FROM posts WHERE author_url IS NOT NULL")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("author_url")
    return table(spark, sf, "posts").where(u.isNotNull()).select("author_url", c.plain_url(u).alias("plain"), c.decoded_slug(u).alias("slug")).distinct()


_LETTERS, _PICS, _CHIRP = (S.TEST_SITES[x][0] for x in ("substack", "instagram", "twitter"))
#: All urls of the corpus: of posts, authors and accounts.
_URLS = "(SELECT DISTINCT x FROM (SELECT url AS x FROM posts UNION ALL SELECT author_url FROM posts UNION ALL SELECT profile_url FROM creators) WHERE x IS NOT NULL)"


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """(x): the distinct urls of posts, authors and accounts."""
    p, a = table(spark, sf, "posts"), table(spark, sf, "creators")
    both = p.select(F.explode(F.array("url", "author_url")).alias("x")).union(a.select("profile_url"))
    return both.where("x IS NOT NULL").distinct()


_TYPED = "CASE WHEN regexp_matches(trim(x), '^https?://', 'i') THEN trim(x) ELSE 'https://' || trim(x) END"


@query("C9_newsletter_handle", f"""SELECT x, CASE WHEN h IN ('letters.example', 'www.letters.example') THEN nullif(regexp_extract(p, '^/@([A-Za-z0-9_-]+)', 1), '') ELSE CASE WHEN sub NOT IN ('www', 'open', '') THEN sub END END AS handle
    FROM (SELECT x, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(u, '^https?://[^/?#]+(/[^?#]*)', 1) AS p, regexp_extract(lower(regexp_extract(u, '^https?://([^/?#]+)', 1)), '^([a-z0-9-]+)\\.letters\\.example$', 1) AS sub FROM (SELECT x, {_TYPED} AS u FROM {_URLS}))""")
def newsletter(spark: SparkSession, sf: str) -> DataFrame:
    return urls(spark, sf).select("x", c.newsletter_handle(F.col("x"), _LETTERS).alias("handle"))


@query("C10_photo", f"""SELECT x, CASE WHEN x ILIKE '%pics.example%' AND h NOT IN ('', 'p', 'reel', 'reels', 'tv', 'explore', 'stories', 's', 'accounts') THEN h END AS handle, nullif(regexp_extract(x, '(?i)pics\\.example/(?:p|reel|tv)/([^/?#]+)', 1), '') AS code
    FROM (SELECT x, lower(regexp_extract(regexp_extract({_TYPED}, '^https?://[^/?#]+(/[^?#]*)', 1), '^/@?([A-Za-z0-9._]+)', 1)) AS h FROM {_URLS})""")
def photo(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return urls(spark, sf).select("x", c.photo_handle(x, _PICS).alias("handle"), c.photo_shortcode(x, _PICS).alias("code"))


@query("C11_micro_blog_handle", f"""SELECT x, nullif(CASE WHEN regexp_matches(trim(x), '^https?://', 'i') THEN regexp_extract(trim(x), '(?i)chirp\\.example/@?([A-Za-z0-9_]+)', 1) ELSE regexp_extract(trim(x), '^@?([A-Za-z0-9_]+)$', 1) END, '') AS handle
    FROM (SELECT x FROM {_URLS} UNION SELECT '@' || author_id FROM posts WHERE author_id IS NOT NULL UNION SELECT author_id FROM posts WHERE author_id IS NOT NULL)""")
def micro_blog(spark: SparkSession, sf: str) -> DataFrame:
    """Handles from urls, from ids with @ and from bare ones."""
    ids = table(spark, sf, "posts").where("author_id IS NOT NULL").select("author_id").distinct()
    rows = urls(spark, sf).union(ids.select(F.explode(F.array(F.concat(F.lit("@"), "author_id"), "author_id")))).distinct()
    return rows.select("x", c.micro_blog_handle(F.col("x"), (_CHIRP,)).alias("handle"))


_MEDIA_URLS = f"(SELECT DISTINCT x FROM (SELECT unnest([url, image_url]) AS x FROM {POSTS} UNION ALL SELECT avatar_url FROM creators) WHERE x IS NOT NULL)"


def media_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf, ["url", "image_url"]).select(F.explode(F.array("url", "image_url")).alias("x"))
    return p.union(table(spark, sf, "creators").select("avatar_url")).where("x IS NOT NULL").distinct()


@query("C12_C13_links", f"""SELECT x, regexp_matches(x, '^https?:', 'i') AS safe, h = 'cdn.example' OR h LIKE '%.cdn.example' OR h = 'links.example' OR h LIKE '%.links.example' AS proxied FROM (SELECT x, lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h FROM {_MEDIA_URLS})""")
def links(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return media_urls(spark, sf).select("x", c.safe_href(x).isNotNull().alias("safe"), c.host_within(x, "cdn.example", "links.example").alias("proxied"))


_SIGNED = f"""(SELECT x || CASE h % 4 WHEN 0 THEN '?e=' || (1782777600 + h * 86400 - 200000000) WHEN 1 THEN '?w=1&oe=' || printf('%X', (1782777600 + h * 50000 - 100000000)::BIGINT) WHEN 2 THEN '?e=' || h ELSE '' END AS x FROM (SELECT x, len(x) * 131 % 4099 AS h FROM {_MEDIA_URLS}))"""


@query("C14_F16_signed_urls", f"""SELECT x, CASE WHEN s BETWEEN 1000000000 AND 4102444800 THEN s END AS ends, coalesce(s BETWEEN 1000000000 AND 4102444800 AND s <= {S.NOW_MS // 1000}, false) AS expired FROM
    (SELECT x, CASE WHEN regexp_matches(x, '[?&]oe=[0-9A-Fa-f]+(&|$)') THEN ('0x' || regexp_extract(x, '[?&]oe=([0-9A-Fa-f]+)', 1))::BIGINT WHEN regexp_matches(x, '[?&]e=[0-9]+(&|$)') THEN regexp_extract(x, '[?&]e=([0-9]+)', 1)::BIGINT END AS s FROM {_SIGNED})""")
def signed(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus's media urls hold no signature, so one is written after them by a rule on their length."""
    h = F.length("x") * 131 % 4099
    sign = F.when(h % 4 == 0, F.concat(F.lit("?e="), (1782777600 + h * 86400 - 200000000).cast("string"))).when(h % 4 == 1, F.concat(F.lit("?w=1&oe="), F.hex((1782777600 + h * 50000 - 100000000).cast("long")))).when(h % 4 == 2, F.concat(F.lit("?e="), h.cast("string"))).otherwise("")
    x = F.col("x")
    rows = media_urls(spark, sf).select(F.concat("x", sign).alias("x"))
    return rows.select("x", c.expiry_seconds(x).alias("ends"), c.expired(x, F.lit(S.NOW_MS // 1000)).alias("expired"))


@query("C16_comment_urn", "SELECT DISTINCT id, post_id AS post, id AS comment FROM (SELECT id, regexp_extract(post_id, '([0-9]+)$', 1) AS post_id FROM post_comments WHERE regexp_matches(id, '^[0-9]+$') AND regexp_matches(post_id, '[0-9]+$'))")
def urns(spark: SparkSession, sf: str) -> DataFrame:
    """Comment urns, percent-encoded for every other comment, built from the comments' ids and read back."""
    rows = table(spark, sf, "post_comments").where(F.col("id").rlike("^[0-9]+$") & F.col("post_id").rlike("[0-9]+$")).select("id", F.regexp_extract("post_id", "([0-9]+)$", 1).alias("p")).distinct()
    plain = F.concat(F.lit("urn:li:comment:(activity:"), "p", F.lit(","), "id", F.lit(")"))
    coded = F.concat(F.lit("https://links.example/x?commentUrn=urn%3Ali%3Acomment%3A%28activity%3A"), "p", F.lit("%2C"), "id", F.lit("%29"))
    x = F.when(F.length("id") % 2 == 0, coded).otherwise(plain)
    return rows.select("id", c.comment_ids(x, 1).alias("post"), c.comment_ids(x, 2).alias("comment"))


@query("C18_account_label", f"SELECT profile_url, coalesce(nullif(trim(display_name), ''), nullif(author_id, ''), regexp_extract(regexp_replace(regexp_extract(profile_url, '^([^?#]*)', 1), '/$', ''), '([^/]+)$', 1)) AS label FROM {CREATORS}")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = creators(spark, sf, ["display_name", "author_id"])
    return rows.select("profile_url", c.account_label(F.col("display_name"), F.col("author_id"), F.col("profile_url")).alias("label"))


@query("C20_first_sentence", f"SELECT id, CASE WHEN content <> '' THEN substr(trim(regexp_extract(content, '^([^.!?]*)', 1), ' '), 1, 100) END AS label FROM {POSTS}")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["content"]).select("id", c.first_sentence(F.col("content")).alias("label"))


@query("C21_T22_instants", f"SELECT id, epoch_ms(posted_at) AS iso_ms, epoch_ms(posted_at) // 1000 * 1000 AS micro_ms FROM {POSTS}")
def instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every post's instant written in both forms and read back."""
    rows = posts(spark, sf, ["posted_at"])
    iso = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    micro = F.date_format("posted_at", "EEE MMM dd HH:mm:ss Z yyyy")
    return rows.select("id", F.unix_millis(c.instant(iso)).alias("iso_ms"), F.unix_millis(c.micro_blog_instant(micro)).alias("micro_ms"))


@query("C23_C30_ages", f"SELECT id, CASE WHEN raw > 0 THEN floor(raw * 10 + 0.5) / 10 ELSE 0 END AS days FROM (SELECT id, (epoch_ms(scraped_at) - epoch_ms(posted_at)) / {S.DAY_MS}.0::DOUBLE AS raw FROM {POSTS} WHERE posted_at IS NOT NULL)")
def ages(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["posted_at", "scraped_at"]).where("posted_at IS NOT NULL")
    return rows.select("id", c.age_days(F.unix_millis("posted_at"), F.unix_millis("scraped_at")).alias("days"))


@query("C26_human_names", f"SELECT id, coalesce(regexp_matches(author_name, '\\s|[A-Z]'), false) AS human FROM {POSTS}")
def human(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["author_name"]).select("id", c.looks_human(F.col("author_name")).alias("human"))


@query("C29_U2_fingerprints", f"SELECT coalesce(author_id, '') || '|' || coalesce(author_name, '') || '|' || substr(coalesce(content, ''), 1, 200) AS print, min(id) AS first_id, count(*) AS copies FROM {POSTS} GROUP BY 1 HAVING count(*) > 1")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["author_id", "author_name", "content"])
    print_ = c.fingerprint(F.col("author_id"), F.col("author_name"), F.col("content")).alias("print")
    return rows.groupBy(print_).agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


_TEXT = "json_type(m, '$.{}') = 'VARCHAR'"
_TEXT_OR_NULL = "json_type(m, '$.{}') IN ('VARCHAR', 'NULL')"


@query("P2_C15_media", f"""SELECT id, CASE WHEN m IS NULL OR json_type(m, '$.type') <> 'VARCHAR' THEN NULL WHEN t = 'image' AND json_type(m, '$.images') = 'ARRAY' AND len(list_filter(json_extract(m, '$.images[*]'), lambda y: json_type(y) <> 'VARCHAR')) = 0 THEN t
    WHEN t = 'video' AND {_TEXT.format('url')} AND {_TEXT_OR_NULL.format('poster')} THEN t
    WHEN t = 'document' AND {_TEXT.format('url')} AND {_TEXT_OR_NULL.format('title')} AND json_type(m, '$.pages') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL') AND {_TEXT_OR_NULL.format('cover')} THEN t END AS media_type
    FROM (SELECT id, m, json_extract_string(m, '$.type') AS t FROM (SELECT id, CASE WHEN json_valid(media) THEN media::JSON END AS m FROM {POSTS}))""")
def media(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["media"]).select("id", c.media_type(F.col("media")).alias("media_type"))


@query("V12_embedding_text", f"SELECT id, CASE WHEN i = '' THEN t WHEN t = '' THEN '[Image content: ' || i || ']' ELSE t || chr(10) || chr(10) || '[Image content: ' || i || ']' END AS text FROM (SELECT id, trim(coalesce(content, ''), ' ') AS t, trim(coalesce(image_description, ''), ' ') AS i FROM {POSTS})")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf, ["content", "image_description"]).select("id", c.embedding_text(F.col("content"), F.col("image_description")).alias("text"))


@query("C36_A20_costs", f"SELECT platform, round(sum(ceil(length(coalesce(content, '')) / 4.0) / 1e6 * 0.06), 6) AS embedding_cost, round(count(*) * 0.002::DOUBLE, 6) AS refresh_cost FROM {POSTS} GROUP BY platform")
def costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts(spark, sf, ["platform", "content"])
    n = F.length(F.coalesce("content", F.lit("")))
    return rows.groupBy("platform").agg(F.round(F.sum(c.embedding_cost(n)), 6).alias("embedding_cost"), F.round(F.count("*") * 0.002, 6).alias("refresh_cost"))


@query("S15_csv_creators", "SELECT DISTINCT trim(profile_url) AS cell FROM creators WHERE trim(profile_url) <> ''")
def csv_creators(spark: SparkSession, sf: str) -> DataFrame:
    """First cells of an import list of all accounts: quotes off, blank lines and the header line dropped."""
    from murmur.sources.landing import first_cells

    rows = table(spark, sf, "creators").select((F.monotonically_increasing_id() + 2).alias("n"), F.concat(F.lit('  "'), F.coalesce("profile_url", F.lit("")), F.lit('" ,'), F.coalesce("tags", F.lit(""))).alias("value"))
    head = spark.createDataFrame([(0, "   "), (1, '"Profile_URL",tags')], "n long, value string")
    return first_cells(head.unionByName(rows)).select("cell").distinct()
