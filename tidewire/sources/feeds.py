"""Landed feed documents (RSS and Atom) as articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import times
from tidewire.session import cut

# The named feeds and the defaults of a fetch.
FEED_PRESETS = (
    ("cna", "Channel News Asia", "https://www.channelnewsasia.com/api/v1/rss-outbound-feed?_format=xml"),
    ("st", "Straits Times", "https://www.straitstimes.com/news/singapore/rss.xml"),
    ("hn", "Hacker News", "https://hnrss.org/newest"),
    ("tr", "Technology Review", "https://www.technologyreview.com/feed/"),
)
DEFAULT_PRESET = "st"
DEFAULT_COUNT = 10

_ITEM = (
    "title string, link string, guid string, description string, `content:encoded` string, "
    "`dc:creator` string, author string, category array<string>, pubDate string, `dc:date` string, "
    "`media:thumbnail` struct<_url:string>, `itunes:image` struct<_href:string>"
)
_ENTRY = (
    "title string, link array<struct<_href:string,_rel:string>>, id string, summary string, "
    "content string, author array<struct<name:string>>, category array<struct<_term:string>>, "
    "updated string, published string"
)
_JSON_ITEM = (
    "struct<id:string,url:string,external_url:string,title:string,summary:string,content_html:string,"
    "content_text:string,image:string,date_published:string,date_modified:string,tags:array<string>,"
    "author:struct<name:string>,authors:array<struct<name:string>>>"
)
FEED_JSON = f"version string, title string, items array<{_JSON_ITEM}>"
# A feed element at the root, whatever stands in it.
ATOM_ROOT = r"(?is)^[\s\x{FEFF}]*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!doctype[^>]*>\s*)*<(?:\w+:)?feed[\s/>]"
FEED_XML = (
    f"channel struct<title:string, item array<struct<{_ITEM}>>>, item array<struct<{_ITEM}>>, "
    f"entry array<struct<{_ENTRY}>>, _corrupt_record string"
)


def feed_presets(spark: SparkSession) -> DataFrame:
    """The presets as a local relation, whose size the planner knows."""
    rows = ", ".join(f"('{preset}', '{name}', '{url}')" for preset, name, url in FEED_PRESETS)
    return spark.sql(f"select * from values {rows} as feeds(preset, name, url)")


def feeds_by_name(feeds: DataFrame) -> DataFrame:
    return feeds.orderBy("name")


def resolve_feeds(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """Requested feed (preset or URL) and item count with the defaults filled in.

    ``requests``: ``feed, count``.
    """
    asked = F.coalesce(X.nonempty(F.col("feed")), F.lit(DEFAULT_PRESET))
    known = feeds.select(F.col("preset").alias("_asked"), F.col("url").alias("_url"))
    return (
        requests.withColumn("_asked", asked)
        .join(known, "_asked", "left")
        .withColumn("feed_url", F.coalesce("_url", "_asked"))
        .withColumn(
            "count", F.when(F.coalesce("count", F.lit(0)) == 0, DEFAULT_COUNT).otherwise(F.col("count"))
        )
        .drop("_asked", "_url")
    )


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``feed, xml``: one row per landed file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("feed"), F.col("value").alias("xml"))


def _author(plain: Column) -> Column:
    """Name part of ``mail (name)``, else the text as it is."""
    named = F.regexp_extract(plain, r"\(([^)]*)\)", 1)
    return F.coalesce(X.first_nonempty(named, plain), F.lit(""))


def _rss_item(i: Column) -> Column:
    return F.struct(
        F.trim(i["title"]).alias("title"),
        F.trim(i["link"]).alias("link"),
        F.trim(i["guid"]).alias("guid"),
        i["description"].alias("description"),
        i["content:encoded"].alias("content"),
        F.coalesce(X.nonempty(_author(i["author"])), i["dc:creator"]).alias("author"),
        i["category"].alias("categories"),
        F.coalesce(X.nonempty(i["pubDate"]), i["dc:date"]).alias("published"),
        F.lit(None).cast("string").alias("updated"),
        F.coalesce(i["itunes:image"]["_href"], i["media:thumbnail"]["_url"]).alias("image"),
    )


def _atom_entry(e: Column) -> Column:
    main = F.get(
        F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)
    )
    return F.struct(
        F.trim(e["title"]).alias("title"),
        F.trim(F.coalesce(main, F.get(e["link"], F.lit(0)))["_href"]).alias("link"),
        F.trim(e["id"]).alias("guid"),
        e["summary"].alias("description"),
        e["content"].alias("content"),
        F.get(e["author"], F.lit(0))["name"].alias("author"),
        F.transform(e["category"], lambda x: x["_term"]).alias("categories"),
        e["published"].alias("published"),
        e["updated"].alias("updated"),
        F.lit(None).cast("string").alias("image"),
    )


def _json_item(i: Column) -> Column:
    return F.struct(
        F.trim(i["title"]).alias("title"),
        F.trim(F.coalesce(i["url"], i["external_url"])).alias("link"),
        F.trim(i["id"]).alias("guid"),
        i["summary"].alias("description"),
        F.coalesce(i["content_html"], i["content_text"]).alias("content"),
        F.coalesce(i["author"]["name"], F.get(i["authors"], F.lit(0))["name"]).alias("author"),
        i["tags"].alias("categories"),
        i["date_published"].alias("published"),
        i["date_modified"].alias("updated"),
        i["image"].alias("image"),
    )


def parse_feeds(documents: DataFrame) -> DataFrame:
    """``feed, items, error``: a document that is no feed is one error row.

    RSS 2.0 with its items in the channel, RSS 1.0 with them beside it, Atom and JSON feeds.
    """
    is_json = F.ltrim("xml").startswith("{")
    parsed = documents.select(
        "feed",
        F.from_xml(F.when(~is_json, F.col("xml")), FEED_XML, {"attributePrefix": "_"}).alias("x"),
        F.from_json(F.when(is_json, F.col("xml")), FEED_JSON).alias("j"),
        F.col("xml").rlike(ATOM_ROOT).alias("atom_root"),
    )
    is_rss = F.col("x.channel").isNotNull() | F.col("x.item").isNotNull()
    is_atom = F.col("x.entry").isNotNull() | F.col("atom_root")
    is_good_json = F.coalesce(F.col("j.version").contains("jsonfeed.org"), F.lit(False)) & F.col("j.items").isNotNull()
    none = F.filter(F.transform(F.array(F.lit(None)), lambda _: _atom_entry_null()), lambda _: F.lit(False))
    return parsed.select(
        "feed",
        F.when(is_good_json, F.transform("j.items", _json_item))
        .when(is_rss, F.coalesce(F.transform(F.coalesce("x.channel.item", "x.item"), _rss_item), none))
        .when(is_atom, F.coalesce(F.transform("x.entry", _atom_entry), none))
        .alias("items"),
        F.when(
            F.col("x._corrupt_record").isNotNull() | ~F.coalesce(is_good_json | is_rss | is_atom, F.lit(False)),
            "failed to parse feed",
        ).alias("error"),
    )


def _atom_entry_null() -> Column:
    text = F.lit(None).cast("string")
    names = ("title", "link", "guid", "description", "content", "author")
    return F.struct(
        *[text.alias(n) for n in names],
        F.lit(None).cast("array<string>").alias("categories"),
        *[text.alias(n) for n in ("published", "updated", "image")],
    )


def feed_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("feed", "error")


def feed_articles(parsed: DataFrame, fetched_at: datetime, count: int = DEFAULT_COUNT) -> DataFrame:
    """Articles of good feeds in feed order, the first ``count`` of each.

    The cut is on the item array, so later items are never exploded.
    """
    items = parsed.where("error is null").select(
        "feed", F.posexplode_outer(F.slice("items", 1, count)).alias("pos", "i")
    ).where("i is not null")
    none = F.lit(None).cast("string")
    return items.select(
        "feed",
        "pos",
        X.feed_item_id(F.col("i.link"), F.col("i.guid"), F.col("i.title")).alias("id"),
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.coalesce("i.link", F.lit("")).alias("url"),
        times.published_at(F.col("i.published"), F.col("i.updated")).alias("published_at"),
        F.lit(fetched_at).alias("fetched_at"),
        X.summary(F.col("i.description"), F.col("i.content")).alias("summary"),
        F.coalesce("i.author", F.lit("")).alias("author"),
        F.coalesce("i.categories", F.expr("cast(array() as array<string>)")).alias("categories"),
        *[none.alias(c) for c in ("full_content", "full_content_text", "excerpt")],
        F.coalesce("i.image", F.lit("")).alias("image_url"),
        none.alias("extraction_error"),
    )


def feed_scan(
    spark: SparkSession, path: str, fetched_at: datetime, count: int = DEFAULT_COUNT
) -> DataFrame:
    return feed_articles(parse_feeds(read_feed_files(spark, path)), fetched_at, count)


def in_feed_order(articles: DataFrame) -> DataFrame:
    """Add ``seq``: unique and increasing by feed and position.

    A range sort with increasing ids numbers all rows without one task seeing
    them all; writing pins the numbers, so that a retried task cannot change them.
    """
    ordered = articles.orderBy("feed", "pos").withColumn("seq", F.monotonically_increasing_id())
    return cut(ordered, "ordered")
