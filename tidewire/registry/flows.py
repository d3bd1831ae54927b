"""Queries of feed, page and message sources, of streams, and of whole runs."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.functions import text as X
from tidewire.functions.captions import ass_header
from tidewire.operators import runs as R
from tidewire.operators.embedders import DenseEmbedder, TermEmbedder
from tidewire.operators.stories import SEGMENT_MARK, append_concat
from tidewire.plans.captioning import caption
from tidewire.plans.ingest import ingest
from tidewire.plans.state import State
from tidewire.registry.base import (
    MESSAGE_ROWS, NOW, SQL_MESSAGES, SQL_TITLE, message_values, register, table,
)
from tidewire.registry.dedups import (
    SQL_EXACT, SQL_PAGE_TEXT, SQL_TERM_SIMS, SQL_VECTORS, THRESHOLD, _RESULT, _SQL_DENSE, _dense,
    _vector_articles, sql_walk,
)
from tidewire.registry.reports import _sql_text
from tidewire.registry.stores import PAIR_THRESHOLD
from tidewire.schemas import STORY_SEGMENT
from tidewire.session import cut, scratch_path, widen
from tidewire.sources import feeds as FD
from tidewire.sources import messages as MS
from tidewire.sources.pages import page_extract, page_lookup
from tidewire.streaming import messages as SM
from tidewire.streaming.state import StateFolder, dedup_stream, run_batch

SEGMENT_SPLIT = SEGMENT_MARK.replace("-", "[-]")

# Files of one row that a task writes, on average: small tables are else written by one task.
FILES_PER_TASK = 250

# -- feeds ------------------------------------------------------------------

ITEMS_PER_FEED = 12


def _xml(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def feed_documents(spark, sf) -> DataFrame:
    """Pages as feeds of twelve items, RSS and Atom in turn; every tenth feed is broken."""
    n = F.col("page_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    title = _xml(F.coalesce(H.html_title(F.col("html")), F.lit("")))
    link = F.when(n % 7 == 0, "").otherwise(_xml(F.col("url")))
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), link,
        F.lit("</link><guid>guid-"), n, F.lit("</guid><description><![CDATA[<p>about "), n,
        F.lit("</p>]]></description><dc:creator>author "), (n % 5).cast("string"),
        F.lit("</dc:creator><category>a"), (n % 3).cast("string"), F.lit("</category><category>b</category><pubDate>"),
        F.date_format(F.to_date(day), "EEE, dd MMM yyyy"), F.lit(' 10:00:00 +0000</pubDate><media:thumbnail url="https://i.example.org/'),
        n, F.lit('.png"/></item>'),
    )
    atom = F.concat(
        F.lit("<entry><title>"), title, F.lit('</title><link rel="alternate" href="'), link,
        F.lit('"/><id>guid-'), n, F.lit("</id><content>about "), n,
        F.lit("</content><author><name>author "), (n % 5).cast("string"),
        F.lit('</name></author><category term="a'), (n % 3).cast("string"),
        F.lit('"/><category term="b"/><updated>'), day, F.lit("T10:00:00Z</updated></entry>"),
    )
    no = F.floor(n / ITEMS_PER_FEED)
    items = widen(table(spark, sf, "pages")).select(
        no.alias("no"), n.alias("n"), F.when(no % 2 == 0, rss).otherwise(atom).alias("x")
    )
    body = F.array_join(F.array_sort(F.collect_list(F.struct("n", "x")))["x"], "")
    grouped = items.groupBy("no").agg(body.alias("b"))
    head = F.lit('<rss xmlns:dc="d" xmlns:media="m" version="2.0"><channel><title>feed</title>')
    xml = F.when(F.col("no") % 10 == 9, F.concat(F.lit("<rss><channel>"), F.col("b"))).when(
        F.col("no") % 2 == 0, F.concat(head, F.col("b"), F.lit("</channel></rss>"))
    ).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.col("b"), F.lit("</feed>")))
    return grouped.select(F.format_string("feed-%06d", "no").alias("feed"), xml.alias("xml"))


_SQL_FEED = f"""
items as (
  select page_id as n, page_id // {ITEMS_PER_FEED} as no, page_id % {ITEMS_PER_FEED} as pos, url, html, {SQL_TITLE} as title,
         case when page_id % 7 = 0 then '' else url end as link from pages),
feed_arts as (
  select format('feed-{{:06d}}', no) as feed, pos, n, title, link,
    substr(sha256(case when link <> '' then link else 'guid-' || n end), 1, 16) as id,
    timestamp '2024-01-01 10:00:00' + to_days((n % 28)::int) as published,
    case when no % 2 = 0 then '<p>about ' || n || '</p>' else 'about ' || n end as summary,
    'author ' || (n % 5) as author, 'a' || (n % 3) || '|b' as categories,
    case when no % 2 = 0 then 'https://i.example.org/' || n || '.png' else '' end as image_url
  from items where no % 10 <> 9 and pos < 10)
"""


def _feed_rows(articles: DataFrame) -> DataFrame:
    return articles.select(
        "feed", F.col("pos").cast("long"), "id", "title", "url",
        F.unix_seconds("published_at").alias("published_s"), "summary", "author",
        F.array_join("categories", "|").alias("categories"), "image_url",
    )


_SQL_FEED_ROWS = """select feed, pos, id, title, link as url, epoch(published)::bigint as published_s, summary, author,
  categories, image_url from feed_arts"""


@register("SRC1_feed_scan", f"with {_SQL_FEED} {_SQL_FEED_ROWS}")
def src1(spark, sf):
    """Feeds written one per file and scanned from the folder."""
    path = scratch_path(spark, "feeds")
    docs = cut(feed_documents(spark, sf), "feeds")
    tasks = -(-docs.count() // FILES_PER_TASK) or 1
    docs.select("feed", F.col("xml").alias("value")).repartition(tasks, "feed").write.partitionBy("feed").text(path)
    landed = FD.read_feed_files(spark, f"{path}/*/*.txt").withColumn(
        "feed", F.regexp_extract("feed", "(feed-[0-9]+)", 1)
    )
    return _feed_rows(FD.feed_articles(FD.parse_feeds(landed), NOW))


@register(
    "PRJ5_author_categories_image",
    f"with {_SQL_FEED} select feed, pos, author, categories, image_url from feed_arts",
)
def prj5(spark, sf):
    rows = FD.feed_articles(FD.parse_feeds(feed_documents(spark, sf)), NOW)
    return _feed_rows(rows).select("feed", "pos", "author", "categories", "image_url")


@register(
    "WIN4_first_n_items",
    f"with {_SQL_FEED} select feed, pos, id from feed_arts where pos < 3",
)
def win4(spark, sf):
    rows = FD.feed_articles(FD.parse_feeds(feed_documents(spark, sf)), NOW, 3)
    return rows.select("feed", F.col("pos").cast("long"), "id")


@register(
    "SET1_feed_union",
    f"""with {_SQL_FEED} select feed, pos + 1 as place, id, '' as error from feed_arts
        union all select distinct format('feed-{{:06d}}', no), 0, '', 'failed to parse feed' from items where no % 10 = 9""",
)
def set1(spark, sf):
    """Articles of all good feeds, numbered in feed order; the broken feeds beside them."""
    parsed = FD.parse_feeds(feed_documents(spark, sf))
    ordered = FD.in_feed_order(FD.feed_articles(parsed, NOW))
    place = F.row_number().over(Window.partitionBy("feed").orderBy("seq")).cast("long")
    placed = ordered.select("feed", place.alias("place"), "id", F.lit("").alias("error"))
    errors = FD.feed_errors(parsed).select(
        "feed", F.lit(0).cast("long").alias("place"), F.lit("").alias("id"), "error"
    )
    return placed.unionByName(errors)


@register(
    "SRC2_feed_presets",
    "select 'cna' as preset, count(*) as requests, 'https://www.channelnewsasia.com/api/v1/rss-outbound-feed?_format=xml' as url from customer where c_nationkey % 4 = 0 "
    "union all select 'hn', count(*), 'https://hnrss.org/newest' from customer where c_nationkey % 4 = 1 "
    "union all select 'st', count(*), 'https://www.straitstimes.com/news/singapore/rss.xml' from customer where c_nationkey % 4 = 2 "
    "union all select 'tr', count(*), 'https://www.technologyreview.com/feed/' from customer where c_nationkey % 4 = 3",
)
def src2(spark, sf):
    """The four named feeds, each with the customers that ask for it."""
    names = F.array(*[F.lit(p) for p in ("cna", "hn", "st", "tr")])
    asked = table(spark, sf, "customer").select(F.get(names, F.col("c_nationkey") % 4).alias("preset"))
    counts = asked.groupBy("preset").agg(F.count("*").alias("requests"))
    return counts.join(FD.feed_presets(spark).drop("name"), "preset")


# -- pages ------------------------------------------------------------------


def _listed(spark, sf):
    """Articles naming their page; every ninth has no URL, every tenth names a page that is not there."""
    n = F.col("page_id")
    none = F.lit(None).cast("string")
    return table(spark, sf, "pages").select(
        n.alias("seq"),
        F.when(n % 9 == 0, "").when(n % 10 == 1, F.concat("url", F.lit("#gone"))).otherwise(F.col("url")).alias("url"),
        F.when(n % 2 == 0, "").otherwise("staff").alias("author"),
        F.when(n % 3 == 0, "").otherwise("i.png").alias("image_url"),
        *[none.alias(c) for c in ("full_content", "full_content_text", "excerpt", "extraction_error")],
    )


_SQL_LISTED = """
listed as (
  select page_id as seq, case when page_id % 9 = 0 then '' when page_id % 10 = 1 then url || '#gone' else url end as url,
    case when page_id % 2 = 0 then '' else 'staff' end as author,
    case when page_id % 3 = 0 then '' else 'i.png' end as image_url from pages)
"""


@register(
    "SRC3_page_extract",
    f"""with {SQL_PAGE_TEXT}, {_SQL_LISTED}
        select l.seq, md5(p.content) as content_md5, md5(p.text) as text_md5, md5(split_part(p.text, chr(10), 1)) as excerpt_md5,
          l.author, l.image_url,
          case when l.url = '' then 'article URL is empty' when p.url is null then 'page not found' end as extraction_error
        from listed l left join page_text p on p.url = l.url""",
)
def src3(spark, sf):
    out = page_extract(_listed(spark, sf), widen(table(spark, sf, "pages")))
    return out.select(
        "seq", F.md5("full_content").alias("content_md5"), F.md5("full_content_text").alias("text_md5"),
        F.md5("excerpt").alias("excerpt_md5"), "author", "image_url", "extraction_error",
    )


@register(
    "PRJ6_enrich_fill",
    f"""select page_id, case when page_id % 2 = 0 then case when page_id % 5 = 0 then '' else coalesce({SQL_TITLE}, '') end
            else 'staff' end as author from pages""",
)
def prj6(spark, sf):
    n = F.col("page_id")
    old = F.when(n % 2 == 0, "").otherwise("staff")
    found = F.when(n % 5 != 0, H.html_title(F.col("html")))
    return table(spark, sf, "pages").select("page_id", X.enrich_fill(old, found).alias("author"))


@register(
    "JN6_page_lookup",
    f"""with {_SQL_LISTED}, t as (select url, {SQL_TITLE} as page_title from pages)
        select seq, page_title from listed left join t using (url)""",
)
def jn6(spark, sf):
    return page_lookup(_listed(spark, sf), table(spark, sf, "pages")).select("seq", "page_title")


# -- messages ---------------------------------------------------------------


def _landed_messages(spark, sf, batches: int = 4) -> tuple[str, int]:
    """Messages landed in files of bounded rows: their folder, and how many files a batch takes."""
    path = scratch_path(spark, "topic")
    each = max(1, -(-table(spark, sf, "events").count() // (batches * MESSAGE_ROWS)))
    message_values(spark, sf).repartitionByRange(batches * each, "offset").write.parquet(path)
    return path, each


@register("SRC6_message_source", f"""with {SQL_MESSAGES} select topic, "offset", key, md5(value) as value_md5 from raw""")
def src6(spark, sf):
    """The envelope read as a stream of landed files, written as it comes."""
    out, check = scratch_path(spark, "envelopes"), scratch_path(spark, "stream")
    stream = MS.file_message_source(spark, *_landed_messages(spark, sf))
    stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("topic", "offset", "key", F.md5("value").alias("value_md5"))


def _message_files(spark, sf) -> str:
    """One file per conversation: even ones ``.json``, odd ones ``.txt``; some broken or failed.

    A file costs milliseconds however small it is, so a task writes few of them.
    """
    turns = cut(table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")), "turns")
    tasks = -(-turns.count() // FILES_PER_TASK) or 1
    n = F.col("conv_id")
    whole = F.concat(
        F.lit('{"uuid":"c'), n, F.lit('","status":"'), F.when(n % 5 == 0, "failure").otherwise("success"),
        F.lit('","title":"t'), F.col("turns"), F.lit('"}'),
    )
    rows = turns.select(n, F.when(n % 7 == 0, F.lit('{"uuid":')).otherwise(whole).alias("value"))
    path = scratch_path(spark, "inbox")

    def dealt(part: DataFrame):
        return part.repartition(tasks, "conv_id").write.partitionBy("conv_id")

    dealt(rows.where(n % 2 == 1)).text(f"{path}/t")
    # The text writer names its files .txt; the JSON writer gives .json.
    as_json = rows.where((n % 2 == 0) & (n % 7 != 0)).select(
        n, F.concat(F.lit("c"), n).alias("uuid"), F.get_json_object("value", "$.status").alias("status"),
        F.get_json_object("value", "$.title").alias("title"),
    )
    dealt(as_json).json(f"{path}/j")
    dealt(rows.where((n % 2 == 0) & (n % 7 == 0))).text(f"{path}/b")
    return path


_SQL_FILES = """
f as (select conv_id as n, count(*) as turns from conversations group by 1)
"""


@register(
    "SRC7_json_dir_scan",
    f"""with {_SQL_FILES} select n as conv_id, case when n % 7 <> 0 then 'c' || n end as uuid,
          case when n % 7 <> 0 then 't' || turns end as title,
          case when n % 7 = 0 then 'cannot decode message' when n % 5 = 0 then 'input status is not success: failure' end as file_error
        from f""",
)
def src7(spark, sf):
    rows = MS.json_dir_scan(spark, _message_files(spark, sf), nested=True)
    number = F.regexp_extract("file", "conv_id=([0-9]+)", 1).cast("long")
    return rows.select(number.alias("conv_id"), "uuid", "title", "file_error")


@register(
    "SET2_file_union",
    f"""with {_SQL_FILES} select case when n % 2 = 1 or n % 7 = 0 then 'txt' else 'json' end as kind, count(*) as files from f group by 1""",
)
def set2(spark, sf):
    files = MS.read_message_files(spark, _message_files(spark, sf), nested=True)
    kind = F.regexp_extract("file", r"\.([a-z]+)\z", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


@register(
    "SRC8_article_intake",
    """select event_id, case when event_id % 11 = 0 or event_id % 13 = 0 then null else 'a' || event_id end as id,
         case when event_id % 11 = 0 or event_id % 13 = 0 then null else event_type end as title,
         case when event_id % 11 = 0 or event_id % 13 = 0 then null else event_type || '|x' end as categories,
         case when event_id % 11 = 0 or event_id % 13 = 0 then null else epoch(date_trunc('second', ts))::bigint end as published_s,
         case when event_id % 11 = 0 then 'invalid JSON' when event_id % 13 = 0 then 'article is required' end as reject_reason
       from events""",
)
def src8(spark, sf):
    n = F.col("event_id")
    article = F.concat(
        F.lit('{"article":{"id":"a'), n, F.lit('","title":"'), F.col("event_type"), F.lit('","content":"ignored","categories":["'),
        F.col("event_type"), F.lit('","x"],"published_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}}'),
    )
    value = F.when(n % 11 == 0, '{"article":').when(n % 13 == 0, '{"text":"no article"}').otherwise(article)
    rows = MS.article_intake(table(spark, sf, "events").select(n, value.alias("value")))
    return rows.select(
        "event_id", "id", "title", F.array_join("categories", "|").alias("categories"),
        F.unix_seconds("published_at").alias("published_s"), "reject_reason",
    )


# -- streams ----------------------------------------------------------------


@register(
    "STR1_typed_decode",
    f"""with {SQL_MESSAGES} select "offset", uuid, status, case when not ok then 'cannot decode message' end as decode_error from msg""",
)
def str1(spark, sf):
    return MS.decode(message_values(spark, sf)).select("offset", "uuid", "status", "decode_error")


_SQL_REASON = """case when not ok then 'cannot decode message'
  when coalesce(status, '') <> 'success' then 'status: ' || coalesce(status, '')
  when coalesce(uuid, '') = '' then 'missing uuid' end"""


def _streamed(spark, sf, handler, split_by=None) -> str:
    out, check = scratch_path(spark, "messages"), scratch_path(spark, "stream")
    stream = MS.file_message_source(spark, *_landed_messages(spark, sf))
    SM.message_stream(stream, handler, out, check, split_by=split_by).awaitTermination()
    return out


@register(
    "STR2_validate_route",
    f"""with {SQL_MESSAGES} select "offset", topic, {_SQL_REASON} as reject_reason from msg""",
)
def str2(spark, sf):
    """A stream of four files; good messages and dead letters read back together."""
    out = _streamed(spark, sf, SM.CREATION)
    done = SM.routed(spark, out, "done").select("offset", "topic", F.lit(None).cast("string").alias("reject_reason"))
    dead = SM.routed(spark, out, "dead").select("offset", "topic", "reject_reason")
    return done.unionByName(dead)


def _needs_voice(_: DataFrame):
    return F.when(~F.coalesce(F.col("uuid") != "", F.lit(False)), "missing uuid")


def _voice(good: DataFrame) -> DataFrame:
    return good.withColumn(
        "process_error", F.when(F.coalesce("voiceover", F.lit("")) == "", "nothing to speak")
    )


_SQL_VOICE = """case when not ok then 'dead' when coalesce(uuid, '') = '' then 'dead'
  when coalesce(voiceover, '') = '' then 'retry' else 'done' end"""


def _routes(spark, sf, always_mark: bool) -> DataFrame:
    out = _streamed(spark, sf, SM.MessageHandler(_needs_voice, _voice, always_mark))
    parts = [
        SM.routed(spark, out, name).select("offset", F.lit(name).alias("route")) for name in SM.ROUTES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("STR3_at_least_once", f"""with {SQL_MESSAGES} select "offset", {_SQL_VOICE} as route from msg""")
def str3(spark, sf):
    return _routes(spark, sf, True)


@register(
    "UDF3_message_handler",
    f"""with {SQL_MESSAGES} select "offset", replace({_SQL_VOICE}, 'dead', 'retry') as route from msg""",
)
def udf3(spark, sf):
    """Without ``always_mark`` refused messages come back as well."""
    return _routes(spark, sf, False)


@register(
    "STR7_latest_state",
    f"""with {SQL_MESSAGES} select key, arg_max(value, "offset") as payload, max("offset") as "offset" from msg group by key""",
)
def str7(spark, sf):
    out, check = scratch_path(spark, "latest"), scratch_path(spark, "stream")
    stream = MS.file_message_source(spark, *_landed_messages(spark, sf))
    SM.latest_state_stream(stream, ["key"], out, check).awaitTermination()
    return spark.read.parquet(out).groupBy("key").agg(
        F.max_by("payload", "offset").alias("payload"), F.max("offset").alias("offset")
    )


@register(
    "SNK8_topic_fan_out",
    f"""with {SQL_MESSAGES} select "offset", topic, uuid from msg where {_SQL_REASON} is null""",
)
def snk8(spark, sf):
    out = _streamed(spark, sf, SM.CREATION, split_by="topic")
    return SM.routed(spark, out, "done").select("offset", "topic", "uuid")


_DENSE_COLUMNS = (
    "seq long, id string, url string, title string, summary string, author string, categories array<string>, "
    "published_at timestamp, fetched_at timestamp, full_content string, full_content_text string, extraction_error string"
)


def _vector_stream(spark, sf, parts: int, **options) -> tuple[DataFrame, StateFolder]:
    """Vectors landing in ``parts`` ranges, each taken by a stream run an hour after the last, started
    anew from its checkpoint: the results, and the state behind them."""
    articles = _vector_articles(spark, sf)
    n = articles.count()
    path = scratch_path(spark, "articles")
    results, check = scratch_path(spark, "results"), scratch_path(spark, "stream")
    folder = StateFolder(spark, scratch_path(spark, "state"), DenseEmbedder.vector_type)
    for part in range(parts):
        mine = F.col("seq").between(n * part // parts, n * (part + 1) // parts - 1)
        articles.where(mine).write.mode("append").parquet(path)
        stream = spark.readStream.schema(_DENSE_COLUMNS).parquet(path).withColumnRenamed("seq", "_order")
        dedup_stream(
            stream, folder, _dense(), results, check, lambda b: NOW + timedelta(hours=b), ["_order"], **options
        ).awaitTermination()
    return spark.read.parquet(results), folder


def _by_id(results: DataFrame) -> DataFrame:
    return results.select("id", "status", "is_exact_duplicate", "matching_id", "similarity_score")


@register(
    "STR4_ttl_state",
    f"""with recursive {_SQL_DENSE}, {sql_walk(PAIR_THRESHOLD)}
        select a.id, {_RESULT} from arts a left join judged j using (seq)""",
)
def str4(spark, sf):
    """Two batches an hour apart give what one batch gives."""
    return _by_id(_vector_stream(spark, sf, 2)[0])


@register(
    "SNK2_story_stream",
    f"""with recursive {_SQL_DENSE}, {sql_walk(PAIR_THRESHOLD)},
        segments as (
          select coalesce(j.matching_id, a.id) as id, seq from arts a join judged j using (seq))
        select id, 1 as parts, count(*)::integer as segments, string_agg('t' || seq, ',' order by seq) as titles,
          count(distinct id) = 1 as one_body from segments group by id""",
)
def snk2_stream(spark, sf):
    """Stories of three batches, folded on the way, each run started anew: one body per story."""
    _, folder = _vector_stream(spark, sf, 3, stories=True, fold_every=2)
    segments = folder.stories()
    bodies = append_concat(segments).groupBy("id").agg(
        F.count("*").cast("int").alias("parts"),
        F.sum(F.size(F.split("body", SEGMENT_SPLIT))).cast("int").alias("segments"),
    )
    titles = segments.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "seq", "title"))), lambda x: x["title"]), ",").alias("titles")
    )
    return bodies.join(titles, "id").select("id", "parts", "segments", "titles", (F.col("parts") == 1).alias("one_body"))


@register(
    "STR5_periodic_run",
    "select 'v' || lpad(vec_id::varchar, 9, '0') as id, 2::bigint as seen_in from embeddings",
)
def str5(spark, sf):
    """A second run over the same feeds finds every article already seen."""
    articles = _vector_articles(spark, sf)
    path = scratch_path(spark, "articles")
    results, check = scratch_path(spark, "results"), scratch_path(spark, "stream")
    folder = StateFolder(spark, scratch_path(spark, "state"), DenseEmbedder.vector_type)
    for _ in range(2):
        articles.write.mode("append").parquet(path)
        stream = spark.readStream.schema(_DENSE_COLUMNS).parquet(path).withColumnRenamed("seq", "_order")
        dedup_stream(
            stream, folder, _dense(), results, check, lambda b: NOW + timedelta(minutes=5 * b), ["_order"]
        ).awaitTermination()
    again = spark.read.parquet(results).groupBy("id").agg(
        F.count("*").alias("seen_in"), F.max_by("is_exact_duplicate", "v").alias("again")
    )
    return again.where("again").select("id", "seen_in")


@register(
    "STR6_reset_or_refresh",
    f"""with recursive {_SQL_DENSE}, {sql_walk(PAIR_THRESHOLD)},
        first_run as (select count(*) filter (matching_id is null) as new_count, count(*) filter (matching_id is not null) as duplicate_count from judged)
        select 'refresh' as run, 0::bigint as new_count, (select count(*) from arts) as duplicate_count
        union all select 'reset', new_count, duplicate_count from first_run""",
)
def str6(spark, sf):
    """After a first run, a refresh knows every article and a reset none."""
    folder = StateFolder(spark, scratch_path(spark, "state"), DenseEmbedder.vector_type)
    results = scratch_path(spark, "results")
    articles = _vector_articles(spark, sf)
    run_batch(folder, articles, 0, NOW, _dense(), results)
    refresh = run_batch(folder, articles, 1, NOW, _dense(), results).results
    reset = run_batch(folder, articles, 2, NOW, _dense(), results, reset=True).results
    named = refresh.withColumn("run", F.lit("refresh")).unionByName(reset.withColumn("run", F.lit("reset")))
    return R.status_counts(named, ["run"]).select("run", "new_count", "duplicate_count")


# -- whole runs -------------------------------------------------------------


def _sql_run() -> str:
    return f"""with recursive {_SQL_FEED}, {SQL_PAGE_TEXT},
      filled as (
        select row_number() over (order by feed, pos) as seq, o.id, o.link as url, o.title, o.summary, p.text
        from feed_arts o left join page_text p on p.url = o.link and o.link <> ''),
      arts as (select * from filled where url <> ''),
      {SQL_EXACT},
      survivors as (select seq, id, coalesce(nullif(text, ''), nullif(summary, ''), title) as text from arts
                    where seq in (select seq from passed)),
      corpus as (select seq, text from survivors), {SQL_VECTORS}, {SQL_TERM_SIMS}, {sql_walk(THRESHOLD)}"""


def _sql_ingest() -> str:
    return f"""{_sql_run()}
      select 'run-1' as run_id,
        (select count(*) from judged where matching_id is null) as new_count,
        (select count(*) from arts) - (select count(*) from judged where matching_id is null) as duplicate_count,
        (select count(*) from filled where url = '') as failed_count, 0::bigint as error_count"""


def _ingested(spark, sf):
    empty = spark.createDataFrame([], STORY_SEGMENT)
    return ingest(
        feed_documents(spark, sf), table(spark, sf, "pages"), State.empty(spark), empty, NOW,
        TermEmbedder(THRESHOLD), "run-1",
    )


@register("RUN_ingest", _sql_ingest())
def run_ingest(spark, sf):
    """Feeds to counts in one run: every step of the refresh."""
    return _ingested(spark, sf).counts


@register(
    "RUN_ingest_rows",
    f"""{_sql_run()}
      select f.id, case when f.url = '' then 'failed' when j.seq is not null and j.matching_id is null then 'new'
               else 'duplicate' end as status,
             f.url <> '' and f.seq not in (select seq from survivors) as is_exact_duplicate,
             case when f.url = '' then 'article URL is empty' end as error
      from filled f left join judged j using (seq)""",
)
def run_ingest_rows(spark, sf):
    """The same run, article by article."""
    return _ingested(spark, sf).outcome.results.select("id", "status", "is_exact_duplicate", "error")


@register(
    "RUN_captioning",
    f"""with {SQL_MESSAGES}, good as (select * from msg where {_SQL_REASON} is null)
        select 'scripts' as part, count(*) as rows from good where n_words > 0
        union all select 'metadata', count(*) from good where n_words > 0
        union all select 'clips of 1.0 s', count(*) from good where n_words > 0
        union all select 'rejected', (select count(*) from msg) - (select count(*) from good where n_words > 0)""",
)
def run_captioning(spark, sf):
    """Messages to caption files, durations and metadata, and what was refused."""
    out = caption(message_values(spark, sf), table(spark, sf, "pages"))
    parts = (
        ("scripts", out.scripts), ("metadata", out.metadata),
        ("clips of 1.0 s", out.durations.where("duration = 1.0")), ("rejected", out.rejected),
    )
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@register(
    "RUN_captioning_rows",
    f"""with {SQL_MESSAGES}, good as (select *, 'w' || "offset" as w from msg where {_SQL_REASON} is null and n_words > 0)
        select uuid as key, 'script' as part, md5({_sql_text(ass_header("Captions"))}
            || 'Dialogue: 0,0:00:00.00,0:00:00.50,Default,,0,0,0,,{{\\c&H0000FFFF&}}' || w
            || '{{\\c&H00FFFFFF&}}' || chr(10)) as value from good
        union all select uuid, 'duration', '1.0' from good
        union all select uuid, 'title', w || ' ' from good
        union all select uuid, 'description', 'Sources:' || chr(10) || 'https://e.example.org/' || "offset" || chr(10) || chr(10)
            || '📱 Follow for daily tech updates!' || chr(10) || '#tech #ai #technology #shorts' from good
        union all select "offset"::varchar, 'rejected', coalesce({_SQL_REASON}, 'no captions') from msg
          where "offset" not in (select "offset" from good)""",
)
def run_captioning_rows(spark, sf):
    """The same run, message by message."""
    out = caption(message_values(spark, sf), table(spark, sf, "pages"))
    parts = (
        ("script", out.scripts, "uuid", F.md5("script")),
        ("duration", out.durations, "uuid", F.col("duration").cast("string")),
        ("title", out.metadata, "uuid", F.col("title")),
        ("description", out.metadata, "uuid", F.col("description")),
        ("rejected", out.rejected, F.col("offset").cast("string"), F.col("reject_reason")),
    )
    rows = [
        df.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.lit(name).alias("part"), value.alias("value"))
        for name, df, key, value in parts
    ]
    return reduce(DataFrame.unionByName, rows)
