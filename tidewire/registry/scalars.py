"""Queries of the scalar rules and row tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import captions as C
from tidewire.functions import html as H
from tidewire.functions import text as X
from tidewire.functions import times as T
from tidewire.operators import captions as CP
from tidewire.operators import filters as FL
from tidewire.operators import publish as PB
from tidewire.operators import runs as R
from tidewire.operators.similar import best_match
from tidewire.plans.state import store_metadata
from tidewire.registry.base import (
    NOW, SQL_MESSAGES, SQL_RESULTS, SQL_TITLE, SQL_WORDS, blank_every, caption_messages,
    message_values, register, run_results, table,
)
from tidewire.sources.feeds import FEED_PRESETS, feed_presets, feeds_by_name, resolve_feeds
from tidewire.sources.messages import decode

# -- ids and fallback chains ------------------------------------------------


@register("PRJ1_article_id", "select page_id, substr(sha256(url), 1, 16) as id from pages")
def prj1(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.article_id(F.col("url")).alias("id"))


@register(
    "PRJ2_id_source",
    """select page_id, coalesce(substr(sha256(coalesce(
           case when page_id % 4 <> 0 then url end,
           case when page_id % 8 <> 0 then 'guid-' || page_id end,
           case when page_id % 16 <> 0 then 'Title ' || page_id end)), 1, 16), '') as id
       from pages""",
)
def prj2(spark, sf):
    n = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id",
        X.feed_item_id(
            blank_every(F.col("url"), n, 4),
            blank_every(F.concat(F.lit("guid-"), n), n, 8),
            blank_every(F.concat(F.lit("Title "), n), n, 16),
        ).alias("id"),
    )


@register(
    "PRJ3_published_at",
    """select event_id, case event_id % 6
           when 4 then null
           when 5 then epoch(date_trunc('second', ts))::bigint - 7200
           else epoch(date_trunc('second', ts))::bigint end as published_at
       from events""",
)
def prj3(spark, sf):
    rfc822 = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    rfc3339 = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 6
    published = (
        F.when(kind == 0, F.concat(rfc822, F.lit(" +0000")))
        .when(kind == 1, F.concat(rfc822, F.lit(" GMT")))
        .when(kind == 2, F.concat(rfc3339, F.lit("Z")))
        .when(kind == 3, "")
        .when(kind == 4, "soon")
        .otherwise(F.concat(rfc822, F.lit(" +0200")))
    )
    updated = F.when(kind == 3, F.concat(rfc3339, F.lit(".25Z"))).otherwise("")
    return table(spark, sf, "events").select(
        "event_id", F.unix_seconds(T.published_at(published, updated)).alias("published_at")
    )


@register(
    "PRJ4_summary",
    """select doc_id, md5(coalesce(case when doc_id % 3 <> 0 then lang end,
                                  case when doc_id % 9 <> 0 then nullif(text, '') end, '')) as summary_md5
       from documents""",
)
def prj4(spark, sf):
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(X.summary(blank_every(F.col("lang"), n, 3), blank_every(F.col("text"), n, 9))).alias("summary_md5"),
    )


_PARTS = """
  case when doc_id % 2 <> 0 then nullif(text, '') end as t,
  case when doc_id % 3 <> 0 then '<p>' || text || '</p>' end as h,
  case when doc_id % 5 <> 0 then nullif(source, '') end as s,
  case when doc_id % 7 <> 0 then nullif(lang, '') end as ti
"""


def _chain(spark, sf):
    n = F.col("doc_id")
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    return table(spark, sf, "documents").select(
        "doc_id",
        blank_every(F.col("text"), n, 2).alias("t"),
        blank_every(html, n, 3).alias("h"),
        blank_every(F.col("source"), n, 5).alias("s"),
        blank_every(F.col("lang"), n, 7).alias("ti"),
    )


@register(
    "PRJ7_embed_text",
    f"select doc_id, md5(coalesce(t, h, s, ti, '')) as text_md5 from (select doc_id, {_PARTS} from documents)",
)
def prj7(spark, sf):
    cols = [F.col(c) for c in ("t", "h", "s", "ti")]
    return _chain(spark, sf).select("doc_id", F.md5(X.embed_text(*cols)).alias("text_md5"))


@register(
    "PRJ8_stored_body",
    f"select doc_id, md5(coalesce(t, h, s, '')) as body_md5 from (select doc_id, {_PARTS} from documents)",
)
def prj8(spark, sf):
    cols = [F.col(c) for c in ("t", "h", "s")]
    return _chain(spark, sf).select("doc_id", F.md5(X.stored_body(*cols)).alias("body_md5"))


_META_KEYS = ("article_id", "title", "published_at", "fetched_at", "author", "last_update", "added_at", "categories")


@register(
    "PRJ9_store_metadata",
    f"""with a as (
          select 'e' || event_id as id, event_type as title, ts, event_id, user_id from events)
        select id as article_id, title,
          strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as published_at,
          case when event_id % 3 = 0 then '0001-01-01T00:00:00Z' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as fetched_at,
          'user ' || user_id as author,
          '2024-01-31T00:00:00Z' as last_update, '2024-01-31T00:00:00Z' as added_at,
          case when event_id % 4 = 0 then null else title || ', k' || (event_id % 10) end as categories
        from a""",
)
def prj9(spark, sf):
    n = F.col("event_id")
    none = F.expr("cast(array() as array<string>)")
    articles = table(spark, sf, "events").select(
        F.concat(F.lit("e"), n).alias("id"),
        F.col("event_type").alias("title"),
        F.lit("").alias("url"),
        F.col("ts").alias("published_at"),
        F.when(n % 3 != 0, F.col("ts")).alias("fetched_at"),
        F.concat(F.lit("user "), "user_id").alias("author"),
        F.when(n % 4 == 0, none).otherwise(F.array("event_type", F.concat(F.lit("k"), (n % 10).cast("string")))).alias("categories"),
    )
    m = articles.select(store_metadata(F.lit(NOW)).alias("m"))
    return m.select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in _META_KEYS])


# Stamps of events as stored text: missing, blank, garbled, date-only, with
# fractions, with an offset, plain.
def stamped_events(spark, sf):
    n = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    last = (
        F.when(n % 7 == 1, "")
        .when(n % 7 == 2, "garbled")
        .when(n % 7 == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(n % 7 == 4, F.concat(iso, F.lit(".5Z")))
        .when(n % 7 == 5, F.concat(iso, F.lit("+02:00")))
        .when(n % 7 == 6, F.concat(iso, F.lit("Z")))
    )
    seen = F.when(n % 3 == 1, F.concat(iso, F.lit("+01:00"))).when(n % 3 == 2, "never")
    added = F.when(n % 2 == 1, F.concat(iso, F.lit("Z")))
    pairs = [("last_update", last), ("last_retrieved_at", seen), ("added_at", added)]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return table(spark, sf, "events").select(
        "event_id",
        last.alias("last"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata"),
    )


_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
SQL_STAMPS = f"""
stamps as (
  select event_id,
    case event_id % 7 when 1 then '' when 2 then 'garbled' when 3 then strftime(ts, '%Y-%m-%d')
      when 4 then iso || '.5Z' when 5 then iso || '+02:00' when 6 then iso || 'Z' end as l,
    case event_id % 3 when 1 then iso || '+01:00' when 2 then 'never' end as r,
    case when event_id % 2 = 1 then iso || 'Z' end as a
  from (select event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events)),
parsed_stamps as (
  select event_id, l,
    case when regexp_matches(l, '{_RFC3339}') then epoch_ms(try_cast(l as timestamptz)) end as pl,
    case when regexp_matches(r, '{_RFC3339}') then epoch_ms(try_cast(r as timestamptz)) end as pr,
    case when regexp_matches(a, '{_RFC3339}') then epoch_ms(try_cast(a as timestamptz)) end as pa
  from stamps)
"""


@register(
    "PRJ10_last_update_resolve",
    f"with {SQL_STAMPS} select event_id, coalesce(pl, pr, pa) as last_update_ms from parsed_stamps",
)
def prj10(spark, sf):
    return stamped_events(spark, sf).select(
        "event_id", F.unix_millis(T.last_update_resolve(F.col("metadata"))).alias("last_update_ms")
    )


@register("PRJ11_parse_rfc3339", f"with {SQL_STAMPS} select event_id, pl as parsed_ms from parsed_stamps")
def prj11(spark, sf):
    return stamped_events(spark, sf).select(
        "event_id", F.unix_millis(T.parse_rfc3339(F.col("last"))).alias("parsed_ms")
    )


@register(
    "FLT5_ttl_valid",
    """select event_id, ts >= timestamp '2024-01-30 00:00:00' as fresh from events
       union all select -1 - event_id, true from events""",
)
def flt5(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit(NOW)
    edge = e.select((-1 - F.col("event_id")).alias("event_id"), FL.ttl_valid(F.col("ts"), F.col("ts") + F.expr("interval 24 hours")).alias("fresh"))
    return e.select("event_id", FL.ttl_valid(F.col("ts"), now).alias("fresh")).unionByName(edge)


@register(
    "FLT6_bad_metadata",
    f"with {SQL_STAMPS} select event_id from parsed_stamps where coalesce(pl, pr, pa) is null",
)
def flt6(spark, sf):
    rows = stamped_events(spark, sf)
    return rows.where(FL.bad_metadata(T.last_update_resolve(F.col("metadata")))).select("event_id")


@register("PRJ12_similarity", "select event_id, round(1 - value / 1000, 9) as similarity from events")
def prj12(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(X.similarity(F.col("value") / 1000), 9).alias("similarity")
    )


_PRESETS_SQL = ", ".join(f"('{p}', '{n}', '{u}')" for p, n, u in FEED_PRESETS)
_REQUESTS_SQL = """
requests as (
  select c_custkey, case c_custkey % 6 when 0 then 'cna' when 1 then 'st' when 2 then '' when 3 then 'hn'
      when 4 then 'tr' else 'https://feeds.example.org/' || c_custkey end as feed,
    (c_custkey % 4)::bigint as n from customer)
"""


def _requests(spark, sf):
    n = F.col("c_custkey")
    feed = (
        F.when(n % 6 == 0, "cna").when(n % 6 == 1, "st").when(n % 6 == 2, "").when(n % 6 == 3, "hn")
        .when(n % 6 == 4, "tr").otherwise(F.concat(F.lit("https://feeds.example.org/"), n))
    )
    return table(spark, sf, "customer").select("c_custkey", feed.alias("feed"), (n % 4).alias("count"))


@register(
    "PRJ13_resolve_feed",
    f"""with presets(preset, name, url) as (values {_PRESETS_SQL}), {_REQUESTS_SQL}
        select c_custkey, coalesce(p.url, coalesce(nullif(feed, ''), 'st')) as feed_url,
          case when n = 0 then 10 else n end as "count"
        from requests left join presets p on p.preset = coalesce(nullif(feed, ''), 'st')""",
)
def prj13(spark, sf):
    return resolve_feeds(_requests(spark, sf), feed_presets(spark)).select("c_custkey", "feed_url", "count")


@register(
    "JN4_feed_lookup",
    f"""with presets(preset, name, url) as (values {_PRESETS_SQL}), {_REQUESTS_SQL}
        select p.name as feed_name, count(*) as requests
        from requests left join presets p on p.preset = coalesce(nullif(feed, ''), 'st') group by 1""",
)
def jn4(spark, sf):
    feeds = feed_presets(spark)
    named = resolve_feeds(_requests(spark, sf), feeds).join(
        feeds.select(F.col("url").alias("feed_url"), F.col("name").alias("feed_name")), "feed_url", "left"
    )
    return named.groupBy("feed_name").agg(F.count("*").alias("requests"))


@register(
    "TOP3_feeds_by_name",
    f"""with presets(preset, name, url) as (values {_PRESETS_SQL}), {_REQUESTS_SQL}
        select row_number() over (order by name)::bigint as place, name, preset, asked from (
          select p.name, p.preset, count(*) as asked from presets p
          join requests r on p.preset = r.feed group by all)""",
)
def top3(spark, sf):
    asked = _requests(spark, sf).groupBy(F.col("feed").alias("preset")).agg(F.count("*").alias("asked"))
    # Four feeds, so the place in their order needs one small task.
    listed = feeds_by_name(feed_presets(spark).join(asked, "preset"))
    place = F.row_number().over(Window.orderBy("name")).cast("long")
    return listed.select(place.alias("place"), "name", "preset", "asked")


# -- pages and publishing ---------------------------------------------------


# Titles that are none; beside them the query has unclosed ones, and references to decode.
_TITLE_TRAPS = ("<!-- <title>old</title> -->", "<script>var t = '<title>no</title>'</script>")


@register(
    "PRJ14_html_title",
    f"""with traps as (
          select page_id, case page_id % 4 when 0 then '{_TITLE_TRAPS[0]}' when 1 then '{_TITLE_TRAPS[1].replace("'", "''")}'
                   else '' end
                 || case when page_id % 5 = 0 then '<title>Caf&eacute; &#233; &#x1F600; &amp;lt; ' || page_id else html end as html
          from pages)
        select page_id, case when page_id % 5 = 0 then 'Café é 😀 &lt; ' || page_id else {SQL_TITLE} end as title from traps""",
)
def prj14(spark, sf):
    n = F.col("page_id")
    before = F.when(n % 4 == 0, _TITLE_TRAPS[0]).when(n % 4 == 1, _TITLE_TRAPS[1]).otherwise("")
    unclosed = F.concat(F.lit("<title>Caf&eacute; &#233; &#x1F600; &amp;lt; "), n.cast("string"))
    traps = table(spark, sf, "pages").select(
        "page_id", F.concat(before, F.when(n % 5 == 0, unclosed).otherwise(F.col("html"))).alias("html")
    )
    return traps.select("page_id", H.html_title(F.col("html")).alias("title"))


_SQL_TEN = """
heads as (
  select uuid, string_agg(w || ' ', '' order by i) as t from words where i < 10 group by uuid)
"""


@register(
    "PRJ15_title_from_words",
    f"""with {SQL_WORDS}, {_SQL_TEN}
        select uuid, case when len(t) > 100 then t[1:97] || '...' else t end as title from heads""",
)
def prj15(spark, sf):
    return caption_messages(spark, sf).select(
        "uuid", X.title_from_words(F.col("subtitle_timestamps")).alias("title")
    )


@register(
    "TOP4_first_words",
    f"""with {SQL_WORDS} select uuid, string_agg(w, '|' order by i) as first_words
        from words where i < 10 group by uuid""",
)
def top4(spark, sf):
    return caption_messages(spark, sf).select(
        "uuid", F.array_join(F.slice("subtitle_timestamps", 1, X.TITLE_WORDS)["text"], "|").alias("first_words")
    )


def _titled(spark, sf):
    """Caption messages that name a page by number, or a page that is not there."""
    pages = table(spark, sf, "pages")
    m = caption_messages(spark, sf).withColumn("conv", F.split_part("uuid", F.lit("-"), F.lit(1)).cast("long"))
    urls = pages.select(F.col("page_id").alias("conv"), "url")
    return m.join(urls, "conv", "left").select(
        "uuid",
        "subtitle_timestamps",
        F.when(F.col("conv") % 5 == 0, F.col("role")).otherwise("").alias("title"),
        F.when(F.col("conv") % 3 == 0, "").otherwise(F.col("role")).alias("source_url"),
        F.when(F.col("conv") % 4 == 0, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array("url", F.concat(F.col("url"), F.lit("&b"))))
        .alias("article_urls"),
    )


_SQL_TITLED = f"""
pt as (select page_id, url, {SQL_TITLE} as page_title from pages),
conv as (
  select t.uuid, t.role, split_part(t.uuid, '-', 1)::bigint as conv,
         case when len(h.t) > 100 then h.t[1:97] || '...' else h.t end as from_words
  from turns t left join heads h using (uuid)),
titled as (
  select uuid, role, c.conv, url,
    coalesce(case when c.conv % 5 = 0 then role end,
             case when c.conv % 4 <> 0 then nullif(page_title, '') end, from_words) as title
  from conv c left join pt on pt.page_id = c.conv)
"""


@register(
    "PRJ16_title_choice",
    f"with {SQL_WORDS}, {_SQL_TEN}, {_SQL_TITLED} select uuid, title from titled",
)
def prj16(spark, sf):
    chosen = PB.choose_titles(_titled(spark, sf), table(spark, sf, "pages"))
    return chosen.select("uuid", F.col("chosen_title").alias("title"))


@register(
    "PRJ17_truncate_ellipsis",
    f"""with t as (select page_id, {SQL_TITLE} as a from pages), d as (select page_id, a || ' ' || a || ' ' || a as a from t)
        select page_id, case when len(a) > 100 then a[1:97] || '...' else a end as title from d""",
)
def prj17(spark, sf):
    title = H.html_title(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", X.truncate_ellipsis(F.concat_ws(" ", title, title, title)).alias("title")
    )


@register(
    "PRJ18_publish_metadata",
    f"""with {SQL_WORDS}, {_SQL_TEN}, {_SQL_TITLED}
        select uuid, case when len(title) > 100 then title[1:97] || '...' else title end as title,
          case when conv % 4 <> 0 then 'Sources:' || chr(10) || coalesce(url || chr(10), '') || coalesce(url || '&b' || chr(10), '') || chr(10)
               else '🔗 Source: ' || case when conv % 3 = 0 then 'https://example.com/article' else role end || chr(10) || chr(10) end
            || '📱 Follow for daily tech updates!' || chr(10) || '#tech #ai #technology #shorts' as description,
          'tech news|AI|technology|artificial intelligence|tech shorts|daily tech' as tags, '28' as category_id
        from titled""",
)
def prj18(spark, sf):
    chosen = PB.choose_titles(_titled(spark, sf), table(spark, sf, "pages"))
    return PB.publish_metadata(chosen).withColumn("tags", F.array_join("tags", "|"))


@register(
    "PRJ19_parse_tags",
    """with t as (select p_partkey, list_filter(list_transform(string_split(
           case when p_partkey % 5 = 0 then ' , ,' else ' ' || p_name || ' , ,' || p_type || ',' end, ','),
           lambda x: trim(x)), lambda x: x <> '') as l from part)
       select p_partkey, case when len(l) = 0 then 'tech|AI|shorts' else array_to_string(l, '|') end as tags from t""",
)
def prj19(spark, sf):
    raw = F.when(F.col("p_partkey") % 5 == 0, " , ,").otherwise(
        F.concat(F.lit(" "), "p_name", F.lit(" , ,"), "p_type", F.lit(","))
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.parse_tags(raw), "|").alias("tags"))


@register(
    "PRJ20_upload_defaults",
    """with t as (select p_partkey, p_type, case when p_partkey % 2 = 0 then p_name || '.v' || p_size else p_type end as title from part)
       select p_partkey, title,
         case when p_partkey % 7 = 0 then 'about ' || p_type
              else title || chr(10) || chr(10)
                || case when p_partkey % 3 = 0 then '' else 'Source: https://s.example.org/' || p_partkey || chr(10) || chr(10) end
                || 'Follow for daily tech updates!' || chr(10) || '#tech #ai #technology #shorts' end as description,
         '28' as category_id
       from t""",
)
def prj20(spark, sf):
    n = F.col("p_partkey")
    uploads = table(spark, sf, "part").select(
        F.concat(F.lit("/videos/"), "p_brand", F.lit("/"), "p_name", F.lit(".v"), F.col("p_size").cast("string"), F.lit(".mp4")).alias("path"),
        blank_every(F.col("p_type"), n, 2).alias("title"),
        F.when(n % 7 == 0, F.concat(F.lit("about "), "p_type")).otherwise(" ").alias("description"),
        blank_every(F.concat(F.lit("https://s.example.org/"), n), n, 3).alias("source"),
        F.lit("").alias("tags"),
        F.lit("").alias("category_id"),
        "p_partkey",
    )
    return PB.upload_metadata(uploads).select("p_partkey", "title", "description", "category_id")


# -- captions ---------------------------------------------------------------


@register(
    "PRJ21_clip_duration",
    f"""with {SQL_WORDS} select uuid, least(max(en) + 0.5, 180.0::double) as duration from timed group by uuid""",
)
def prj21(spark, sf):
    return CP.clip_durations(caption_messages(spark, sf)).select("uuid", "duration")


@register(
    "PRJ22_sentence_end",
    """with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) as w from documents)
       select doc_id, count(*) filter (regexp_matches(w, '[.!?]\\z') and not regexp_matches(w, '(^|[0-9])[0-9][.]\\z')) as ends,
              count(*) filter (regexp_matches(w, '(^|[0-9])[0-9][.]\\z')) as number_periods
       from w group by doc_id""",
)
def prj22(spark, sf):
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")
    return (
        table(spark, sf, "documents")
        .select("doc_id", words.alias("ws"))
        .select(
            "doc_id",
            F.size(F.filter("ws", C.sentence_end)).cast("long").alias("ends"),
            F.size(F.filter("ws", lambda w: w.rlike(C.NUMBER_PERIOD))).cast("long").alias("number_periods"),
        )
    )


_ON, _OFF = C.HIGHLIGHT_ON, C.HIGHLIGHT_OFF
_SQL_LIT = f"""
lit as (
  select a.uuid, a.line, a.pos, a.st, a.en, a.next_st,
    string_agg(case when b.pos = a.pos then '{_ON}' || b.w || '{_OFF}' else b.w end, ' ' order by b.pos) as text
  from lined a join lined b on a.uuid = b.uuid and a.line = b.line
  group by all)
"""


@register(
    "PRJ23_highlight_line",
    f"with {SQL_WORDS}, {_SQL_LIT} select uuid, line::bigint as line, pos::bigint as pos, text from lit",
)
def prj23(spark, sf):
    return CP.caption_events(caption_messages(spark, sf)).select(
        "uuid", F.col("line").cast("long"), F.col("pos").cast("long"), "text"
    )


def _sql_time(s: str, ass: bool) -> str:
    h, m = f"trunc({s} / 3600)", f"trunc(({s} - trunc({s} / 3600) * 3600) / 60)"
    sec = f"trunc({s}) % 60"
    if ass:
        return (
            f"format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', {h}::int, ({m})::int, ({sec})::int, "
            f"trunc(({s} - trunc({s})) * 100)::int)"
        )
    return (
        f"format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {h}::int, ({m})::int, ({sec})::int, "
        f"trunc(({s} - trunc({s})) * 1000)::int)"
    )


@register(
    "PRJ24_fmt_ass_time",
    f"with s as (select event_id, event_id * 37 / 100.0::double as s from events) select event_id, {_sql_time('s', True)} as shown from s",
)
def prj24(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", T.fmt_ass_time(F.col("event_id") * 37 / 100.0).alias("shown")
    )


@register(
    "PRJ25_fmt_srt_time",
    f"with s as (select event_id, event_id * 377 / 1000.0::double as s from events) select event_id, {_sql_time('s', False)} as shown from s",
)
def prj25(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", T.fmt_srt_time(F.col("event_id") * 377 / 1000.0).alias("shown")
    )


@register(
    "PRJ26_object_key",
    """select p_partkey, case p_partkey % 3 when 0 then '' else p_brand || '/' end || p_partkey as object_key from part""",
)
def prj26(spark, sf):
    n = F.col("p_partkey")
    prefix = F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("/")))
    return table(spark, sf, "part").select("p_partkey", X.object_key(prefix, n.cast("string")).alias("object_key"))


@register(
    "PRJ27_strip_images",
    """select page_id, md5(replace(html, '<br>', '')) as html_md5 from pages""",
)
def prj27(spark, sf):
    dirty = F.replace("html", F.lit("<br>"), F.lit("<IMG src='a.png'\n alt=x>"))
    return table(spark, sf, "pages").select("page_id", F.md5(H.strip_images(dirty)).alias("html_md5"))


@register(
    "PRJ28_error_envelope",
    """select event_id, case event_id % 6 when 0 then event_type || ': m' || event_id when 1 then event_type
         when 2 then 'm' || event_id end as message from events""",
)
def prj28(spark, sf):
    n = F.col("event_id")
    err = F.concat(F.lit('"error":"'), "event_type", F.lit('"'))
    msg = F.concat(F.lit('"message":"m'), n, F.lit('"'))
    body = (
        F.when(n % 6 == 0, F.concat(F.lit("{"), err, F.lit(","), msg, F.lit("}")))
        .when(n % 6 == 1, F.concat(F.lit("{"), err, F.lit("}")))
        .when(n % 6 == 2, F.concat(F.lit('{"error":"",'), msg, F.lit("}")))
        .when(n % 6 == 3, F.concat(F.lit('{"error":'), n, F.lit("}")))
        .when(n % 6 == 4, "not json")
        .otherwise("{}")
    )
    return table(spark, sf, "events").select("event_id", X.error_envelope(body).alias("message"))


@register(
    "PRJ29_payload_report",
    f"""with {SQL_MESSAGES}
        select "offset", uuid, status, '' as error,
          case when voiceover is null then '' when len(voiceover) > 200 then voiceover[1:200] || '...' else voiceover end as voiceover_preview,
          n_words::bigint as captions, (ok and json_type(j) = 'OBJECT')::bigint as n_timings,
          case when ok and json_type(j) = 'OBJECT' then 'step=' || format('{{:.2f}}', ("offset" % 100)::double) || 's' end as timings
        from msg""",
)
def prj29(spark, sf):
    report = R.payload_report(decode(message_values(spark, sf)))
    return report.select(
        "offset",
        *[c for c in report.columns if c not in ("offset", "captions", "n_timings")],
        F.col("captions").cast("long"),
        F.col("n_timings").cast("long"),
    )


@register("PRJ30_percent", "select event_id, round(value / 128 * 100, 2) as pct from events")
def prj30(spark, sf):
    return table(spark, sf, "events").select("event_id", X.percent(F.col("value") / 128).alias("pct"))


# -- row tests --------------------------------------------------------------


@register(
    "FLT1_extraction_ok",
    """select page_id, case when length(html) < 3000 then 'failed' else 'taken' end as status,
              case when length(html) < 3000 then 'too short: ' || length(html) end as error from pages""",
)
def flt1(spark, sf):
    size = F.length("html")
    error = F.when(size < 3000, F.concat(F.lit("too short: "), size)).when(F.col("page_id") % 2 == 0, "")
    ok = FL.extraction_ok(error)
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(ok, "taken").otherwise("failed").alias("status"),
        F.when(~ok, error).alias("error"),
    )


@register(
    "FLT2_message_valid",
    f"""with {SQL_MESSAGES} select "offset", coalesce(ok and status = 'success' and coalesce(uuid, '') <> '', false) as creation,
        coalesce(ok and coalesce(uuid, '') <> '', false) as run from msg""",
)
def flt2(spark, sf):
    good = F.col("decode_error").isNull()
    return decode(message_values(spark, sf)).select(
        "offset",
        (good & FL.message_valid(F.col("status"), F.col("uuid"))).alias("creation"),
        (good & FL.payload_valid(F.col("uuid"))).alias("run"),
    )


@register(
    "FLT3_request_valid",
    f"""with {SQL_MESSAGES} select "offset", case when not ok then 'cannot decode message'
          when coalesce(status, '') <> 'success' then 'Input status must be ''success'''
          when coalesce(uuid, '') = '' then 'UUID is required'
          when coalesce(voiceover, '') = '' then 'Voiceover URL is required'
          when n_words = 0 then 'Subtitle timestamps are required' end as reject_reason
        from msg""",
)
def flt3(spark, sf):
    reject = FL.request_reject(F.col("status"), F.col("uuid"), F.col("voiceover"), F.col("subtitle_timestamps"))
    return decode(message_values(spark, sf)).select(
        "offset", F.coalesce("decode_error", reject).alias("reject_reason")
    )


@register("FLT4_similarity_threshold", "select event_id from events where value / 100 >= 0.95")
def flt4(spark, sf):
    return table(spark, sf, "events").where(FL.similarity_threshold(F.col("value") / 100)).select("event_id")


@register(
    "FLT8_only_new",
    f"with {SQL_RESULTS} select seq, url from results where status = 'new'",
)
def flt8(spark, sf):
    return run_results(spark, sf).where(FL.only_new(F.col("status"))).select("seq", "url")


@register(
    "FLT9_positive_best",
    """with h as (select user_id, event_id, round(value - 20, 2) as sim from events)
       select user_id, max(sim) as best_sim, arg_min(event_id, (-sim, event_id)) as matching_id
       from h where sim > 0 group by user_id""",
)
def flt9(spark, sf):
    hits = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.round(F.col("value") - 20, 2).alias("sim")
    )
    best = best_match(hits.where(FL.positive_best(F.col("sim"))))
    return best.select(
        F.col("query_id").alias("user_id"), F.col("similarity_score").alias("best_sim"), "matching_id"
    )
