"""Queries of caption windows, caption files, run reports and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import captions as C
from tidewire.functions import text as X
from tidewire.operators import captions as CP
from tidewire.operators import runs as R
from tidewire.operators.stories import article_export
from tidewire.registry.base import (
    SQL_MESSAGES, SQL_RESULTS, SQL_WORDS, caption_messages, message_values, register, run_results, table,
)
from tidewire.registry.scalars import _SQL_LIT, _sql_time
from tidewire.sources.messages import decode

# -- caption lines, events, files -------------------------------------------


@register(
    "WIN1_caption_lines",
    f"""with {SQL_WORDS} select uuid, line::bigint as line, count(*) as n_words, min(st) as start_s, max(en) as end_s,
           string_agg(w, ' ' order by i) as text from lined group by uuid, line""",
)
def win1(spark, sf):
    lines = CP.caption_lines(caption_messages(spark, sf))
    return lines.select(
        "uuid", F.col("line").cast("long"), F.col("n_words").cast("long"),
        F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text",
    )


@register(
    "WIN2_caption_events",
    f"""with {SQL_WORDS} select uuid, line::bigint as line, pos::bigint as pos, st as start_s,
           coalesce(next_st, en) as end_s from lined""",
)
def win2(spark, sf):
    return CP.caption_events(caption_messages(spark, sf)).select(
        "uuid", F.col("line").cast("long"), F.col("pos").cast("long"),
        F.col("start").alias("start_s"), F.col("end").alias("end_s"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register(
    "SNK9_captions_ass",
    f"""with {SQL_WORDS}, {_SQL_LIT}
        select uuid, md5({_sql_text(C.ass_header())} || string_agg('Dialogue: 0,' || {_sql_time('st', True)} || ','
          || {_sql_time('coalesce(next_st, en)', True)} || ',Default,,0,0,0,,' || text || chr(10), '' order by line, pos)) as script_md5
        from lit group by uuid""",
)
def snk9(spark, sf):
    return CP.ass_files(caption_messages(spark, sf)).select("uuid", F.md5("script").alias("script_md5"))


_SQL_CUES = f"""
cues as (
  select uuid, i, (i + 1) || chr(10) || {_sql_time('st', False)} || ' --> ' || {_sql_time('en', False)} || chr(10)
     || w || chr(10) || chr(10) as cue from timed)
"""


@register(
    "SNK10_captions_srt",
    f"with {SQL_WORDS}, {_SQL_CUES} select uuid, md5(string_agg(cue, '' order by i)) as script_md5 from cues group by uuid",
)
def snk10(spark, sf):
    return CP.srt_files(caption_messages(spark, sf)).select("uuid", F.md5("script").alias("script_md5"))


@register(
    "WIN5_cue_number",
    f"with {SQL_WORDS}, {_SQL_CUES} select uuid, i + 1 as cue_no, cue from cues",
)
def win5(spark, sf):
    m = caption_messages(spark, sf)
    cues = F.transform("subtitle_timestamps", C.srt_cue)
    return m.select("uuid", F.posexplode_outer(cues).alias("pos", "cue")).where("cue is not null").select(
        "uuid", (F.col("pos") + 1).cast("long").alias("cue_no"), "cue"
    )


# -- run reports ------------------------------------------------------------


@register(
    "AGG2_status_counts",
    f"""with {SQL_RESULTS} select run_id, count(*) filter (status = 'new') as new_count,
          count(*) filter (status = 'duplicate') as duplicate_count,
          count(*) filter (status = 'failed') as failed_count,
          count(*) filter (status = 'error') as error_count from results group by run_id""",
)
def agg2(spark, sf):
    return R.status_counts(run_results(spark, sf), ["run_id"])


@register(
    "AGG4_new_urls",
    f"""with {SQL_RESULTS} select run_id, 0::bigint as part, string_agg(url, '|' order by seq) as article_urls
        from results where status = 'new' group by all""",
)
def agg4(spark, sf):
    return R.new_urls(run_results(spark, sf), ["run_id"]).withColumn(
        "article_urls", F.array_join("article_urls", "|")
    )


@register(
    "AGG5_first_new_ref",
    f"""with {SQL_RESULTS} select run_id, arg_min(object_key, seq) as object_ref from results
        where status = 'new' and object_key <> '' group by run_id""",
)
def agg5(spark, sf):
    return R.first_new_ref(run_results(spark, sf), ["run_id"])


@register(
    "SNK7_generation_request",
    f"""with {SQL_RESULTS}, r as (
          select run_id, arg_min(object_key, seq) filter (object_key <> '') as object_ref, count(*) as n_urls,
                 min(seq) as a, max(seq) as b, string_agg(url, '|' order by seq) as article_urls from results where status = 'new' group by run_id)
        select run_id, substr(sha256(concat_ws('|', run_id, object_ref, n_urls, a, b)), 1, 16) as uuid, object_ref, n_urls,
          0::bigint as part, article_urls from r where object_ref is not null""",
)
def snk7(spark, sf):
    return R.generation_requests(run_results(spark, sf), ["run_id"]).withColumn(
        "article_urls", F.array_join("article_urls", "|")
    )


def _logs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("state"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), F.col("value").cast("int").cast("string"))).alias("error"),
    )


@register(
    "AGG6_run_status",
    f"""with {SQL_RESULTS}, l as (
          select user_id as run_id, coalesce(arg_max(event_type, event_id) filter (event_type <> 'click'), 'idle') as state,
                 coalesce(arg_max('Error: ' || trunc(value)::int, event_id) filter (event_type = 'error'), '') as error
          from events group by 1),
        c as (select run_id, count(*) as article_count, count(*) filter (status = 'new') as new_count,
                     count(*) filter (status = 'duplicate') as duplicate_count from results group by 1)
        select * from l join c using (run_id)""",
)
def agg6(spark, sf):
    return R.run_status(run_results(spark, sf), _logs(spark, sf), ["run_id"])


@register(
    "AGG7_latest_payload",
    f"""with {SQL_MESSAGES} select key, arg_max(value, "offset") as payload, max("offset") as "offset" from msg group by key""",
)
def agg7(spark, sf):
    return R.latest_payload(message_values(spark, sf), ["key"])


@register(
    "AGG7_completed_runs",
    f"""with {SQL_MESSAGES}, l as (
          select key, '{R.STATE_COMPLETE}' as state, '{R.PAYLOAD_LOGGED}' as message, max("offset") as "offset"
          from msg where ok and uuid = 'u' || "offset" group by key)
        select m.key, coalesce(state, 'idle') as state, message, l."offset" from (select distinct key from msg) m left join l using (key)""",
)
def agg7_completed(spark, sf):
    """Runs that a payload of their own uuid completes, and those that stay idle."""
    asked = decode(message_values(spark, sf)).withColumn("asked", F.concat(F.lit("u"), F.col("offset").cast("string")))
    payloads = R.latest_payload(asked, ["key"], match_uuid="asked")
    logs = R.completions(payloads, ["key"])
    shown = logs.select("key", "state", "message", F.col("seq").alias("offset"))
    keys = asked.select("key").distinct()
    return keys.join(shown, "key", "left").withColumn("state", F.coalesce("state", F.lit("idle")))


@register(
    "AGG8_summary_folded",
    f"""with {SQL_RESULTS} select run_id, count(*) as total, count(*) filter (status = 'new') as new_count,
          count(*) filter (status = 'duplicate') as duplicate_count,
          count(*) filter (status in ('failed', 'error')) as failed_count,
          count(*) filter (status <> 'failed') || '/' || count(*) as extracted from results group by run_id""",
)
def agg8(spark, sf):
    return R.summary_folded(run_results(spark, sf), ["run_id"])


def _sql_log(n: int) -> str:
    return f"""select run_id, seq, message from (
          select user_id as run_id, event_id as seq, event_type as message,
                 row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
        where n <= {n}"""


def _last(spark, sf, n):
    logs = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"), F.col("event_type").alias("message"),
    )
    return R.last_n_log(logs, ["run_id"], n).select("run_id", "seq", "message")


@register("WIN3_last_n_log", _sql_log(R.LOG_KEPT))
def win3(spark, sf):
    return _last(spark, sf, R.LOG_KEPT)


@register("WIN3_shown_log", _sql_log(R.LOG_SHOWN))
def win3_shown(spark, sf):
    return _last(spark, sf, R.LOG_SHOWN)


@register(
    "SNK11_article_export",
    """select 'in/articles/' || substr(sha256(url), 1, 16) || '.json' as key, url,
          md5(replace(html, '<br>', '')) as content_md5 from pages""",
)
def snk11(spark, sf):
    none = F.lit(None).cast("string")
    dirty = F.replace("html", F.lit("<br>"), F.lit("<img src='a.png'>"))
    articles = table(spark, sf, "pages").select(
        X.article_id(F.col("url")).alias("id"), "url", none.alias("title"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
        none.alias("summary"), none.alias("author"), F.expr("cast(array() as array<string>)").alias("categories"),
        none.alias("excerpt"), dirty.alias("full_content"), none.alias("full_content_text"),
    )
    out = article_export(articles, "/in/")
    return out.select(
        "key",
        F.get_json_object("json", "$.url").alias("url"),
        F.md5(F.get_json_object("json", "$.full_content")).alias("content_md5"),
    )
