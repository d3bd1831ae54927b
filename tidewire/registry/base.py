"""Inputs shared by the registered queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.functions.text import article_id
from tidewire.session import tune, widen

NOW = datetime(2024, 1, 31)
# Messages of one partition or landed file at most; each has some hundred bytes.
MESSAGE_ROWS = 100_000
NOW_SQL = "timestamp '2024-01-31 00:00:00'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def blank_every(c: Column, by: Column, n: int) -> Column:
    return F.when(by % n == 0, "").otherwise(c)


def _sql_title(expr: str) -> str:
    """The first title outside comments and scripts, as SQL."""
    clean = rf"regexp_replace({expr}, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    for name in H.SCRIPTS:
        clean = rf"regexp_replace({clean}, '(?is)<{name}(?:\s[^>]*)?>.*?</{name}>', '', 'g')"
    return rf"regexp_extract({clean}, '(?is)<title(?:\s[^>]*)?>(.*?)(?:</title|\z)', 1)"




def sql_decode(expr: str) -> str:
    for name, char in H.ENTITIES:
        char = char.replace("'", "''")
        expr = f"replace({expr}, '{name}', '{char}')"
    return f"replace({expr}, '&amp;', '&')"


def sql_trim(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\x85\pZ]+|[\s\x85\pZ]+\z', '', 'g')"


SQL_TITLE = sql_trim(sql_decode(_sql_title("html")))
SQL_URL_KEY = r"regexp_replace(url, '[?#].*$', '')"


def url_key(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the pages: order by page, URL without query, title of the page."""
    pages = widen(table(spark, sf, "pages"))
    none = F.lit(None).cast("string")
    return pages.select(
        F.col("page_id").alias("seq"),
        article_id(F.col("url")).alias("id"),
        H.html_title(F.col("html")).alias("title"),
        url_key(F.col("url")).alias("url"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(NOW).alias("fetched_at"),
        F.lit("").alias("summary"),
        F.lit("").alias("author"),
        F.expr("cast(array() as array<string>)").alias("categories"),
        none.alias("full_content"),
        H.plain_text(H.main_content(F.col("html"))).alias("full_content_text"),
        none.alias("excerpt"),
        none.alias("image_url"),
        none.alias("extraction_error"),
    )


def document_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the documents, each with a URL and a title of its own."""
    docs = widen(table(spark, sf, "documents"))
    none = F.lit(None).cast("string")
    key = F.col("doc_id").cast("string")
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("d"), F.lpad(key, 9, "0")).alias("id"),
        F.concat(F.lit("Title "), key).alias("title"),
        F.concat(F.lit("https://docs.example.org/"), key).alias("url"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(NOW).alias("fetched_at"),
        F.lit("").alias("summary"),
        F.col("source").alias("author"),
        F.array("lang").alias("categories"),
        none.alias("full_content"),
        F.col("text").alias("full_content_text"),
        none.alias("excerpt"),
        none.alias("image_url"),
        none.alias("extraction_error"),
    )


def caption_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as messages: a word every 0.4 s, shown for 0.35 s."""
    turns = widen(table(spark, sf, "conversations"))
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        "role",
        F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("text"),
                (i * 4 / 10.0).alias("start"),
                ((i * 40 + 35) / 100.0).alias("end"),
            ),
        ).alias("subtitle_timestamps"),
    )


SQL_WORDS = r"""
turns as (
  select concat_ws('-', conv_id, turn) as uuid, role,
         list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') as ws
  from conversations),
words as (
  select uuid, role, unnest(range(len(ws)))::bigint as i, unnest(ws) as w, len(ws)::bigint as n
  from turns),
timed as (
  select *, i * 4 / 10.0::double as st, (i * 40 + 35) / 100.0::double as en,
         regexp_matches(w, '[.!?]\z') and not regexp_matches(w, '(^|[0-9])[0-9][.]\z') as ends
  from words),
segs as (
  select *, coalesce(sum(case when ends then 1 else 0 end) over (
      partition by uuid order by i rows between unbounded preceding and 1 preceding), 0) as seg
  from timed),
cut as (
  select *, (row_number() over (partition by uuid, seg order by i) - 1) // 5 as chunk
  from segs),
lined as (
  select *, dense_rank() over (partition by uuid order by seg, chunk) - 1 as line,
         row_number() over (partition by uuid, seg, chunk order by i) - 1 as pos,
         lead(st) over (partition by uuid, seg, chunk order by i) as next_st
  from cut)
"""

# Events as results of runs: the user is the run, the kind of event the status.
RESULT_STATUS = {
    "signup": "new", "purchase": "new", "view": "duplicate", "click": "failed", "error": "error"
}


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    status = F.create_map(*[F.lit(x) for pair in RESULT_STATUS.items() for x in pair])
    key = F.col("event_id").cast("string")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.try_element_at(status, F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("https://e.example.org/"), key)).alias("url"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("stories/"), key)).alias("object_key"),
    )


SQL_RESULTS = """
results as (
  select user_id as run_id, event_id as seq,
         case event_type when 'signup' then 'new' when 'purchase' then 'new' when 'view' then 'duplicate'
              when 'click' then 'failed' when 'error' then 'error' end as status,
         case when event_id % 4 = 0 then '' else 'https://e.example.org/' || event_id end as url,
         case when event_id % 3 = 0 then '' else 'stories/' || event_id end as object_key
  from events)
"""


def message_values(spark: SparkSession, sf: str) -> DataFrame:
    """Events as message envelopes; some are broken, mistyped or incomplete.

    By event id: every 13th is cut off, every 17th is ``null``, every 19th a list,
    every 23rd has a number as uuid; every 11th has an empty uuid, every 7th no
    voiceover, every 5th no captions.  Errors become failures.
    """
    e = widen(table(spark, sf, "events"), MESSAGE_ROWS)
    n = F.col("event_id")
    key = n.cast("string")
    uuid = F.when(n % 11 == 0, '""').when(n % 23 == 0, key).otherwise(F.concat(F.lit('"u'), key, F.lit('"')))
    words = F.when(n % 5 == 0, "[]").otherwise(
        F.concat(F.lit('[{"text":"w'), key, F.lit('","start":0,"end":0.5}]'))
    )
    whole = F.concat(
        F.lit('{"uuid":'), uuid,
        F.lit(',"status":"'), F.when(F.col("event_type") == "error", "failure").otherwise("success"),
        F.lit('","voiceover":"'), F.when(n % 7 == 0, "").otherwise(F.repeat(F.concat(key, F.lit(" ")), 60)),
        F.lit('","subtitle_timestamps":'), words,
        F.lit(',"timings":{"step":'), (n % 100).cast("string"),
        F.lit('},"article_urls":["https://e.example.org/'), key, F.lit('"]}'),
    )
    value = (
        F.when(n % 13 == 0, F.concat(F.lit('{"uuid":"u'), key))
        .when(n % 17 == 0, "null")
        .when(n % 19 == 0, "[]")
        .otherwise(whole)
    )
    return e.select(
        F.concat(F.lit("videos-"), F.col("event_type")).alias("topic"),
        (F.col("user_id") % 8).cast("int").alias("partition"),
        n.alias("offset"),
        F.col("user_id").cast("string").alias("key"),
        value.alias("value"),
    )


SQL_MESSAGES = """
raw as (
  select event_id as "offset", 'videos-' || event_type as topic, user_id::varchar as key,
    case when event_id % 13 = 0 then '{"uuid":"u' || event_id
         when event_id % 17 = 0 then 'null'
         when event_id % 19 = 0 then '[]'
         else '{"uuid":' || case when event_id % 11 = 0 then '""' when event_id % 23 = 0 then event_id::varchar
                                 else '"u' || event_id || '"' end
           || ',"status":"' || case when event_type = 'error' then 'failure' else 'success' end
           || '","voiceover":"' || case when event_id % 7 = 0 then '' else repeat(event_id || ' ', 60) end
           || '","subtitle_timestamps":' || case when event_id % 5 = 0 then '[]'
                else '[{"text":"w' || event_id || '","start":0,"end":0.5}]' end
           || ',"timings":{"step":' || (event_id % 100) || '},"article_urls":["https://e.example.org/' || event_id || '"]}'
    end as value
  from events),
parsed as (
  select *, case when json_valid(value) then value::json end as j from raw),
decoded as (
  select *, coalesce(json_type(j) in ('OBJECT', 'NULL')
              and coalesce(json_type(j, '$.uuid'), 'NULL') in ('VARCHAR', 'NULL'), false) as ok
  from parsed),
msg as (
  select "offset", topic, key, value, ok,
    case when ok then j->>'$.uuid' end as uuid, case when ok then j->>'$.status' end as status,
    case when ok then j->>'$.voiceover' end as voiceover,
    case when ok then coalesce(json_array_length(j, '$.subtitle_timestamps'), 0) else 0 end as n_words,
    j as j
  from decoded)
"""
