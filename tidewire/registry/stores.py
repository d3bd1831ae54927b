"""Queries of the article store, of stories and of vector search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import filters as FL
from tidewire.operators import nearest as N
from tidewire.operators import similar as S
from tidewire.operators import store as ST
from tidewire.operators import stories as SY
from tidewire.registry.base import NOW, NOW_SQL, register, table
from tidewire.registry.scalars import SQL_STAMPS, stamped_events
from tidewire.schemas import STORY_SEGMENT

# Low enough to find pairs among the given vectors, which are far apart.
PAIR_THRESHOLD = 0.3

# -- the store --------------------------------------------------------------


def embedding_store(spark, sf):
    """Vectors with the stamps of the event of the same number."""
    stamps = stamped_events(spark, sf).select(F.col("event_id").alias("vec_id"), "metadata")
    rows = table(spark, sf, "embeddings").join(stamps, "vec_id", "left")
    labelled = F.map_concat(
        F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")),
        F.create_map(F.lit("title"), F.concat(F.lit("label "), "label")),
    )
    store = rows.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("content "), "vec_id").alias("content"),
        V.unit(F.col("embedding")).alias("vec"),
        labelled.alias("metadata"),
        "label",
    )
    return ST.resolve_stamps(store)


SQL_STORE = f"""
{SQL_STAMPS},
store as (
  select e.vec_id as id, 'content ' || e.vec_id as content, e.label, coalesce(s.pl, s.pr, s.pa) as ms,
    list_transform(e.embedding::double[], lambda x: x / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))) as vec
  from embeddings e left join parsed_stamps s on s.event_id = e.vec_id)
"""
_CUTOFF = "epoch_ms(timestamp '2024-01-01 06:00:00')"


@register("SRC4_store_list", f"with {SQL_STORE} select id, content from store order by id limit 100 offset 50")
def src4(spark, sf):
    return ST.store_list(embedding_store(spark, sf), 100, 50).select("id", "content")


@register("TOP2_page", "select event_id, event_type from events order by event_id limit 25 offset 100")
def top2(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_id", "id")
    return ST.store_list(rows, 25, 100).select(F.col("id").alias("event_id"), "event_type")


@register(
    "TOP2_deep_page",
    """select event_id, event_type from (
         select event_id, event_type, row_number() over (order by event_id) as n, count(*) over () as c from events)
       where n > c * 9 // 10 and n <= c * 9 // 10 + 25""",
)
def top2_deep(spark, sf):
    """A page nine tenths down: ranks are looked up, and only the page's range is read."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    pages = ST.PageIndex(rows, 1000)
    return pages.page(25, rows.count() * 9 // 10).select(F.col("id").alias("event_id"), "event_type")


@register(
    "SRC5_store_get",
    f"with {SQL_STORE} select id, content, ms as last_update_ms from store where id in (select user_id from events)",
)
def src5(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    found = ST.store_get_many(embedding_store(spark, sf), wanted)
    return found.select("id", "content", F.unix_millis("last_update").alias("last_update_ms"))


@register("AGG1_store_count", "select count(*) as count from embeddings")
def agg1(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return ST.store_count(rows)


@register(
    "SNK3_store_add_many",
    """select 'v' || vec_id as id, 'content ' || vec_id as content from embeddings
       union all select 'b' || item_id, text from benchmark""",
)
def snk3(spark, sf):
    store = table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("content "), "vec_id").alias("content")
    )
    more = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("content")
    )
    return ST.store_add_many(store, more)


@register(
    "SNK4_store_update",
    f"""with {SQL_STORE}, u as (select user_id as id, max(event_type) as title from events group by 1)
        select s.id, s.content, coalesce(u.title, 'label ' || s.label) as title from store s left join u using (id)""",
)
def snk4(spark, sf):
    updates = (
        table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("t"))
        .select("id", F.create_map(F.lit("title"), F.col("t")).alias("metadata"))
    )
    out = ST.store_update(embedding_store(spark, sf), updates)
    return out.select("id", "content", F.try_element_at("metadata", F.lit("title")).alias("title"))


@register(
    "SNK5_store_delete",
    f"with {SQL_STORE} select id from store where id not in (select user_id from events where event_type = 'error')",
)
def snk5(spark, sf):
    gone = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("id")).distinct()
    return ST.store_delete(embedding_store(spark, sf), gone).select("id")


@register("SNK6_store_clear", "select vec_id + 1000000000 as id, label::bigint as label from embeddings")
def snk6(spark, sf):
    """The whole store cleared and filled again with the same rows under other ids."""
    store = embedding_store(spark, sf)
    again = store.withColumn("id", F.col("id") + 1_000_000_000)
    filled = ST.store_add_many(ST.store_clear(store), again)
    title = F.try_element_at("metadata", F.lit("title"))
    return filled.select("id", F.regexp_extract(title, "label (.*)", 1).cast("long").alias("label"))


@register(
    "JN3_touch_match",
    f"""with {SQL_STORE}, m as (select distinct user_id as id from events where event_type = 'view')
        select s.id, case when m.id is null then s.ms else epoch_ms({NOW_SQL}) end as last_update_ms,
          case when m.id is not null then '2024-01-31T00:00:00Z' end as touched, 'label ' || s.label as title
        from store s left join m using (id)""",
)
def jn3(spark, sf):
    matched = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"))
    out = ST.touch(embedding_store(spark, sf), matched, F.lit(NOW))
    stamp = F.try_element_at("metadata", F.lit("last_retrieved_at"))
    return out.select(
        "id",
        F.unix_millis("last_update").alias("last_update_ms"),
        F.when(stamp == "2024-01-31T00:00:00Z", stamp).alias("touched"),
        F.try_element_at("metadata", F.lit("title")).alias("title"),
    )


@register(
    "DED6_ttl_cleanup",
    f"with {SQL_STORE} select id, ms as last_update_ms from store where ms >= {_CUTOFF}",
)
def ded6(spark, sf):
    out = ST.ttl_cleanup(embedding_store(spark, sf), datetime(2024, 1, 2, 6))
    return out.select("id", F.unix_millis("last_update").alias("last_update_ms"))


@register(
    "UDF2_vector_client",
    f"""with {SQL_STORE}, r as (select id, case when ms is null then 'invalid or missing TTL metadata'
               when ms < {_CUTOFF} then 'exceeded TTL' else 'kept' end as reason from store)
        select reason, count(*) as rows from r group by 1""",
)
def udf2(spark, sf):
    store = embedding_store(spark, sf)
    gone = ST.evictions(store, datetime(2024, 1, 2, 6))
    kept = ST.store_delete(store, gone).select("id", F.lit("kept").alias("reason"))
    return kept.unionByName(gone).groupBy("reason").agg(F.count("*").alias("rows"))


# -- vector search ----------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("vec"), "label"
    )


_SQL_SIMS = f"""
v as (
  select vec_id as id, label,
    list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as vec
  from embeddings),
sims as (
  select a.id as q, b.id as id, round(list_dot_product(a.vec, b.vec), 6) as sim, b.label
  from v a join v b on a.id <> b.id)
"""


@register(
    "JN2_knn_similar",
    f"""with {_SQL_SIMS} select q as query_id, id, sim from sims
        where sim >= {PAIR_THRESHOLD} and id < q""",
)
def jn2(spark, sf):
    v = _vectors(spark, sf).select("id", "vec")
    n = v.count()
    found = N.threshold_join(v, v, PAIR_THRESHOLD, n, n, earlier_only=True)
    return found.select(
        F.col("lid").alias("query_id"), F.col("rid").alias("id"), F.round("sim", S.SCORE_DIGITS).alias("sim")
    )


def _sql_top(k: int, where: str = "") -> str:
    return f"""with {_SQL_SIMS}, r as (
        select *, row_number() over (partition by q order by sim desc, id) as n from sims {where})
      select q as query_id, n::integer as rank, id, round(1 - sim, 6) as distance from r where n <= {k}"""


def _knn(spark, sf, store, threshold=None):
    q = _vectors(spark, sf).select("id", "vec")
    found = S.knn(q, store, FL.effective_k(), q.count(), store.count(), threshold, skip_self=True)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@register("TOP1_knn_top_k", _sql_top(5))
def top1(spark, sf):
    return _knn(spark, sf, _vectors(spark, sf).select("id", "vec"))


@register("FLT7_metadata_where", _sql_top(5, "where label >= 5"))
def flt7(spark, sf):
    store = ST.metadata_where(_vectors(spark, sf), F.col("label") >= 5)
    return _knn(spark, sf, store.select("id", "vec"))


@register(
    "FLT4_threshold_then_top_k",
    _sql_top(5, f"where sim >= {PAIR_THRESHOLD}"),
)
def flt4_knn(spark, sf):
    return _knn(spark, sf, _vectors(spark, sf).select("id", "vec"), PAIR_THRESHOLD)


@register(
    "AGG3_best_match",
    f"""with {_SQL_SIMS} select q as query_id, arg_min(id, (-sim, id)) as matching_id, max(sim) as similarity_score
        from sims where sim >= {PAIR_THRESHOLD} group by q""",
)
def agg3(spark, sf):
    v = _vectors(spark, sf).select("id", "vec")
    n = v.count()
    return S.best_match(N.nearest_join(v, v, 1, n, n, PAIR_THRESHOLD, skip_self=True))


# -- stories ----------------------------------------------------------------


def _story_rows(spark, sf):
    """Documents start the stories; benchmark passages and labels' documents append to them."""
    docs = table(spark, sf, "documents")
    new = docs.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("s"), "doc_id").alias("id"), F.col("lang").alias("title"),
        F.col("text").alias("body"),
    )
    items = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("s"), "user_id").alias("matching_id"),
        F.col("event_type").alias("title"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("body"),
    )
    return new, items


def _segments(spark, sf):
    new, _ = _story_rows(spark, sf)
    empty = spark.createDataFrame([], STORY_SEGMENT)
    return SY.story_create(empty, new)


@register(
    "SNK1_story_create",
    "select 's' || doc_id as id, md5(lang || chr(10) || text) as body_md5 from documents",
)
def snk1(spark, sf):
    return _segments(spark, sf).select("id", F.md5("text").alias("body_md5"))


_SQL_SEGMENTS = """
segs as (
  select 's' || doc_id as id, 0 as run, doc_id as seq, lang || chr(10) || text as t from documents
  union all
  select 's' || user_id, 1 + event_id % 2, event_id // 2, event_type || ' ' || event_id from events
  where user_id in (select doc_id from documents))
"""


@register(
    "SNK2_story_append",
    f"""with {_SQL_SEGMENTS} select id, 0::bigint as part,
          md5(string_agg(t, chr(10) || '--' || chr(10) order by run, seq)) as body_md5 from segs group by all""",
)
def snk2(spark, sf):
    """Two runs append to the stories of a first one; each counts its ``seq`` from the start."""
    _, items = _story_rows(spark, sf)
    total = table(spark, sf, "events").count()
    segments = _segments(spark, sf)
    for run in (1, 2):
        part = items.where(F.col("seq") % 2 == run - 1).withColumn("seq", F.floor(F.col("seq") / 2))
        segments, _ = SY.story_append(segments, part, total, run=run)
    return SY.append_concat(segments).select("id", "part", F.md5("body").alias("body_md5"))


@register(
    "AGG9_append_concat",
    """select 's' || user_id as id, 0::bigint as part,
          string_agg(event_type || ' ' || event_id, chr(10) || '--' || chr(10) order by event_id) as body
        from events group by all""",
)
def agg9(spark, sf):
    _, items = _story_rows(spark, sf)
    return SY.append_concat(SY.append_rows(items))


@register(
    "JN5_story_match",
    """select user_id in (select doc_id from documents) as found, count(*) as appends from events group by 1""",
)
def jn5(spark, sf):
    _, items = _story_rows(spark, sf)
    total = table(spark, sf, "events").count()
    base = _segments(spark, sf)
    known, missing = SY.story_append(base, items, total, run=1)
    hits = known.where("run = 1").select(F.lit(True).alias("found"))
    return hits.unionByName(missing.select(F.lit(False).alias("found"))).groupBy("found").agg(
        F.count("*").alias("appends")
    )
