"""Queries of the dedup operators, checked against a walk in processing order."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.functions import vectors as V
from tidewire.operators import runs as R
from tidewire.operators.embedders import DenseEmbedder, TermEmbedder
from tidewire.operators.exact import exact_keep_first, exact_match
from tidewire.operators.membership import build_filter, filtered_match
from tidewire.plans import dedup as D
from tidewire.plans.state import State, store_metadata
from tidewire.registry.base import (
    NOW, SQL_TITLE, SQL_URL_KEY, document_articles, page_articles, register, sql_decode, sql_trim,
    table, url_key,
)
from tidewire.registry.stores import PAIR_THRESHOLD
from tidewire.session import cut, widen

THRESHOLD = 0.95

# -- SQL: page text, term vectors, and the walk -----------------------------


def _sql_main_text() -> str:
    """``plain_text(main_content(html))`` with the library's patterns."""
    clean = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in H.DROPPED_ELEMENTS:
        clean = rf"regexp_replace({clean}, '(?is)<{name}(?:\s[^>]*)?>.*?</{name}>', '', 'g')"
    clean = (
        rf"""regexp_replace({clean}, '(?is)<div[^>]*class=["'']?(?:ad|ads|advert|sponsor)[\s"''][^>]*>.*?</div>', '', 'g')"""
    )
    picks = ", ".join(
        rf"nullif(regexp_extract(clean, '(?is)<{n}(?:\s[^>]*)?>(.*)</{n}>', 1), '')"
        for n in ("article", "main", "body")
    )
    lines = rf"regexp_replace(content, '(?i)</?(?:{H.BLOCK_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g')"
    bare = sql_decode(rf"regexp_replace({lines}, '<[^>]*>', '', 'g')")
    spaced = rf"regexp_replace({bare}, '[ \t\r\f ]+', ' ', 'g')"
    text = sql_trim(rf"regexp_replace({spaced}, ' ?\n[ \n]*', chr(10), 'g')")
    return f"""
      c0 as (select *, {clean} as clean from pages),
      c1 as (select *, {sql_trim(f"coalesce({picks}, clean)")} as content from c0),
      page_text as (select page_id, url, html, content, {text} as text, {SQL_TITLE} as title from c1)"""


SQL_PAGE_TEXT = _sql_main_text()

# Needs survivors(seq, text) and corpus(seq, text), the texts the model is fitted on.
SQL_VECTORS = r"""
tok as (
  select seq, ('0x' || substr(md5(t), 1, 15))::bigint as f, count(*) as n
  from (select seq, unnest(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '')) as t
        from corpus) group by all),
dfs as (select f >> 36 as slot, count(distinct seq) as df from tok group by f >> 36),
docs as (select count(*) as n from corpus),
raw_w as (
  select seq, f, t.n * (ln((docs.n + 1.0) / (df + 1.0)) + 1.0) as w from tok t join dfs on dfs.slot = t.f >> 36, docs),
norms as (select seq, sqrt(sum(w * w)) as norm from raw_w group by seq),
vec as (select seq, f, w / norm as w from raw_w join norms using (seq))
"""


def sql_walk(threshold: float) -> str:
    """Needs sims(l, r, sim) with l <> r, r earlier; ``survivors(seq, id)``.

    Gives ``kept_list`` and ``judged(seq, id, matching_id, sim)``.
    """
    return f"""
near as (select l as seq, list(r) as rs from sims where sim >= {threshold} and r < l group by l),
steps as (
  select row_number() over (order by seq) as n, seq, coalesce(rs, []::bigint[]) as rs
  from survivors left join near using (seq)),
walk(n, kept) as (
  select 0::bigint, []::bigint[]
  union all
  select w.n + 1, case when list_has_any(w.kept, s.rs) then w.kept else list_append(w.kept, s.seq) end
  from walk w join steps s on s.n = w.n + 1),
kept_list as (select unnest(kept) as seq from (select kept from walk order by n desc limit 1)),
found as (
  select s.l as seq, p.id, round(s.sim, 6) as sim from sims s join kept_list k on k.seq = s.r
  join survivors p on p.seq = s.r where s.sim >= {threshold} and s.r < s.l),
judged as (
  select v.seq, v.id, arg_min(f.id, (-f.sim, f.id)) as matching_id, max(f.sim) as sim
  from survivors v left join found f using (seq) group by all)
"""


SQL_TERM_SIMS = "sims as (select a.seq as l, b.seq as r, sum(a.w * b.w) as sim from vec a join vec b on a.f = b.f and b.seq < a.seq group by all)"

# Needs arts(seq, id, url, title).  Walks in order with the kept URLs and titles.
SQL_EXACT = """
ord as (select row_number() over (order by seq) as n, * from arts),
ewalk(n, urls, titles, kept) as (
  select 0::bigint, []::varchar[], []::varchar[], []::bigint[]
  union all
  select w.n + 1,
    case when list_contains(w.urls, o.url) or list_contains(w.titles, o.title) then w.urls else list_append(w.urls, o.url) end,
    case when list_contains(w.urls, o.url) or list_contains(w.titles, o.title) then w.titles else list_append(w.titles, o.title) end,
    case when list_contains(w.urls, o.url) or list_contains(w.titles, o.title) then w.kept else list_append(w.kept, o.seq) end
  from ewalk w join ord o on o.n = w.n + 1),
passed as (select unnest(kept) as seq from (select kept from ewalk order by n desc limit 1))
"""

_RESULT = """
  case when j.seq is null or j.matching_id is not null then 'duplicate' else 'new' end as status,
  j.seq is null as is_exact_duplicate,
  case when j.seq is null then a.id else j.matching_id end as matching_id,
  round(coalesce(j.sim, 0.0), 6)::double as similarity_score
"""


def _shown(results):
    return results.select(
        "seq", "id", "status", "is_exact_duplicate", "matching_id",
        "similarity_score",
    )


# -- exact stage ------------------------------------------------------------


_SQL_SEEN = f"""with a as (select page_id as seq, {SQL_URL_KEY} as url, {SQL_TITLE} as title, url as raw from pages),
        seen as (select 'title' as kind, title as value from a where raw like 'http://%'
                 union select 'url', url from a where raw like '%/fr/%')
        select seq, exists (select 1 from seen where kind = 'url' and value = a.url)
          or exists (select 1 from seen where kind = 'title' and value = a.title) as is_exact from a"""


def _asked_and_seen(spark, sf):
    a = table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), url_key(F.col("url")).alias("url"),
        H.html_title(F.col("html")).alias("title"), F.col("url").alias("raw"),
    )
    seen = a.where("raw like 'http://%'").select(F.lit("title").alias("kind"), F.col("title").alias("value")).unionByName(
        a.where("raw like '%/fr/%'").select(F.lit("url").alias("kind"), F.col("url").alias("value"))
    )
    return a, seen


def _flagged(a, found):
    hits = found.withColumn("hit", F.lit(True))
    return a.select("seq").join(hits, "seq", "left").select("seq", F.coalesce("hit", F.lit(False)).alias("is_exact"))


@register("JN1_exact_match", _SQL_SEEN)
def jn1(spark, sf):
    a, seen = _asked_and_seen(spark, sf)
    return _flagged(a, exact_match(a, seen, a.count()))


@register("JN1_filtered_match", _SQL_SEEN)
def jn1_filtered(spark, sf):
    """The same rows, past the Bloom filters of two parts of the history."""
    a, seen = _asked_and_seen(spark, sf)
    a, seen = cut(a, "asked"), cut(seen, "seen")
    parts = [seen.where(F.col("kind") == kind) for kind in ("url", "title")]
    filters = [build_filter(part, part.count(), i) for i, part in enumerate(parts)]
    return _flagged(a, filtered_match(a, seen, cut(filters[0].unionByName(filters[1]), "filters"), a.count()))


# Pages by host and title: both keys repeat, so dropped rows must not drop others.
_SQL_HOSTS = rf"""
arts as (
  select page_id as seq, substr(sha256(url), 1, 16) as id,
         regexp_extract(url, '^https?://([^/?#]+)', 1) as url, {SQL_TITLE} as title from pages)
"""


def _host_articles(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("url"),
        H.html_title(F.col("html")).alias("title"),
    )


@register(
    "DED3_exact_keep_first",
    f"with recursive {_SQL_HOSTS}, {SQL_EXACT} select seq from passed",
)
def ded3_exact(spark, sf):
    articles = _host_articles(spark, sf)
    return exact_keep_first(articles, articles.count())


@register(
    "DED4_exact_add",
    f"""with a as (select {SQL_URL_KEY} as url, {SQL_TITLE} as title from pages)
        select 'url' as kind, url as value from a union select 'title', title from a
        union select 'title', 'old ' || lang from documents""",
)
def ded4(spark, sf):
    a = table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), url_key(F.col("url")).alias("url"), H.html_title(F.col("html")).alias("title")
    )
    old = table(spark, sf, "documents").select(
        F.lit("title").alias("kind"), F.concat(F.lit("old "), "lang").alias("value")
    )
    before = State(State.empty(spark).store, old, NOW - timedelta(hours=23, minutes=59))
    return D.exact_add(a, before, NOW).seen


# -- near stage -------------------------------------------------------------


@register(
    "UDF1_embed",
    f"""with corpus as (select doc_id as seq, text from documents), {SQL_VECTORS}
        select seq as doc_id, count(*) as terms, round(max(w), 6) as heaviest, round(sum(w), 6) as total from vec group by seq""",
)
def udf1(spark, sf):
    docs = widen(table(spark, sf, "documents").select("doc_id", "text"))
    counted = cut(V.with_terms(docs, "text").drop("text"), "terms")
    vecs = V.embed(counted, V.fit(counted), THRESHOLD)
    return vecs.select(
        "doc_id",
        F.size("vec.f").cast("long").alias("terms"),
        F.round(F.array_max("vec.w"), 6).alias("heaviest"),
        F.round(F.aggregate("vec.w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


_SQL_DOC_ARTS = """
arts as (
  select doc_id as seq, 'd' || lpad(doc_id::varchar, 9, '0') as id, 'https://docs.example.org/' || doc_id as url,
         'Title ' || doc_id as title, text from documents),
survivors as (select seq, id, text from arts),
corpus as (select seq, text from survivors)
"""
_SQL_DOCS = f"with recursive {_SQL_DOC_ARTS}, {SQL_VECTORS}, {SQL_TERM_SIMS}, {sql_walk(THRESHOLD)}"


@register(
    "DED3_process_documents",
    f"{_SQL_DOCS} select a.seq, a.id, {_RESULT} from arts a left join judged j using (seq)",
)
def ded3_documents(spark, sf):
    out = D.process(document_articles(spark, sf), State.empty(spark), NOW, TermEmbedder(THRESHOLD))
    return _shown(out.results)


_SQL_PAGE_ARTS = f"""
{SQL_PAGE_TEXT},
arts as (
  select page_id as seq, substr(sha256(url), 1, 16) as id, {SQL_URL_KEY} as url, title, text from page_text),
{SQL_EXACT},
survivors as (select seq, id, text from arts where seq in (select seq from passed)),
corpus as (select seq, text from survivors)
"""


@register(
    "DED3_process_pages",
    f"""with recursive {_SQL_PAGE_ARTS}, {SQL_VECTORS}, {SQL_TERM_SIMS}, {sql_walk(THRESHOLD)}
        select a.seq, a.id, {_RESULT} from arts a left join judged j using (seq)""",
)
def ded3_pages(spark, sf):
    out = D.process(page_articles(spark, sf), State.empty(spark), NOW, TermEmbedder(THRESHOLD))
    return _shown(out.results)


def _vector_articles(spark, sf, shift: bool = False):
    """Articles whose text is their vector, so that the provider only reads it."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    if shift:
        wide = F.concat(F.slice(wide, 2, F.size("embedding")), F.slice(wide, 1, 1))
    key = F.col("vec_id").cast("string")
    none = F.lit(None).cast("string")
    return widen(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("v"), F.lpad(key, 9, "0")).alias("id"),
        F.concat(F.lit("u"), key).alias("url"),
        F.concat(F.lit("t"), key).alias("title"),
        F.lit("").alias("summary"),
        F.lit("").alias("author"),
        F.expr("cast(array() as array<string>)").alias("categories"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        none.alias("full_content"),
        F.to_json(wide).alias("full_content_text"),
        none.alias("extraction_error"),
    )


def _dense(threshold: float = PAIR_THRESHOLD) -> DenseEmbedder:
    return DenseEmbedder(threshold, lambda t: F.from_json(t, "array<double>"), "given")


_SQL_UNIT = """
v as (
  select vec_id as seq, 'v' || lpad(vec_id::varchar, 9, '0') as id,
    list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as vec
  from embeddings)
"""
_SQL_DENSE = f"""{_SQL_UNIT},
survivors as (select seq, id from v),
arts as (select seq, id from v),
sims as (select a.seq as l, b.seq as r, list_dot_product(a.vec, b.vec) as sim from v a join v b on b.seq < a.seq)
"""


@register(
    "DED3_process_vectors",
    f"""with recursive {_SQL_DENSE}, {sql_walk(PAIR_THRESHOLD)}
        select a.seq, a.id, {_RESULT} from arts a left join judged j using (seq)""",
)
def ded3_vectors(spark, sf):
    empty = State.empty(spark, DenseEmbedder.vector_type)
    return _shown(D.process(_vector_articles(spark, sf), empty, NOW, _dense()).results)


@register(
    "DED5_process_all",
    f"""with recursive {_SQL_DENSE}, {sql_walk(PAIR_THRESHOLD)}
        select id, case when matching_id is null then 'new' else 'duplicate' end as status from judged where seq % 10 <> 3
        union all select 'v' || lpad(vec_id::varchar, 9, '0'), 'failed' from embeddings where vec_id % 10 = 3"""
    .replace("survivors as (select seq, id from v)", "survivors as (select seq, id from v where seq % 10 <> 3)")
    .replace("join v b on b.seq < a.seq)", "join v b on b.seq < a.seq where a.seq % 10 <> 3 and b.seq % 10 <> 3)"),
)
def ded5(spark, sf):
    """All articles in one batch; every tenth failed extraction and is reported as such."""
    failed = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("timeout "), "id"))
    articles = _vector_articles(spark, sf).withColumn("extraction_error", failed)
    out = D.process(articles, State.empty(spark, DenseEmbedder.vector_type), NOW, _dense())
    return out.results.select("id", "status")


def _vector_store(spark, sf) -> State:
    """All vectors as a store of mixed age: the older the higher the number."""
    a = _vector_articles(spark, sf)
    age = F.make_interval(hours=F.pmod(F.col("seq"), F.lit(40)).cast("int"))
    rows = a.select(
        "id",
        F.col("full_content_text").alias("content"),
        V.unit(F.from_json("full_content_text", "array<double>")).alias("vec"),
        F.expr(f"cast(array() as array<{V.KEY_TYPE}>)").alias("keys"),
        store_metadata(F.lit(NOW)).alias("metadata"),
        (F.lit(NOW) - age).alias("last_update"),
        F.lit("given").alias("model_name"),
    )
    return State(rows, State.empty(spark).seen, NOW)


_SQL_CHECK = f"""{_SQL_UNIT},
q as (
  select seq, id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as vec from (
    select vec_id as seq, 'v' || lpad(vec_id::varchar, 9, '0') as id,
           list_concat(embedding[2:], embedding[1:1])::double[] as s from embeddings)),
hits as (
  select q.seq, v.id, round(list_dot_product(q.vec, v.vec), 6) as sim, v.seq % 40 <= 24 as fresh
  from q join v on true)
"""


def _check_rows(out):
    return out.results.select(
        "seq", "id", "is_duplicate", "matching_id", "similarity_score"
    )


@register(
    "DED1_check",
    f"""with {_SQL_CHECK}, best as (
          select seq, arg_min(id, (-sim, id)) as matching_id, max(sim) as sim from hits
          where fresh and sim >= 0.2 group by seq)
        select q.seq, q.id, b.seq is not null as is_duplicate, b.matching_id,
               round(coalesce(b.sim, 0), 6)::double as similarity_score
        from q left join best b using (seq)""",
)
def ded1(spark, sf):
    queries = _vector_articles(spark, sf, shift=True)
    return _check_rows(D.check(queries, _vector_store(spark, sf), NOW, _dense(0.2)))


@register(
    "DED1_check_after_top_k",
    f"""with {_SQL_CHECK}, ranked as (
          select *, row_number() over (partition by seq order by sim desc, id) as n from hits where sim >= 0.2),
        best as (select seq, arg_min(id, (-sim, id)) as matching_id, max(sim) as sim from ranked
                 where n <= 5 and fresh group by seq)
        select q.seq, q.id, b.seq is not null as is_duplicate, b.matching_id,
               round(coalesce(b.sim, 0), 6)::double as similarity_score
        from q left join best b using (seq)""",
)
def ded1_after(spark, sf):
    queries = _vector_articles(spark, sf, shift=True)
    out = D.check(queries, _vector_store(spark, sf), NOW, _dense(0.2), ttl_mode="after_topk")
    return _check_rows(out)


@register(
    "DED2_add",
    """select 'v' || lpad(vec_id::varchar, 9, '0') as id, len(embedding)::integer as dims, 1 as adds from embeddings
       union all select 'v' || lpad(vec_id::varchar, 9, '0'), len(embedding)::integer, 2 from embeddings""",
)
def ded2(spark, sf):
    """Adding twice stores twice: nothing is checked."""
    articles = _vector_articles(spark, sf)
    embedder = _dense()
    once = D.add(articles, State.empty(spark, DenseEmbedder.vector_type), NOW, embedder).state
    twice = D.add(articles.withColumn("full_content", F.lit("again")), once, NOW, embedder).state
    order = Window.partitionBy("id").orderBy("content")
    return twice.store.select("id", F.size("vec").alias("dims"), F.row_number().over(order).alias("adds"))


@register(
    "DED7_similar_search",
    f"""with recursive corpus as (
          select doc_id as seq, text from documents union all select item_id + 1000000000, text from benchmark),
        {SQL_VECTORS},
        hits as (
          select a.seq - 1000000000 as query_id, 'd' || lpad(b.seq::varchar, 9, '0') as id, round(sum(a.w * b.w), 6) as sim
          from vec a join vec b on a.f = b.f where a.seq >= 1000000000 and b.seq < 1000000000 group by a.seq, b.seq),
        r as (select *, row_number() over (partition by query_id order by sim desc, id) as n from hits where sim >= 0.5)
        select query_id, n::integer as rank, id, round(1 - sim, 6) as distance from r where n <= 5""",
)
def ded7(spark, sf):
    """Benchmark passages against all documents, one model fitted on both."""
    docs = widen(table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), "text")
    embedder = TermEmbedder(0.5, V.fit(V.with_terms(docs.unionByName(items), "text")))
    articles = docs.select(
        "seq",
        F.concat(F.lit("d"), F.lpad(F.col("seq").cast("string"), 9, "0")).alias("id"),
        F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("author"), F.lit("").alias("summary"),
        F.expr("cast(array() as array<string>)").alias("categories"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit("").alias("full_content"), F.col("text").alias("full_content_text"),
    )
    stored = D.add(articles, State.empty(spark), NOW, embedder).state
    found = D.similar_search(items, stored, embedder)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@register(
    "DED3_chain",
    "select event_id as seq, event_id % 2 = 0 as kept from events",
)
def ded3_chain(spark, sf):
    """All events, numbered from 0, as one chain: in turn two neighbours share a URL and a title.

    So a row is kept iff its number is even, and a plain round would settle two rows alone.
    """
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.floor((n + 1) / 2)).alias("url"),
        F.concat(F.lit("t"), F.floor(n / 2)).alias("title"),
    )
    rows = cut(rows, "chain")
    kept = exact_keep_first(rows).withColumn("kept", F.lit(True))
    return rows.select("seq").join(kept, "seq", "left").select("seq", F.coalesce("kept", F.lit(False)).alias("kept"))
