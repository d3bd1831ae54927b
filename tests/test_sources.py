"""Feeds, pages and messages as files, and the streams over them."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import stories as SY
from tidewire.operators.embedders import TermEmbedder
from tidewire.operators.ordered import ordered_parts
from tidewire.operators.spread import spread_join
from tidewire.plans.ingest import ingest
from tidewire.plans.state import State
from tidewire.registry import base
from tidewire.schemas import STORY_SEGMENT
from tidewire.sources import feeds as FD
from tidewire.sources import messages as MS
from tidewire.sources.pages import page_extract
from tidewire.streaming import messages as SM
from tidewire.streaming.state import StateFolder, run_batch

NOW = datetime(2024, 1, 31)

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="d" xmlns:content="c"><channel><title>f</title>
<item><title>One &amp; only</title><link>http://a/1</link><guid>g1</guid><description/><content:encoded><![CDATA[<p>body</p>]]></content:encoded>
<author>m@x.org (Ann)</author><category>x</category><category>y</category><pubDate>Mon, 02 Jan 2006 15:04:05 GMT</pubDate></item>
<item><title>Two</title><guid>g2</guid><description>d2</description></item>
<item><description>nothing</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title>E</title><link rel="self" href="http://b/self"/><link rel="alternate" href="http://b/1"/><id>i1</id>
<summary>s</summary><updated>2006-01-02T15:04:05+02:00</updated><author><name>Bo</name></author><category term="z"/></entry></feed>"""


def test_feeds(spark, tmp_path):
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<rss><channel><item>"), ("d.xml", "<rss><channel><title>e</title></channel></rss>"), ("e.xml", "<html><p/></html>")):
        (tmp_path / name).write_text(text)
    parsed = FD.parse_feeds(FD.read_feed_files(spark, str(tmp_path)))
    assert sorted(r["feed"][-5:] for r in FD.feed_errors(parsed).collect()) == ["c.xml", "e.xml"]
    rows = FD.in_feed_order(FD.feed_articles(parsed, NOW)).orderBy("seq").collect()
    assert [r["title"] for r in rows] == ["One & only", "Two", "", "E"]
    one, two, none, atom = rows
    assert (one["summary"], one["author"], one["categories"]) == ("<p>body</p>", "Ann", ["x", "y"])
    assert one["published_at"] == datetime(2006, 1, 2, 15, 4, 5) and two["published_at"] is None
    assert two["url"] == "" and len(two["id"]) == 16 and none["id"] == ""
    assert (atom["url"], atom["author"], atom["categories"]) == ("http://b/1", "Bo", ["z"])
    assert atom["published_at"] == datetime(2006, 1, 2, 13, 4, 5)
    assert FD.feed_scan(spark, str(tmp_path), NOW, 1).count() == 2


RDF = """<rdf:RDF xmlns:rdf="r" xmlns="p" xmlns:dc="d"><channel><title>f</title></channel>
<item><title>R1</title><link>http://c/1</link><dc:date>2006-01-02T15:04:05Z</dc:date></item><item><title>R2</title><link>http://c/2</link></item></rdf:RDF>"""
JSON_FEED = """{"version":"https://jsonfeed.org/version/1.1","title":"f","items":[{"id":"j1","url":"http://d/1","title":"J",
"content_html":"<p>x</p>","date_published":"2006-01-02T15:04:05Z","authors":[{"name":"Al"}],"tags":["t"]}]}"""


def test_other_feeds(spark):
    docs = [("a", RDF), ("b", JSON_FEED), ("c", '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>none yet</title></feed>'),
            ("d", '{"items":[]}'), ("e", "{broken"), ("f", None), ("g", "")]
    parsed = FD.parse_feeds(spark.createDataFrame(docs, "feed string, xml string"))
    assert sorted(r["feed"] for r in FD.feed_errors(parsed).collect()) == ["d", "e", "f", "g"]
    rows = FD.feed_articles(parsed, NOW).orderBy("feed", "pos").collect()
    assert [(r["feed"], r["title"], r["url"]) for r in rows] == [("a", "R1", "http://c/1"), ("a", "R2", "http://c/2"), ("b", "J", "http://d/1")]
    assert rows[0]["published_at"] == rows[2]["published_at"] == datetime(2006, 1, 2, 15, 4, 5)
    assert (rows[2]["summary"], rows[2]["author"], rows[2]["categories"]) == ("<p>x</p>", "Al", ["t"])


def test_two_pages_of_one_url(spark):
    pages = spark.createDataFrame([(2, "u", page("second")), (1, "u", page("first")), (3, "", page("none"))], "page_id long, url string, html string")
    rows = spark.createDataFrame([(0, "u"), (1, ""), (2, None)], "seq long, url string")
    for c in ("author", "image_url", "full_content", "full_content_text", "excerpt", "extraction_error"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    got = sorted(map(tuple, page_extract(rows, pages).select("seq", "full_content_text", "extraction_error").collect()))
    assert got == [(0, "first", None), (1, None, "article URL is empty"), (2, None, "article URL is empty")]


def test_resolve(spark):
    asked = spark.createDataFrame([("tr", 0), ("", 3), ("http://x", None)], "feed string, count int")
    got = {(r["feed_url"], r["count"]) for r in FD.resolve_feeds(asked, FD.feed_presets(spark)).collect()}
    assert got == {("https://www.technologyreview.com/feed/", 10),
                   ("https://www.straitstimes.com/news/singapore/rss.xml", 3), ("http://x", 10)}


def test_message_edges(spark, tmp_path):
    values = {
        "ok.json": '{"uuid":"u","status":"success","voiceover":"v","subtitle_timestamps":[{"text":"a","start":0,"end":0.5}],"extra":1,"resource_timestamps":{"a":[1]},"timings":{"t":1}}',
        "bad.json": '{"uuid":',
        "null.txt": "null",
        "list.txt": "[]",
        "number.json": '{"uuid":5,"status":"success"}',
        "word.json": '{"uuid":"u","status":"success","subtitle_timestamps":[{"text":1}]}',
        "urls.json": '{"uuid":"u","status":"success","article_urls":[1]}',
        "failed.txt": '{"uuid":"u","status":"failure","error":"e"}',
        "skipped.csv": "x",
    }
    for name, text in values.items():
        (tmp_path / name).write_text(text)
    rows = {r["file"].rsplit("/", 1)[1]: r for r in MS.json_dir_scan(spark, str(tmp_path)).collect()}
    assert set(rows) == set(values) - {"skipped.csv"}
    ok = rows["ok.json"]
    assert ok["file_error"] is None and ok["subtitle_timestamps"][0]["end"] == 0.5
    assert ok["resource_timestamps"] == '{"a":[1]}' and ok["timings"] == {"t": 1.0}
    cannot = "cannot decode message"
    assert {n: r["file_error"] for n, r in rows.items() if n != "ok.json"} == {
        "bad.json": cannot, "list.txt": cannot, "number.json": cannot, "word.json": cannot, "urls.json": cannot,
        "null.txt": "input status is not success: ", "failed.txt": "input status is not success: failure"}


def envelope(spark, values):
    rows = [("t", 0, i, "k", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, key string, value string")


def test_routes(spark):
    rows = envelope(spark, ['{"uuid":"a","status":"success"}', '{"uuid":"","status":"success"}', '{"uuid":"b","status":"failure"}', "x"])
    done, dead, retry = SM.route(rows, SM.CREATION)
    assert [r["uuid"] for r in done.collect()] == ["a"] and retry.isEmpty()
    assert {r["offset"]: r["reject_reason"] for r in dead.collect()} == {
        1: "missing uuid", 2: "status: failure", 3: "cannot decode message"}
    done, dead, _ = SM.route(rows, SM.RUNS)
    assert sorted(r["uuid"] for r in done.collect()) == ["a", "b"] and dead.count() == 2


def test_intake(spark):
    df = spark.createDataFrame([('{"article":{"id":"i","title":"t","nope":1}}',), ("{}",), ("[",)], "value string")
    got = [(r["id"], r["reject_reason"]) for r in MS.article_intake(df).collect()]
    assert got == [("i", None), (None, "article is required"), (None, "invalid JSON")]


def test_stream_equals_batch(spark, tmp_path):
    good = [f'{{"uuid":"u{i}","status":"success"}}' for i in range(6)] + ["oops"]
    rows = envelope(spark, good)
    for part in range(2):
        rows.where(F.col("offset").between(part * 4, part * 4 + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = MS.file_message_source(spark, str(tmp_path / "in"), 1)
    out = str(tmp_path / "out")
    SM.message_stream(stream, SM.CREATION, out, str(tmp_path / "c")).awaitTermination()
    done, dead, _ = SM.route(rows, SM.CREATION)
    assert sorted(r["uuid"] for r in SM.routed(spark, out, "done").collect()) == sorted(r["uuid"] for r in done.collect())
    assert SM.routed(spark, out, "dead").count() == dead.count() == 1


def test_retry_is_taken_up(spark, tmp_path):
    """What fails in one batch is tried again with the next, and done once it succeeds."""
    rows = envelope(spark, [f'{{"uuid":"u{i}","status":"success"}}' for i in range(6)])
    for part in range(3):
        rows.where(F.col("offset").between(part * 2, part * 2 + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tried = spark.sparkContext.accumulator(0)

    def busy_at_first(good):
        tried.add(1)
        return good.withColumn("process_error", F.when(F.lit(tried.value == 1), "busy"))

    handler = SM.MessageHandler(lambda _: F.lit(None).cast("string"), busy_at_first)
    stream, out = MS.file_message_source(spark, str(tmp_path / "in"), 1), str(tmp_path / "out")
    SM.message_stream(stream, handler, out, str(tmp_path / "c"), take_up=True).awaitTermination()
    written = spark.read.parquet(out).groupBy("batch", "route").count().collect()
    assert sorted(map(tuple, written)) == [(0, "retry", 2), (1, "done", 4), (2, "done", 2)]
    assert SM.routed(spark, out, "done").count() == 6


def test_stories(spark):
    none = spark.createDataFrame([], STORY_SEGMENT)
    new = spark.createDataFrame([(0, "a", "T", "one")], "seq long, id string, title string, body string")
    items = [(5, "a", "", "late"), (3, "a", "", "early"), (4, "gone", "", "lost")]
    similar = spark.createDataFrame(items, "seq long, matching_id string, title string, body string")
    segments, missing = SY.story_append(SY.story_create(none, new), similar)
    assert [r["id"] for r in missing.collect()] == ["gone"]
    assert SY.append_concat(segments).first()["body"] == "T\none\n--\nearly\n--\nlate"
    cut_up = ordered_parts(segments, ["id"], ["run", "seq"], F.col("text"), "texts", part_bytes=8, span=4)
    assert {r["part"]: r["texts"] for r in cut_up.collect()} == {0: ["T\none", "early"], 1: ["late"]}
    later = spark.createDataFrame([(0, "a", "", "second run"), (20_000, "a", "", "its end")], similar.schema)
    segments, _ = SY.story_append(segments, later, run=1)
    assert [tuple(r) for r in SY.append_concat(segments).collect()] == [
        ("a", 0, "T\none\n--\nearly\n--\nlate\n--\nsecond run\n--\nits end")
    ]
    again = SY.story_create(segments, spark.createDataFrame([(9, "a", "N", "x")], new.schema), run=2)
    assert SY.append_concat(again).first()["body"] == "N\nx"


def test_spread_join_is_a_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)], "seq long, key string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, big.join(small, ["key"], how).select("seq", "key").collect()))
        split = sorted(map(tuple, spread_join(big, small, ["key"], how, "seq", 200, 10).select("seq", "key").collect()))
        assert plain == split


def test_extract_errors(spark):
    pages = spark.createDataFrame([("u", "<body><p>hi</p></body>")], "url string, html string")
    rows = [(0, "u", "", "i"), (1, "", "a", ""), (2, "x", "a", "")]
    df = spark.createDataFrame(rows, "seq long, url string, author string, image_url string")
    for c in ("full_content", "full_content_text", "excerpt", "extraction_error"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = {r["seq"]: r for r in page_extract(df, pages).collect()}
    assert got[0]["full_content_text"] == got[0]["excerpt"] == "hi" and got[0]["extraction_error"] is None
    assert got[1]["extraction_error"] == "article URL is empty" and got[1]["author"] == "a"
    assert got[2]["extraction_error"] == "page not found"


def page(words):
    return f"<html><body><article><p>{words}</p></article></body></html>"


def test_whole_run(spark):
    items = "".join(
        f"<item><title>t{i}</title><link>http://a/{i}</link></item>" for i in range(4)
    ) + "<item><title>t9</title><link>http://a/9</link></item>"
    feeds = spark.createDataFrame(
        [("f1", f"<rss><channel>{items}</channel></rss>"), ("f2", "broken")], "feed string, xml string")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [words, words, "quite other words stand here and there", "third text entirely unlike the rest"]
    pages = spark.createDataFrame([(f"http://a/{i}", page(t)) for i, t in enumerate(texts)], "url string, html string")
    none = spark.createDataFrame([], STORY_SEGMENT)
    run = ingest(feeds, pages, State.empty(spark), none, NOW, TermEmbedder(0.95), "r", prefix="s")
    counts = run.counts.first()
    assert (counts["new_count"], counts["duplicate_count"], counts["failed_count"], counts["error_count"]) == (3, 1, 1, 0)
    assert run.feed_errors.count() == 1
    ref = run.requests.first()
    assert ref["n_urls"] == 3 and ref["object_ref"].startswith("s/")
    assert run.urls.first()["article_urls"] == ["http://a/0", "http://a/2", "http://a/3"]
    bodies = sorted(r["body"] for r in SY.append_concat(run.stories).collect())
    assert f"t0\n{words}\n--\n{words}" in bodies and len(bodies) == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch run again reads the same past; a batch that never committed is not seen."""
    articles = base.document_articles(spark, "/root/testdata/sf0.001")
    half = articles.where("seq < 100")
    embedder = TermEmbedder(0.95)
    folder = StateFolder(spark, str(tmp_path / "state"))
    results = str(tmp_path / "results")
    run_batch(folder, half, 0, NOW, embedder, results)
    state = lambda v: sorted((r["id"], str(r["last_update"])) for r in folder.load(v)[0].store.collect())
    first = state(1)
    run_batch(folder, half, 0, NOW, embedder, results)
    assert state(1) == first
    rest = run_batch(folder, articles.where("seq >= 100"), 1, NOW, embedder, results)
    split = spark.read.parquet(results).select("seq", "status", "matching_id")
    assert split.count() == articles.count() and rest.results.count() == articles.count() - 100
    # Files without a commit row, as left by a batch that died.
    folder._write(folder.load(2)[0].store.limit(3), "adds", 2)
    before = state(3)
    assert before == state(2)
    folder.fold(NOW)
    assert state(2) == state(3) == before and state(1) == first
    # A later start of the stream knows the model and goes on from the snapshot.
    more = articles.where("seq < 20").withColumn("id", F.concat(F.lit("again"), "id"))
    seen = run_batch(folder, more, 2, NOW, TermEmbedder(0.95), results).results
    assert seen.where("is_exact_duplicate").count() == seen.count() == 20
    assert [r[0] for r in state(3)] == [r[0] for r in before]
    folder.reset()
    assert folder.load(3)[0].store.isEmpty() and state(2) == before
    after = run_batch(folder, half, 3, NOW, TermEmbedder(0.95), results)
    assert after.results.where("status = 'new'").count() == len(first) == len(state(4))
