"""Edge tables of the scalar rules."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import captions as C
from tidewire.functions import html as H
from tidewire.functions import text as X
from tidewire.functions import times as T
from tidewire.operators import captions as CP
from tidewire.operators import filters as FL
from tidewire.operators.publish import upload_metadata


def run(spark, values, rule, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("c"))).collect()]


def test_sentence_end(spark):
    words = ["end.", "15.", "5.", ".", "4.5.", "a5.", "x!", "q?", "2.3", "é5.", " end. ", "a12.", "", "5!"]
    want = [True, False, False, True, True, True, True, True, False, True, True, False, False, True]
    assert run(spark, words, C.sentence_end) == want


def test_unicode_space(spark):
    assert run(spark, ["  a b \u0085\n", "　"], X.trim_space) == ["a b", ""]


def test_truncation(spark):
    values = ["x" * n for n in (0, 99, 100, 101)] + ["é" * 101]
    got = run(spark, values, X.truncate_ellipsis)
    assert [len(g) for g in got] == [0, 99, 100, 100, 100]
    assert got[3] == "x" * 97 + "..." and got[4] == "é" * 97 + "..."


def test_rfc3339(spark):
    good = ["2025-01-01T00:00:00Z", "2025-01-01T00:00:00.5Z", "2025-01-01T02:00:00+02:00", "2025-01-01T00:00:00,5Z"]
    bad = ["2025-01-01", "", "  ", "x", "2025-01-01 00:00:00", "2025-13-01T00:00:00Z", "2025-01-01T00:00:00Z\n"]
    at = datetime(2025, 1, 1)
    half = datetime(2025, 1, 1, 0, 0, 0, 500000)
    assert run(spark, good, T.parse_rfc3339) == [at, half, at, half]
    assert run(spark, bad, T.parse_rfc3339) == [None] * len(bad)


def test_stamp_order(spark):
    rows = [
        {"last_update": "bad", "last_retrieved_at": "2025-01-02T00:00:00Z", "added_at": "2025-01-03T00:00:00Z"},
        {"added_at": "2025-01-03T00:00:00Z"},
        {"last_update": ""},
        {},
    ]
    got = run(spark, rows, T.last_update_resolve, "map<string,string>")
    assert got == [datetime(2025, 1, 2), datetime(2025, 1, 3), None, None]


def test_feed_dates(spark):
    values = ["Mon, 02 Jan 2006 15:04:05 GMT", "2 Jan 2006 15:04:05 +0200", "Mon, 02 Jan 2006 15:04 EST", "soon", None,
              "02 Jan 06 15:04 GMT", "2006-01-02 15:04:05", "2006-01-02", "Monday, 02-Jan-06 15:04:05 GMT"]
    want = [datetime(2006, 1, 2, 15, 4, 5), datetime(2006, 1, 2, 13, 4, 5), datetime(2006, 1, 2, 20, 4), None, None,
            datetime(2006, 1, 2, 15, 4), datetime(2006, 1, 2, 15, 4, 5), datetime(2006, 1, 2), datetime(2006, 1, 2, 15, 4, 5)]
    assert run(spark, values, T.parse_feed_date) == want


def test_clip_times(spark):
    seconds = [0.0, 0.29, 59.999, 61.5, 3600.0, 3725.04]
    assert run(spark, seconds, T.fmt_ass_time, "double") == [
        "0:00:00.00", "0:00:00.28", "0:00:59.99", "0:01:01.50", "1:00:00.00", "1:02:05.03"]
    assert run(spark, seconds, T.fmt_srt_time, "double") == [
        "00:00:00,000", "00:00:00,290", "00:00:59,999", "00:01:01,500", "01:00:00,000", "01:02:05,039"]


def test_titles_of_pages(spark):
    pages = ["<title>a &amp;lt; b</title>", "<TITLE lang=x>\n two\nlines </TITLE>", "<title></title><title>2</title>",
             "<p>none</p>", "<title>&#8364;&#x41;&#xD800;&nbsp;</title>", "<!-- <title>old</title> --><title>new</title>",
             "<script>'<title>no</title>'</script><title>yes", "<title>caf&eacute; &amp;eacute; &nosuch; &#x10FFFF;</title>"]
    want = ["a &lt; b", "two\nlines", "2", None, "€A�", "new", "yes", "café &eacute; &nosuch; \U0010ffff"]
    assert run(spark, pages, H.html_title) == want


def test_main_text(spark):
    page = (
        "<html><body><nav>menu</nav><header>h</header><p>One<br>two &nbsp; x</p><script>var a='</p>';</script>"
        '<div class="ad">buy</div><!-- gone --><p>Three</p></body></html>'
    )
    assert run(spark, [page], lambda c: H.plain_text(H.main_content(c))) == ["One\ntwo x\nThree"]
    article = "<body>out<article class=a><p>in</p></article>out</body>"
    assert run(spark, [article], lambda c: H.plain_text(H.main_content(c))) == ["in"]


def test_images(spark):
    values = ["a<IMG src=x>b<img\n>c<image>", "  ", ""]
    assert run(spark, values, H.strip_images) == ["abc<image>", "  ", ""]


def test_error_envelope(spark):
    bodies = ['{"error":"E","message":"m"}', '{"error":"E"}', '{"message":"m"}', "{}", "x", "", '{"error":5,"message":"m"}', ' {"error":"E"}', None]
    assert run(spark, bodies, X.error_envelope) == ["E: m", "E", "m", None, None, None, None, None, None]


def test_ids(spark):
    df = spark.createDataFrame([("", "", "t"), ("", "", ""), (None, "g", "t"), ("l", "g", "t")], "l string, g string, t string")
    ids = [r[0] for r in df.select(X.feed_item_id(F.col("l"), F.col("g"), F.col("t"))).collect()]
    assert ids[1] == "" and len({*ids}) == 4 and all(len(i) == 16 for i in ids if i)


def test_tags_and_keys(spark):
    assert run(spark, [" a , ,b,", ",", "", None], X.parse_tags) == [["a", "b"]] + [["tech", "AI", "shorts"]] * 3
    assert run(spark, ["", "p", "p/"], lambda c: X.object_key(c, F.lit("i"))) == ["i", "p/i", "p/i"]
    assert run(spark, ["", "/p/", " p "], lambda c: X.export_key(c, F.lit("i"))) == [
        "articles/i.json", "p/articles/i.json", "p/articles/i.json"]


def test_upload_defaults(spark):
    df = spark.createDataFrame(
        [("/v/clip.one.mp4", " ", "", "s", "", ""), ("clip", "T", " d ", "", "a", "7")],
        "path string, title string, description string, source string, tags string, category_id string",
    )
    a, b = upload_metadata(df).collect()
    assert a["title"] == "clip.one" and a["description"].startswith("clip.one\n\nSource: s\n\nFollow")
    assert (b["title"], b["description"], b["category_id"]) == ("T", "d", "7")


def test_publish_description(spark):
    df = spark.createDataFrame([([], "s"), (None, "s"), (["a", "b"], "s"), ([], "")], "u array<string>, s string")
    got = [r[0] for r in df.select(X.publish_description(F.col("u"), F.col("s"))).collect()]
    assert got[0] == got[1] and got[0].startswith("🔗 Source: s\n\n📱")
    assert got[2].startswith("Sources:\na\nb\n\n📱") and got[3].startswith("📱")


def test_request_checks(spark):
    df = spark.createDataFrame(
        [("failure", "", "", []), ("success", "", "", []), ("success", "u", None, []), ("success", "u", "v", []),
         ("success", "u", "v", ["w"]), (None, "u", "v", ["w"])],
        "s string, u string, v string, w array<string>",
    )
    got = [r[0] for r in df.select(FL.request_reject(*[F.col(c) for c in "suvw"])).collect()]
    m = FL.REQUEST_MESSAGES
    assert got == [m["status"], m["uuid"], m["voiceover"], m["captions"], None, m["status"]]


def lines_one_by_one(words):
    """Caption lines told sequentially."""
    import re

    out, line = [], []
    for i, w in enumerate(words):
        line.append(w)
        ends = re.search(r"[.!?]$", w) and not re.search(r"(^|[0-9])[0-9][.]$", w)
        if ends or len(line) == 5 or i == len(words) - 1:
            out.append(line)
            line = []
    return out


def captions(spark, lists):
    rows = [(f"u{i}", [(w, k * 0.4, k * 0.4 + 0.35) for k, w in enumerate(ws)]) for i, ws in enumerate(lists)]
    return spark.createDataFrame(rows, "uuid string, subtitle_timestamps array<struct<text:string,start:double,end:double>>")


def test_caption_lines_match_walk(spark):
    rng = random.Random(5)
    words = ["a", "b.", "15.", "5.", "x!", "q?", "long", "4.5.", "."]
    lists = [["w"] * n for n in (1, 4, 5, 6, 11)] + [[rng.choice(words) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    lists.append([])
    messages = captions(spark, lists)
    got = {}
    for r in CP.caption_lines(messages).collect():
        got.setdefault(r["uuid"], {})[r["line"]] = r["text"]
    for i, ws in enumerate(lists):
        assert [t for _, t in sorted(got.get(f"u{i}", {}).items())] == [" ".join(x) for x in lines_one_by_one(ws)]
    durations = {r["uuid"]: r for r in CP.clip_durations(messages).collect()}
    assert durations["u65"]["duration"] is None and durations["u65"]["reject_reason"] == "no captions"
    assert durations["u0"]["duration"] == pytest.approx(0.85)


def test_caption_files(spark):
    messages = captions(spark, [["Hi", "you."], []])
    script = CP.ass_files(messages, "My clip").collect()
    assert len(script) == 1
    body = script[0]["script"]
    assert "Title: My clip\n" in body and body.endswith(
        "Dialogue: 0,0:00:00.00,0:00:00.40,Default,,0,0,0,,{\\c&H0000FFFF&}Hi{\\c&H00FFFFFF&} you.\n"
        "Dialogue: 0,0:00:00.40,0:00:00.75,Default,,0,0,0,,Hi {\\c&H0000FFFF&}you.{\\c&H00FFFFFF&}\n"
    )
    srt = CP.srt_files(messages).first()["script"]
    assert srt == "1\n00:00:00,000 --> 00:00:00,350\nHi\n\n2\n00:00:00,400 --> 00:00:00,750\nyou.\n\n"


def test_long_clip_is_capped(spark):
    rows = [("u", [("a", 500.0, 501.0)])]
    df = spark.createDataFrame(rows, "uuid string, subtitle_timestamps array<struct<text:string,start:double,end:double>>")
    assert CP.clip_durations(df).first()["duration"] == 180.0


def test_page_text_is_computed_once(spark):
    """No pattern of a page stands more than once in the plan, so it isn't searched again."""
    page = spark.createDataFrame([("<body>a &amp; b</body>",)], "html string")
    read = page.select(H.plain_text(H.main_content(F.col("html"))).alias("text"), H.html_title(F.col("html")).alias("title"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    once = ["(?is)<article(?:", "(?is)<main(?:", "(?is)<body(?:", "(?is)<aside(?:", "</?(?:address|"]
    assert [plan.count(pattern) for pattern in once] == [1] * len(once)
    assert read.first() == ("a & b", None)


def test_elements_made_by_a_removal_go_too(spark):
    pages = ["<body>a<fo<!-- x -->rm>b</form>c</body>", "<BODY><NAV>m</NAV>d</BODY>", None, ""]
    assert run(spark, pages, lambda c: H.plain_text(H.main_content(c))) == ["ac", "d", None, ""]
