"""Stories kept as a log between batches, and pages of a store by rank."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import membership as M
from tidewire.operators import stories as SY
from tidewire.operators.embedders import TermEmbedder
from tidewire.operators.exact import exact_match
from tidewire.operators.store import PageIndex
from tidewire.plans.dedup import process
from tidewire.plans.state import State
from tidewire.schemas import ARTICLE, STORY_SEGMENT
from tidewire.streaming import state as streaming_state
from tidewire.streaming.state import StateFolder, run_batch

NOW = datetime(2024, 1, 31)


def articles(spark, first, count):
    """Texts of ten matters, each told again and again with small changes."""
    rows = []
    for i in range(first, first + count):
        matter = i % 10
        words = " ".join(f"matter{matter}word{k}" for k in range(40)) + f" extra{i}"
        rows.append((i, f"id{i:05d}", f"title {i}", f"https://e.example.org/{i}", words))
    frame = spark.createDataFrame(rows, "seq long, id string, title string, url string, full_content_text string")
    for field in ARTICLE.split(", "):
        name, kind = field.split(" ")
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


def bodies(segments):
    got = SY.append_concat(segments).collect()
    assert len({r["id"] for r in got}) == len(got)
    return {r["id"]: r["body"] for r in got}


def test_stories_of_three_batches(spark, tmp_path):
    """A batch that is run again, a new folder object before each, and a fold on the way change nothing."""
    parts = [articles(spark, first, 20) for first in (0, 20, 40)]
    model = TermEmbedder(0.9)
    segments, state = spark.createDataFrame([], STORY_SEGMENT), State.empty(spark)
    for v, part in enumerate(parts):
        out = process(part, state, NOW + timedelta(hours=v), model)
        segments, _ = SY.stories_after(segments, part, out.results, run=v)
        state = out.state
    want = bodies(segments)
    assert len(want) == 10 and all(b.count(SY.SEGMENT_MARK) == 5 for b in want.values())
    root, results = str(tmp_path / "state"), str(tmp_path / "results")
    for v, part in enumerate(parts):
        for _ in range(2 if v == 1 else 1):
            folder = StateFolder(spark, root)
            run_batch(folder, part, v, NOW + timedelta(hours=v), TermEmbedder(0.9), results, stories=True)
        if v == 1:
            folder.fold(NOW + timedelta(hours=v))
    assert bodies(StateFolder(spark, root).stories()) == want
    StateFolder(spark, root).reset()
    assert StateFolder(spark, root).stories().count() == 0


def test_a_story_that_starts_anew_replaces_its_past(spark):
    log = [
        ("a", 0, 0, "t", "old", True), ("a", 0, 3, "t", "more", False), ("b", 0, 1, "t", "kept", True),
        ("a", 2, 7, "t", "new", True), ("a", 2, 9, "t", "next", False), ("b", 1, 5, "t", "again", False),
        ("c", 1, 6, "t", "of no story", False),
    ]
    frame = spark.createDataFrame(log, f"{STORY_SEGMENT}, starts boolean")
    for floor in (None, 1):
        got = bodies(SY.log_segments(frame, len(log), floor))
        assert got == {"a": "new\n--\nnext", "b": "kept\n--\nagain"}


@pytest.mark.parametrize("range_rows", [7, 50, 1000])
def test_pages_by_rank(spark, range_rows):
    rng = random.Random(2)
    ids = [rng.randrange(10**6) for _ in range(180)] + [5] * 20
    store = spark.createDataFrame([(f"{i:07d}", i) for i in ids], "id string, n long")
    pages = PageIndex(store, range_rows)
    want = sorted(ids)
    for offset in (0, 1, 49, 150, 190, 199, 200, 500):
        for limit in (1, 10, 300):
            got = [r["n"] for r in pages.page(limit, offset).collect()]
            assert got == want[offset : offset + limit]
    assert PageIndex(store.limit(0), range_rows).page(10, 0).count() == 0


def test_a_page_reads_its_range_alone(spark):
    store = spark.range(10_000).withColumn("text", F.repeat(F.lit("x"), 50))
    page = PageIndex(store, 500).page(10, 7_000)
    assert len(page.inputFiles()) >= 1
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_filters_let_few_new_keys_pass(spark):
    keys = spark.range(6000).select(F.lit("url").alias("kind"), F.concat(F.lit("u"), "id").alias("value"))
    old, new = keys.where("substring(value, 2) < 3000"), keys.where("substring(value, 2) >= 3000")
    parts = [old.where(f"substring(value, 2) % 3 = {i}") for i in range(2)] + [old.where("substring(value, 2) % 3 = 2")]
    filters = [M.build_filter(part, n, i) for i, (part, n) in enumerate(zip(parts, (1000, 1000, 50_000)))]
    all_filters = filters[0].unionByName(filters[1]).unionByName(filters[2]).cache()
    assert len({r["size"] for r in all_filters.collect()}) == 2
    passed = M.may_hold(keys, all_filters)
    assert passed.join(old, ["kind", "value"], "left_semi").count() == 3000
    assert passed.join(new, ["kind", "value"], "left_semi").count() < 60
    # Another kind of key is another key.
    assert M.may_hold(old.withColumn("kind", F.lit("title")), all_filters).count() < 60
    assert M.may_hold(keys, all_filters.limit(0)).count() == 0 == M.build_filter(keys.limit(0), 0).count()


def test_filtered_match_is_exact(spark):
    rows = [(i, f"u{i % 50}" if i % 3 else "", f"t{i}") for i in range(400)] + [(400, None, None)]
    articles = spark.createDataFrame(rows, "seq long, url string, title string")
    seen = spark.createDataFrame(
        [("url", f"u{i}") for i in range(0, 50, 7)] + [("title", "u1"), ("title", "t9"), ("url", "")] + [("url", f"x{i}") for i in range(900)],
        "kind string, value string",
    )
    filters = M.build_filter(seen, 912)
    want = sorted(r["seq"] for r in exact_match(articles, seen).collect())
    assert sorted(r["seq"] for r in M.filtered_match(articles, seen, filters).collect()) == want and want
    none = articles.where("title = 't5'")
    assert M.filtered_match(none, seen.limit(0), filters.limit(0)).count() == 0


def test_batches_broadcast_small_tables_only(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []

    def process(*_, **__):
        seen.append(spark.conf.get(key))
        raise LookupError

    monkeypatch.setattr(streaming_state, "process", process)
    before = spark.conf.get(key)
    folder = StateFolder(spark, str(tmp_path / "state"))
    with pytest.raises(LookupError):
        streaming_state.run_batch(folder, spark.range(1), 0, None, None, str(tmp_path / "results"))
    assert seen == ["256k"] and spark.conf.get(key) == before
