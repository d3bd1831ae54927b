"""Inputs of one small file per row, written and listed by tasks."""

from __future__ import annotations

import os

from tidewire.registry import flows


def test_message_files_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(flows, "FILES_PER_TASK", 2)
    path = flows._message_files(spark, "/root/testdata/sf0.001")
    parts = {
        (folder[len(path) + 1], name.split("-")[1])
        for folder, _, names in os.walk(path)
        for name in names
        if name.startswith("part-")
    }
    assert all(len({p for k, p in parts if k == kind}) > 1 for kind in "tj")
    files = flows.MS.read_message_files(spark, path, nested=True)
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert files.count() == files.select("file").distinct().count() == turns.select("conv_id").distinct().count()
