"""The engine's methods, and saved crawls as data sources."""

from __future__ import annotations

import json

import pytest

from oathmill.engine import Engine
from oathmill.plans import analytics, model
from oathmill.sources import cards, files, readers


def rows_of(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def test_engine_fills_what_functions_ask_for(spark, sf, tmp_path):
    tables = model.normalised(spark, sf)
    for name in ("election_appearances", "elections", "politicians", "states", "parties", "constituencies", "assets"):
        tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(1, 4, "IPC 420"), (2, 4, None)], "id int, appearance_id int, ipc_sections string").write.parquet(str(tmp_path / "criminal_cases.parquet"))
    engine = Engine.open(spark, str(tmp_path))
    assert engine.hero_kpis(scope="current").first()["count"] == 0  # the newest election has no winner
    assert Engine.of_driver_tables(spark, sf).hero_kpis(scope="current").first()["count"] > 0
    assert engine.asset_trend(top=2).count() > 0 and engine.home(state="NATION_7").count() > 0
    key = spark.createDataFrame([("500007",)], "key string")
    shown = engine.profile(key).collect()
    assert shown and {r["politician_id"] for r in shown} == {7}
    assert rows_of(engine.lookup(key)) == rows_of(analytics.lookup(engine.fact, key))
    for name in ("map_by_constituency", "tile_intensity", "rank_labels", "wealth", "nothing", "_card"):
        with pytest.raises(AttributeError):
            getattr(engine, name)


def _plan(frame):
    return frame._jdf.queryExecution().explainString(frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_manifest_source(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "a.jsonl").write_text('{"profile_url": "u1", "status": "Accepted", "download_succeeded": true, "extra": 1}\n\nbroken\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"profile_url": "u1", "status": "Rejected"}\n{"profile_url": "u2", "status": "Accepted", "affidavit_id": 7}\n')
    (tmp_path / "_c.jsonl").write_text("hidden")
    (tmp_path / "d.jsonl").write_bytes(b"\xff\xfe")
    rows = spark.read.format("manifest").load(str(tmp_path))
    got = {(r["file"], r["line"]): r for r in rows.collect()}
    assert set(got) == {("a.jsonl", 0), ("a.jsonl", 2), ("a.jsonl", 3), ("b.jsonl", 0), ("b.jsonl", 1), ("d.jsonl", None)}
    assert got["a.jsonl", 0]["download_succeeded"] is True and got["b.jsonl", 1]["affidavit_id"] == "7" and got["a.jsonl", 0]["error"] is None
    assert got["a.jsonl", 2]["error"].startswith("line 2") and got["a.jsonl", 3]["error"] == "line 3: no object" and "Unicode" in got["d.jsonl", None]["error"]
    load = lambda: spark.read.format("manifest").option("push", True).load(str(tmp_path))
    chosen = load().where("status = 'Accepted' and file = 'b.jsonl'")
    assert [r["profile_url"] for r in chosen.collect()] == ["u2"]
    plan = _plan(chosen)
    pushed = [line for line in plan.split("\n") if "Pushed" in line]
    assert pushed and "Accepted" in pushed[0] and "b.jsonl" in pushed[0], plan
    assert load().where("line = 1 or status = 'none'").count() == 1  # what is not pushed is left to Spark
    assert load().where("status = 'Accepted' and status = 'Rejected'").count() == 0
    one = spark.read.format("manifest").load(str(tmp_path))
    assert one.where("status = 'Accepted'").unionByName(one.where("status = 'Rejected'")).unionByName(one.where("error is not null")).count() == 6


def test_card_and_page_text_sources(spark, tmp_path):
    readers.register(spark)
    page = '<ul><li class="card"><p>Name: Asha</p><p>Status: accepted</p><a href="/show-profile/1">v</a></li><li><h3>Ravi</h3><a href="/show-profile/2">v</a></li></ul>'
    (tmp_path / "p1.html").write_text(page)
    (tmp_path / "p2.html").write_text("<p>nothing</p>")
    found = spark.read.format("cards").load(str(tmp_path))
    assert [(r["file"], r["pos"], r["name"], r["status"]) for r in found.orderBy("pos").collect()] == [("p1.html", 0, "Asha", "Accepted"), ("p1.html", 1, "Ravi", "")]
    assert found.where("profile_url = '/show-profile/2'").count() == 1
    assert [c["profile_url"] for c in cards.cards(page)] == ["/show-profile/1", "/show-profile/2"]
    good = {"source_pdf": "a.pdf", "pages": [{"page": 1, "method": "text", "text": "x"}, {"page": 2, "method": "ocr", "text": None}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"source_pdf": "b.pdf"')
    (tmp_path / "c.json").write_text("[]")
    rows = spark.read.format("page_text").load(str(tmp_path))
    got = sorted((r["file"], r["page"] or 0, r["text"], (r["error"] or "").split(":")[0]) for r in rows.collect())
    assert got == [("a.json", 1, "x", ""), ("a.json", 2, None, ""), ("b.json", 0, None, "JSONDecodeError"), ("c.json", 0, None, "ValueError")]
    assert rows.where("method = 'ocr'").select("page").first()[0] == 2
    docs = files.page_docs(spark, str(tmp_path / "a.json"))
    assert docs.first()["source_pdf"] == "a.pdf"


def test_partitions_are_planned_by_size(spark, tmp_path, monkeypatch):
    readers.register(spark)
    for i in range(6):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps({"profile_url": f"u{i}"}))
    monkeypatch.setattr(readers, "PARTITION_BYTES", 50)
    reader = readers.Manifest({"path": str(tmp_path)}).reader(spark.createDataFrame([], readers.Manifest({}).schema()).schema)
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2]
    assert spark.read.format("manifest").load(str(tmp_path)).count() == 6
