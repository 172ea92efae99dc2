"""Copies of all tables, targets, scoped reconciliation, slugs, sinks that are read back."""

from __future__ import annotations

import json
import random

import pytest

from pyspark.sql import functions as F

from oathmill.functions import names
from oathmill.operators import entity, ingest
from oathmill.plans import analytics, jobs, model
from oathmill.plans.commits import Log
from oathmill.sources import files, html_tables


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_orphans_go_down_the_chain_and_copies_repeat(spark):
    empty = {n: spark.createDataFrame([], model.schema(n)) for n in model.SCHEMAS}
    make = lambda n, rows: empty[n].unionByName(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {'string' if isinstance(v, str) else 'int'}" for c, v in rows[0].items())), allowMissingColumns=True)
    src = {
        "states": make("states", [{"id": 1, "name": "s"}]), "elections": make("elections", [{"id": 1, "state_id": 1}, {"id": 2, "state_id": 9}]), "politicians": make("politicians", [{"id": 1, "name": "new"}, {"id": 5, "name": "b"}]),
        "election_appearances": make("election_appearances", [{"id": 1, "election_id": 1, "politician_id": 1}, {"id": 2, "election_id": 2, "politician_id": 1}, {"id": 3, "election_id": 1, "politician_id": 8}]),
        "assets": make("assets", [{"id": 1, "appearance_id": 1}, {"id": 2, "appearance_id": 2}, {"id": 3, "appearance_id": 3}, {"id": 4, "appearance_id": 1}])}
    dst = empty | {"politicians": make("politicians", [{"id": 1, "name": "old"}])}
    after, lost, following = ingest.bulk_copy(src, dst)
    ids = lambda t: {n: sorted(r["id"] for r in f.collect()) for n, f in t.items() if f.count()}
    assert ids(after) == {"states": [1], "elections": [1], "politicians": [1, 5], "election_appearances": [1], "assets": [1, 4]}
    assert ids(lost) == {"elections": [2], "election_appearances": [2, 3], "assets": [2, 3]}
    assert {n: f.first()["next_id"] for n, f in following.items()} == {"states": 2, "parties": 1, "politicians": 6, "constituencies": 1, "elections": 2, "election_appearances": 2, "assets": 5, "liabilities": 1, "criminal_cases": 1}
    assert {r["id"]: r["name"] for r in after["politicians"].collect()} == {1: "old", 5: "b"}
    again, lost, _ = ingest.bulk_copy(src, after)
    assert ids(again) == ids(after)
    fresh, _, _ = ingest.bulk_copy(src, after, reset=True)
    assert {r["id"]: r["name"] for r in fresh["politicians"].collect()} == {1: "new", 5: "b"}


def test_order_of_tables_and_circles():
    order = ingest.dependency_order(ingest.REFERENCES)
    assert len(order) == 9 and all(order.index(p) < order.index(t) for t, refs in ingest.REFERENCES.items() for p in refs.values())
    with pytest.raises(ValueError, match="circle"):
        ingest.dependency_order({"a": {"x": "b"}, "b": {"x": "a"}})


def test_people_of_one_name_in_two_states_stay_apart(spark):
    recorded = spark.createDataFrame([(1, "Asha Rao", 2020, "Goa", 10, 0), (2, "asha  rao", 2020, "Jammu and Kashmir", 20, 0), (3, "Asha Rao", 2015, "Goa", 30, 0), (4, "ASHA RAO", 2020, "Goa", 40, 0), (5, "  ", 2020, "Goa", 50, 0)],
                                     "id int, name string, year int, state string, assets long, cases long")
    read = spark.createDataFrame([("a", "ASHA RAO", 2020, "goa", 10, 0), ("b", "Asha Rao", 2020, "Jammu Kashmir", 20, 0), ("c", "Asha Rao", 2019, "Goa", 1, 0), ("d", "", 2020, "Goa", 50, 0), ("e", "Asha Rao", 2020, None, 1, 0), ("f", "Asha Rao", 2020, "Delhi", 1, 0)],
                                 "doc string, name string, year int, state string, read_assets long, read_cases long")
    got = {r["doc"]: (r["id"], r["status"]) for r in entity.reconcile_scoped(read, recorded).collect()}
    assert got == {"a": (1, "MATCH"), "b": (2, "MATCH"), "c": (None, "NO_DB_ROW"), "d": (None, "NO_DB_ROW"), "e": (None, "NO_DB_ROW"), "f": (None, "NO_DB_ROW")}


@pytest.mark.parametrize(("text", "slug"), [
    ("Crème Brûlée", "creme-brulee"), ("été", "ete"), ("ﬁle Œuvre Straße Łódź", "file-oeuvre-strasse-lodz"), ("राम सिंह", "raam-sinh"), ("ਪੰਜਾਬ", "pnjaab"), ("Щука Юлия", "shchuka-iuliia"),
    ("a,b 1,000,000", "a-b-1000000"), ("--Plain  ASCII_9--", "plain-ascii-9"), ("", ""), (None, None), ("漢字", ""), ("ẤÇ\U0001F600x", "ac-x")])
def test_slugs(spark, text, slug):
    assert spark.createDataFrame([(text,)], "t string").select(names.slugify(F.col("t"))).first()[0] == slug


def test_numbers_in_order_of_names(spark):
    rng = random.Random(1)
    keys = list({f"{rng.choice(['SAME BEGINNING ', 'X', ''])}{rng.randrange(10**6)}" for _ in range(500)})
    got = entity.in_order(spark.createDataFrame([(k,) for k in keys], "key string").repartition(7), "key", "seq").collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["seq"])] == sorted(keys) and sorted(r["seq"] for r in got) == list(range(1, len(keys) + 1))


def test_near_names_at_any_size(spark):
    rows = spark.createDataFrame([("GURDASPUR", 1), ("Gurdas", 2), ("BATALA", 3), ("", 4), (None, 5), ("GURDASPUR", 1)], "constituency string, n int")
    seats = spark.createDataFrame([("gurdaspur city",), ("BATAL",), (None,)], "seat string")
    assert rows_of(html_tables.near_names(rows, seats).select("n")) == [(1,), (1,), (2,), (3,), (4,)]


def test_lookup_by_candidate_id_comes_before_the_number(spark):
    fact = spark.createDataFrame([(1, "A", "a", 7), (7, "B", "b", 1), (9, "C", "C-slug", None)], "politician_id long, name string, slug string, candidate_id int")
    keys = spark.createDataFrame([("7",), ("9",), ("c-SLUG",), ("b",), ("none",)], "key string")
    assert {r["key"]: (r["way"], r["politician_id"]) for r in analytics.lookup(fact, keys).collect()} == {"7": (2, 1), "9": (3, 9), "c-SLUG": (4, 9), "b": (1, 7)}


def test_an_election_without_winners_empties_current(spark):
    tables = {n: spark.createDataFrame([], model.schema(n)) for n in model.SCHEMAS}
    tables["states"] = spark.createDataFrame([(1, "S", None)], model.schema("states"))
    tables["elections"] = spark.createDataFrame([(1, 2020, "Assembly", 1, "e"), (2, 2025, "Assembly", 1, "f"), (3, 2030, "LokSabha", 1, "g")], model.schema("elections"))
    tables["election_appearances"] = spark.createDataFrame([(1, 2, 1, *[None] * 5, True, *[None] * 10)], model.schema("election_appearances"))
    fact, held = model.from_tables(tables), model.elections(tables)
    assert analytics.latest(fact, "Assembly", "current").count() == 1
    assert analytics.latest(fact, "Assembly", "current", elections=held).count() == 0
    assert analytics.hero_kpis(fact, "Assembly", "current", "S", held).first()["count"] == 0
    assert analytics.latest(fact, "Assembly", "current", elections=held.where("year < 2025")).count() == 1


def _listing(*rows):
    cells = lambda i, name, seat: f'<tr><td>1</td><td><a href="/x/candidate.php?candidate_id={i}">{name}</a></td><td>{seat}</td><td>P</td><td>2</td><td>Graduate</td><td>Rs 1,00,000</td><td>Rs 5</td></tr>'
    return "<table><tr><th>Candidate</th><th>Constituency</th></tr>" + "".join(cells(*r) for r in rows) + "</table>"


def test_targets_load_enrich_and_resume(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    pages = spark.createDataFrame([("Goa2022", 1, _listing((1, "Ana", "PANAJI"), (2, "Ben", "PANAJI"))), ("Delhi2025", 1, _listing((3, "Dee", "ROHINI")))], "slug string, page int, html string")
    winners = spark.createDataFrame([("Goa2022", 1, _listing((1, "Ana", "PANAJI")))], "slug string, page int, html string")
    jobs.run_target(log, "goa", winners)
    assert rows_of(log.read("appearances", jobs.FACTS).select("candidate_id", "won")) == [(1, True)]
    jobs.run_target(log, "goa_all", pages, winners)
    once = rows_of(log.read("appearances", jobs.FACTS).select("election", "candidate_id", "won", "assets"))
    assert once == [("Goa2022", 1, True, 100000), ("Goa2022", 2, False, 100000)]
    jobs.run_target(log, "goa_all", pages, winners)
    assert rows_of(log.read("appearances", jobs.FACTS).select("election", "candidate_id", "won", "assets")) == once
    own = "<title>Ana</title><p>Self Age: {}</p><h3>Movable Assets</h3><table><tr><td>i</td><td>Bank deposits</td><td>Rs {}</td></tr></table><table><tr><th>IPC</th></tr><tr><td>IPC 420</td><td>A long tale about a well in town</td></tr></table>"
    own = spark.createDataFrame([("Goa2022", 1, own.format(50, 700)), ("Goa2022", 2, own.format(40, 900)), ("Delhi2025", 3, own.format(30, 100))], "election string, candidate_id int, html string")
    jobs.run_target(log, "goa_detail", own)
    state = lambda: (rows_of(log.read("enriched", jobs.ENRICHED).select("appearance_id", "age")), rows_of(log.read("assets", jobs.ASSETS).select("appearance_id", "value_inr")), log.read("cases", jobs.CASES).count())
    assert state() == ([("Goa2022/1", 50)], [("Goa2022/1", 700)], 1)
    newer = own.withColumn("html", F.replace("html", F.lit("Rs 700"), F.lit("Rs 800")))
    jobs.run_target(log, "goa_detail_all", newer)  # what is enriched already stays
    assert state() == ([("Goa2022/1", 50), ("Goa2022/2", 40)], [("Goa2022/1", 700), ("Goa2022/2", 900)], 2)
    jobs.run_target(log, "goa_detail_all", newer, force=True)
    assert state()[1:] == ([("Goa2022/1", 800), ("Goa2022/2", 900)], 2)


def test_members_of_parliament_have_always_won(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    pages = spark.createDataFrame([("ls2024", 1, _listing((1, "Ana", "AMRITSAR"), (2, "Ben", "Mumbai North")))], "slug string, page int, html string")
    jobs.run_target(log, "punjab_ls", pages)
    assert rows_of(log.read("appearances", jobs.FACTS).select("candidate_id", "won")) == [(1, True)]


def test_names_of_targets():
    assert jobs.parse_target("goa_detail_all") == ("goa", "_detail_all") and jobs.parse_target("all") == ("all", "") and jobs.parse_target("punjab_ls") == ("punjab", "_ls")
    for name in ("goa_ls", "atlantis", "", "_all", "goa_details"):
        with pytest.raises(ValueError, match="unknown target"):
            jobs.parse_target(name)


def test_page_documents_with_broken_files(spark, tmp_path):
    good = {"source_pdf": "a.pdf", "page_count": 1, "pages": [{"page": 1, "method": "text", "text": "x\ny"}], "stats": {"pages_easyocr": 2}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text('{"source_pdf": "b.pdf", "pages": [')
    (tmp_path / "_manifest.json").write_text(json.dumps(good))
    got = {r["source_pdf"]: r for r in files.page_docs(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.pdf", None} and got["a.pdf"]["pages"][0]["text"] == "x\ny" and got["a.pdf"]["stats"]["pages_easyocr"] == 2 and "b.pdf" in got[None]["_corrupt"]
    report = entity.qc_report(files.page_docs(spark, str(tmp_path)).where("source_pdf is not null"))
    assert report.first()["status"] == "EMPTY"


def test_rosters_and_reports_read_back(spark, tmp_path):
    roster = entity.package(spark.createDataFrame([("in/A_B__1.pdf", 5), ("in/A_B__2.pdf", 9), ("in/C__3.pdf", 1)], "path string, size long"))
    files.write_csv(roster.withColumn("tags", F.array(F.lit("x"), F.lit("y, z"))), str(tmp_path / "roster"))
    back = {r["key"]: (r["canonical"], r["seq"], r["others"], r["tags"]) for r in spark.read.option("header", True).csv(str(tmp_path / "roster")).collect()}
    assert back == {"A_B": ("in/A_B__2.pdf", "1", "1", "x; y, z"), "C": ("in/C__3.pdf", "2", None, "x; y, z")}
    files.write_json(roster, str(tmp_path / "json"))
    assert rows_of(spark.read.schema(roster.schema).json(str(tmp_path / "json"))) == rows_of(roster)


def test_geojson_names(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"AC_NAME": "Goa", "n": 1}}, {"properties": {}}, {"properties": {"AC_NAME": "É"}}]}))
    (tmp_path / "b.geojson").write_text('{"type": "Point"}')
    (tmp_path / "c.geojson").write_text("broken")
    assert sorted(str(r["name"]) for r in files.geojson_names(spark, str(tmp_path), "AC_NAME").collect()) == ["Goa", "None", "É"]
