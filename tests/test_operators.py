"""Loads, entity resolution and HTML on small synthetic data."""

from __future__ import annotations

import pytest

import json

from pyspark.sql import functions as F

from oathmill.operators import entity, ingest
from oathmill.plans import analytics, model
from oathmill.sources import cards, files, html_tables
from oathmill.streaming import landing

FACT = "appearance_id long, politician_id long, name string, slug string, state string, zone string, house string, year int, constituency string, party string, won boolean, assets long, cases long"


def fact(spark, rows):
    return spark.createDataFrame([(i, p, f"P{p}", f"p{p}", "S", "Z", h, y, "C", party, won, a, c) for i, p, h, y, party, won, a, c in rows], FACT)


def test_latest_keeps_ties_and_empty_current(spark):
    f = fact(spark, [(1, 1, "Assembly", 2000, "A", True, 5, 0), (2, 1, "LokSabha", 2000, "A", False, 7, 1), (3, 2, "Assembly", 2005, None, None, None, None)])
    assert {r["appearance_id"] for r in analytics.latest(f).collect()} == {1, 2, 3}
    assert analytics.latest(f, "Assembly", "current").count() == 0
    k = analytics.hero_kpis(f, scope="current").first()
    assert (k["count"], k["total_wealth_inr"], k["avg_cases"]) == (0, 0, 0.0)


def test_thresholds_and_switches(spark):
    f = fact(spark, [(1, 1, "Assembly", 2000, "A", True, 99_999, 0), (2, 1, "Assembly", 2005, None, True, 10_000_000, 0), (3, 1, "Assembly", 2010, "B", True, 10_000_000, 0), (4, 1, "Assembly", 2015, "A", True, 10_000_000, 0),
                     (5, 2, "Assembly", 2000, "A", True, 100_000, 0), (6, 2, "Assembly", 2005, "A", True, 200_000, 0)])
    assert [r["politician_id"] for r in analytics.wealth_multipliers(f).collect()] == [2]
    assert [r["politician_id"] for r in analytics.crorepati_newcomers(f).collect()] == [1]
    s = analytics.party_switchers(f).first()
    assert (s["switches"], s["journey"], s["n_parties"]) == (2, "A > B > A", 2)
    medians = {r["party"]: r["m"] for r in analytics.upper_median(f.where("party = 'A'"), ["party"], F.col("assets"), "m").collect()}
    assert medians == {"A": 200_000}


def test_median_of_all_is_the_upper_one(spark):
    for values in ([5], [1, 2], [1, 2, 3], [0, 0, 7, 7, 9, 10**12]):
        f = fact(spark, [(i, i, "Assembly", 2000, "A", True, v, 0) for i, v in enumerate(values)])
        assert analytics._median_of_all(f).first()["m"] == sorted(values)[len(values) // 2]


def test_wide_fact_from_tables(spark):
    t = {n: spark.createDataFrame([], model.schema(n)) for n in model.SCHEMAS}
    t["elections"] = spark.createDataFrame([(1, 2020, "Assembly", None, "e")], model.schema("elections"))
    t["election_appearances"] = spark.createDataFrame([(1, 2, 1, *[None] * 16)], model.schema("election_appearances"))
    r = model.from_tables(t).first()
    assert (r["year"], r["state"], r["party"], r["won"]) == (2020, None, None, None)


def test_upsert_is_idempotent_and_wins_stay(spark):
    old = spark.createDataFrame([("e", 1, True, 5)], "election string, candidate_id int, won boolean, assets long")
    new = spark.createDataFrame([("e", 1, False, 9, 1), ("e", 2, None, 4, 1), ("e", 2, True, 6, 2)], "election string, candidate_id int, won boolean, assets long, seq int")
    once = ingest.upsert_appearances(old, new)
    want = {("e", 1, True, 9), ("e", 2, True, 6)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in ingest.upsert_appearances(once, new).collect()}


def test_dimension_ids_are_dense(spark):
    dim = spark.createDataFrame([(7, "a")], "id int, short_name string")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "short_name string")
    rows = ingest.get_or_create(dim, new, ["short_name"]).collect()
    assert sorted(r["id"] for r in rows) == [7, 8, 9] and len({r["short_name"] for r in rows}) == 3


def test_slug_repair_finds_free_numbers(spark):
    rows = spark.createDataFrame([(1, "Sam", "sam"), (2, "Sam", "sam"), (3, "Sam", ""), (4, "x", "sam-2"), (5, "!!", None)], "id int, name string, slug string")
    got = {r["id"]: r["slug"] for r in ingest.repair_slugs(rows).collect()}
    assert got[1] == "sam" and got[4] == "sam-2" and {got[2], got[3]} == {"sam-3", "sam-4"} and got[5] == "politician-5"


def test_enrichment_fills_and_replaces(spark):
    a = spark.createDataFrame([(1, None, "", 0, 5, None)], "appearance_id int, age int, profession string, movable_assets_inr long, immovable_assets_inr long, serious_cases_count int")
    d = spark.createDataFrame([(1, 40, "Farmer", 10**13 + 1, 0, 2)], "appearance_id int, age int, profession string, movable_assets_inr long, immovable_assets_inr long, serious_cases_count int")
    assert tuple(ingest.enrich(a, d).first()) == (1, 40, "Farmer", 0, 5, 2)
    old = spark.createDataFrame([(1, 3), (2, 4)], "appearance_id int, value_inr long")
    new = spark.createDataFrame([(1, 0), (2, 9)], "appearance_id int, value_inr long")
    assert {tuple(r) for r in ingest.replace_children(old, new, "value_inr").collect()} == {(1, 3), (2, 9)}


RECORDS = [("SAMPLE_ONE__1001.pdf", 300, "IN-ZZ10000000000001X", "ALPHA PARTY", "SAMPLE ONE", ""), ("SAMPLE_ONE__1002.pdf", 500, "IN-ZZ10000000000001X", "ALPHA PARTY", "", ""), ("SAMPLE_ONE__1003.pdf", 100, "IN-ZZ20000000000002X", "ALPHA PARTY", "SAMPLE ONE", ""),
           ("scan-7.pdf", 200, "", "BETA PARTY", "", "SAMPLETOWN"), ("blank.pdf", 50, "", "", "", "")]


def test_filings_group_and_canonical(spark):
    r = spark.createDataFrame([(p, s, c, party, n, "", seat) for p, s, c, party, n, seat in RECORDS], "pdf_path string, file_size long, estamp_cert string, candidate_party string, candidate_name string, candidate_father string, candidate_constituency string")
    got = {x["canonical_pdf"]: x for x in entity.candidates(r).collect()}
    assert set(got) == {"SAMPLE_ONE__1003.pdf", "scan-7.pdf", "blank.pdf"} and got["blank.pdf"]["signature"].startswith("single_")
    assert [f["canonical_pdf"] for f in got["SAMPLE_ONE__1003.pdf"]["filings"]] == ["SAMPLE_ONE__1003.pdf", "SAMPLE_ONE__1002.pdf"]
    assert entity.drop_poisoned(r).count() == 4


def test_extracted_documents(spark):
    good = {"candidate": {"name": "x"}, "election": {"house": "Assembly"}, "criminal": {"pending_cases_count": 0}, "assets": {"movable": {"self": {"gross_total": 5}}}, "liabilities": {"grand_total": 0}, "abstract": {"movable_self": 5}, "provenance": {"source_pdf": "p"}}
    bad = good | {"election": {"house": "Moon"}, "criminal": {"pending_cases_count": -1}, "abstract": {"movable_self": 6}}
    missing = {k: v for k, v in good.items() if k != "assets"}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, json.dumps(missing)), (4, "{")], "doc int, json string")
    got = {r["doc"]: r["problems"] for r in entity.validate_extracted(rows).collect()}
    assert got[1] == "" and got[2] == "unknown house; negative criminal.pending_cases_count; totals differ" and "missing assets" in got[3] and "not json" in got[4]


DETAIL = """<html><title>Sample One(Alpha(AP)):Seat</title><body><h3>Punjab 2022</h3><p>Self Age: 111</p><p>Self Profession: Farmer Spouse Profession: x</p><b>3 Number of Serious IPC</b>
<p>Total Movable Assets Rs ,</p><p>Total Immovable Assets x Rs 5,000</p><table><tr><th>Serial</th><th>IPC Sections</th></tr><tr><td>1</td><td>IPC 420</td><td>A long enough description</td></tr></table>
<h3>Details of Movable Assets</h3><table><tr><td>Sr No</td><td>Description</td></tr><tr><td>i</td><td>Cash in hand</td><td>Rs 1,000</td><td>99999999999999</td></tr><tr><td></td><td>Gross Total Value</td><td>Rs 9</td></tr><tr><td>(a)</td><td>%s</td><td>2,000</td></tr></table></body></html>""" % ("y" * 121)


def test_detail_pages(spark):
    pages = spark.createDataFrame([("e", 1, DETAIL), ("e", 2, None)], "slug string, page int, html string")
    d = html_tables.details(pages).where("page = 1").first()
    assert (d["age"], d["profession"], d["movable_total_inr"], d["immovable_total_inr"], d["serious_cases"], d["name"]) == (None, "Farmer", 0, 5000, 3, "Sample One")
    rows = html_tables.table_rows(pages)
    assert [tuple(r)[2:4] for r in html_tables.detail_cases(rows).collect()] == [("IPC 420", "A long enough description")]
    assert {tuple(r)[2:] for r in html_tables.detail_assets(rows).collect()} == {("movable", "Cash in hand", 1000), ("movable", "y" * 120, 2000)}


def test_paging_stops_at_a_page_without_new_ids(spark):
    row = '<tr><td>1</td><td><a href="?candidate_id={0}">N{0}</a></td><td>S</td><td>P</td><td>0</td><td>E</td><td>Rs 1</td><td>Rs 2</td></tr>'
    page = lambda *ids: "<table><tr><th>Candidate Constituency</th></tr>" + "".join(row.format(i) for i in ids) + "</table>"
    pages = spark.createDataFrame([("e", 1, page(1, 2)), ("e", 2, page(2, 3)), ("e", 3, page(1)), ("e", 4, page(9))], "slug string, page int, html string")
    got = html_tables.paged_candidates(html_tables.table_rows(pages)).collect()
    assert {(r["candidate_id"], r["page"]) for r in got} == {(1, 1), (2, 1), (3, 2)}


def test_cards():
    page = """<div class="card"><h4>SAMPLE ONE</h4><p>Party : ALPHA</p><p>State: Z</p><span class="badge">ACCEPTED</span><a href="/show-profile/1">View</a><a href="/show-profile/1">x</a><a href="/affidavit-pdf-download/12345">d</a></div>
    <ul><li>Name: SAMPLE TWO<br>Status: rejected<br>Constituency: C<br><a href="/show-profile/2">v</a><b data-affidavit-id="77"></b></li></ul>"""
    one, two = cards.cards(page)
    assert (one["name"], one["party"], one["status"], one["affidavit_id"]) == ("SAMPLE ONE", "ALPHA", "Accepted", "12345")
    assert (two["name"], two["status"], two["constituency"], two["affidavit_id"]) == ("SAMPLE TWO", "Rejected", "C", "77")


def test_manifest_last_line_wins_and_landing_resumes(spark, tmp_path):
    lines = [{"profile_url": "u", "status": "A"}, {"profile_url": "u", "status": "B"}, {"profile_url": ""}, {"profile_url": "v", "download_succeeded": True}]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    got = files.manifest(spark, str(folder))
    assert {(r["profile_url"], r["status"]) for r in got.collect()} == {("u", "B"), ("v", None)}
    assert [r["profile_url"] for r in files.pending(got, got).collect()] == ["u"]
    seen: list[int] = []
    for _ in range(2):
        landing.land(spark, str(folder), files.MANIFEST, str(tmp_path / "done"), lambda batch, n: seen.append(batch.count()))
    assert seen == [5] or seen == [4]


def test_centroids_flat_and_nested(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"X": {"lat": 1.0, "lng": 2.0}}')
    (tmp_path / "b.json").write_text('{"S": {"Y": {"lat": 3.0, "lng": 4.0}}}')
    assert {tuple(r) for f in "ab" for r in files.centroids(spark, str(tmp_path / f"{f}.json")).collect()} == {("X", 1.0, 2.0), ("Y", 3.0, 4.0)}


def test_listing_job_is_idempotent(spark, tmp_path):
    from oathmill.plans import jobs

    row = '<tr><td>1</td><td><a href="?candidate_id={0}">N{0}</a></td><td>S</td><td>P</td><td>{0}</td><td>E</td><td>Rs 1,0{0}</td><td>Nil</td></tr>'
    page = lambda *ids: "<table><tr><th>Candidate Constituency</th></tr>" + "".join(row.format(i) for i in ids) + "</table>"
    pages = spark.createDataFrame([("e", 1, page(1, 2))], "slug string, page int, html string")
    won = spark.createDataFrame([("e", 1, page(2, 3))], "slug string, page int, html string")
    root = str(tmp_path / "facts")
    jobs.load_listings(spark, pages, won, root, 1)
    once = {tuple(r) for r in jobs.current(spark, root, jobs.FACTS).collect()}
    jobs.load_listings(spark, pages, won, root, 2)
    assert {tuple(r) for r in jobs.current(spark, root, jobs.FACTS).collect()} == once
    assert {(r[1], r[6], r[7]) for r in once} == {(1, False, 101), (2, True, 102), (3, True, 103)}
    assert jobs.targets(spark, "all").count() > jobs.targets(spark, "goa").count() == 4


def test_engine_facade(spark, sf):
    from oathmill.engine import Engine

    assert Engine.of_driver_tables(spark, sf).hero_kpis(scope="current").first()["house"] == "Assembly"


def test_seats_listed_twice_belong_to_the_later(spark):
    from oathmill.sources import registry

    got = {r["ac"]: r["pc"] for r in registry.seats(spark).collect()}
    assert got["DHURI"] == "SANGRUR" and len(got) == 116


def test_rank_labels_follow_each_page_order(spark):
    f = fact(spark, [(i, i, "Assembly", 2024, "A", True, a, c) for i, a, c in [(1, 50, 1), (2, 90, 9), (3, 90, 4), (4, 10, 2), (5, 70, 3)]])
    top = analytics.rank_labels(analytics.top_by_wealth(f, 4), F.desc("assets"), "appearance_id").orderBy("rank")
    assert [(r["appearance_id"], r["rank"], r["badge"]) for r in top.collect()] == [(2, 1, True), (3, 2, True), (5, 3, True), (1, 4, False)]
    plain = analytics.browse(f, "S", sort="wealth").collect()
    got = analytics.browse_ranks(f, "S", sort="wealth").collect()
    assert [(r["politician_id"], r["rank"], r["badge"]) for r in got] == [(r["politician_id"], i, i <= 3) for i, r in enumerate(plain, 1)]
    plain = analytics.anomaly_candidates(f, 4, scope="all").collect()
    got = analytics.anomaly_ranks(f, 4, scope="all").collect()
    assert len(got) == 4 and [(r["appearance_id"], r["rank"], r["badge"]) for r in got] == [(r["appearance_id"], i, i <= 3) for i, r in enumerate(plain, 1)]


def test_a_published_version_is_never_written_again(spark, tmp_path):
    from oathmill.plans import jobs

    root, one = f"file://{tmp_path}/t", spark.createDataFrame([(1,)], "x int")
    jobs.publish(spark, one, root, 1)
    again = jobs.current(spark, root, "x int")
    with pytest.raises(ValueError):
        jobs.publish(spark, again, root, 1)
    assert [r["x"] for r in jobs.current(spark, root, "x int").collect()] == [1]
    jobs.publish(spark, again, root, 2)
    assert [r["x"] for r in jobs.current(spark, root, "x int").collect()] == [1]
