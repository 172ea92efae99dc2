"""What bounds memory and repeated work on large tables."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from compare import rows_of
from oathmill.operators import entity
from oathmill.plans import catalog, catalog_rows, jobs
from oathmill.sources import html_tables, readers

LISTING = "<table><tr><th>Candidate</th><th>Constituency</th></tr>" + "".join(f'<tr><td>1</td><td><a href="?candidate_id={i}">N{i}</a></td><td>X</td><td>A</td><td>0</td><td>G</td><td>Rs 5</td><td>Rs 1</td></tr>' for i in range(1, 4000)) + "</table>"


def _optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_long_page_leave_in_small_batches():
    page = pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([1], pa.int32()), pa.array([LISTING])], ["slug", "page", "html"])
    sizes = [b.num_rows for b in html_tables._split(iter([page]))]
    assert sum(sizes) == 4000 and max(sizes) <= html_tables.ROWS


def test_lines_of_a_manifest_leave_in_small_batches(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"profile_url": "é{i}"}}\n' for i in range(10_000)))
    from pyspark.sql.types import StructType

    reader = readers.Manifest({"path": str(tmp_path)}).reader(StructType.fromDDL("profile_url string, line int, file string, error string"))
    batches = list(reader.read(reader.partitions()[0]))
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["profile_url"], r["line"]) for r in rows] == [(f"é{i}", i) for i in range(10_000)] and max(b.num_rows for b in batches) <= readers.ROWS


def test_loads_parse_pages_once(spark):
    pages = spark.createDataFrame([("goa2022", 1, LISTING)], "slug string, page int, html string")
    facts = jobs.listing_facts(pages, pages)
    assert "MapInArrow" not in _optimized(facts) and facts.where("won").count() == 3999


def test_prefix_filter_has_the_customer_of_key_0(spark, tmp_path):
    rows = pa.table({"c_custkey": pa.array([0, 1, 2]), "c_name": ["a", "b", "c"], "c_nationkey": pa.array([1, 1, 2], pa.int32()), "c_acctbal": [1.0, 2.0, 3.0], "c_mktsegment": ["BUILDING", "MACHINERY", "FURNITURE"]})
    pq.write_table(rows, tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(catalog.ORACLES["listing_prefix_filter"]).fetchdf()
    assert rows_of(catalog.QUERIES["listing_prefix_filter"](spark, str(tmp_path)).toPandas()) == rows_of(want) and len(want) == 2


def test_prefix_filter_has_customers_below_0_and_with_blanks(spark, tmp_path):
    keys, names, money = [-150_001, -1, 0, 4, None, 80_000, 7, 8], ["a", "b", "c", None, "e", "", "g", "h"], [1.0, None, 3.0, 4.0, 5.0, -6.5, 7.0, None]
    seats = ["BUILDING", "MACHINERY", "BUILDING", "MACHINERY", "BUILDING", "MACHINERY", "FURNITURE", None]
    rows = pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_name": names, "c_nationkey": pa.array([1, 1, 2, None, 1, 2, 2, 1], pa.int32()), "c_acctbal": money, "c_mktsegment": seats})
    pq.write_table(rows, tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    con.execute("CREATE VIEW want AS " + catalog.ORACLES["listing_prefix_filter"])
    got = catalog.QUERIES["listing_prefix_filter"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute("FROM want").fetchall(), key=str) and got.count() == 6


def test_pages_of_a_small_file_are_dealt_to_all_cores(spark, sf):
    assert catalog_rows._candidate_pages(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_namesakes_meet_by_their_states(spark):
    """Both sides are grouped before they meet: the plan has an aggregate on each, and one on what met."""
    rows = spark.range(3000).selectExpr("id", "id AS doc", "'Ada' AS name", "2020 AS year", "'North X' AS state", "id AS assets", "0 AS cases", "id AS read_assets", "0 AS read_cases")
    out = entity.reconcile_scoped(rows.select("doc", "name", "year", "state", "read_assets", "read_cases"), rows.select("id", "name", "year", "state", "assets", "cases"))
    assert _optimized(out).count("Aggregate [") >= 3
    assert {(r["id"], r["n"]) for r in out.groupBy("id").count().withColumnRenamed("count", "n").collect()} == {(0, 3000)}


def test_pages_of_a_form_are_looked_for_once(spark, sf):
    assert _optimized(entity.parse_affidavits(catalog._part_b(spark, sf))).count("DESCRIPTIONOFDOCUMENT") <= 2


def test_market_row_of_a_form_is_looked_for_once(spark, sf):
    """A page is split once, not once for each of its lines, and its row is found once, not once for each use of its amounts."""
    plan = _optimized(entity.parse_affidavits(catalog._part_b(spark, sf)))
    assert plan.count("split(lambda") == 1 and plan.count("u[rn]rent") == 2 and plan.count("a?ble") == 1


def test_candidates_are_made_without_a_join(spark, sf):
    assert "Join" not in _optimized(entity.candidates(catalog._records(spark, sf)))
