"""More queries by name: crawl rows, candidate pages, fills, reports, profiles. Registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.functions import cases as C
from oathmill.functions import documents as D
from oathmill.functions import money, names
from oathmill.operators import entity, ingest
from oathmill.plans import analytics as A
from oathmill.plans import catalog, model
from oathmill.plans.catalog import _fact, _register
from oathmill.sources import files, html_tables


def _s(x) -> F.Column:
    return F.col(x).cast("string")


# --- profiles, maps, ranks ---

_ASKED = ("7", "42", "101")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    cases = catalog._ipc(spark, d, "l_orderkey", "l_linenumber", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("appearance_id"), F.col("l_linenumber").alias("case_no"), "ipc")
    return A.profile(model.from_driver(spark, d), cases, spark.createDataFrame([(k,) for k in _ASKED], "key string"))


_register("politician_profile", _profile, f"""WITH {catalog.FACT},
c AS (SELECT l_orderkey AS appearance_id, count(*) AS n_cases, string_agg({catalog._IPC}, '; ' ORDER BY l_linenumber, {catalog._IPC}) AS sections FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
t AS (SELECT *, lag(assets) OVER w AS previous, lag(year) OVER w AS from_year FROM fact WHERE politician_id IN (7, 42, 101) WINDOW w AS (PARTITION BY politician_id ORDER BY year, appearance_id))
SELECT appearance_id, CAST(politician_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY politician_id ORDER BY year DESC, appearance_id DESC) AS INTEGER) AS nth, politician_id, name, year,
  coalesce(party, 'IND') AS party, constituency, won, assets, CASE WHEN previous > 0 THEN from_year END AS from_year, CASE WHEN previous > 0 THEN assets - previous END AS delta,
  CASE WHEN previous > 0 THEN CAST(assets - previous AS DOUBLE) / CAST(previous AS DOUBLE) * 100 END AS pct, coalesce(n_cases, 0) AS n_cases, coalesce(sections, '') AS sections
FROM t LEFT JOIN c USING (appearance_id)""")


def _areas(spark: SparkSession, d: str) -> DataFrame:
    seats = model.table(spark, d, "customer").join(model.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", F.lower("n_name"), F.lower("c_mktsegment")).alias("seat")).distinct()
    return seats.select(F.concat("seat", F.lit("  (SC)")).alias("name")).unionByName(spark.createDataFrame([("Nowhere",)], "name string"))


_register("heat_map", lambda s, d: A.heat_map(model.from_driver(s, d), _areas(s, d)), f"""WITH {catalog.FACT},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(constituency) ORDER BY year DESC, appearance_id) AS n FROM fact WHERE house = 'Assembly' AND won) WHERE n = 1),
a AS (SELECT DISTINCT lower(n_name) || ' ' || lower(c_mktsegment) AS seat FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Nowhere')
SELECT CASE WHEN seat = 'Nowhere' THEN seat ELSE seat || '  (SC)' END AS name, constituency, w.name AS mla, assets AS wealth_inr, cases,
  CASE WHEN cases IS NULL THEN 'none' WHEN cases < 1 THEN '<1' WHEN cases < 2 THEN '<2' WHEN cases < 4 THEN '<4' WHEN cases < 6 THEN '<6' ELSE '>=6' END AS severity
FROM a LEFT JOIN w ON upper(a.seat) = upper(constituency)""")
_fact("browse_ranks", lambda f: A.browse_ranks(f, "NATION_7", sort="wealth").select("politician_id", "wealth_inr", "rank", "badge"), catalog._BROWSE + """ SELECT politician_id, wealth_inr,
  CAST(row_number() OVER (ORDER BY wealth_inr DESC, politician_id) AS INTEGER) AS rank, row_number() OVER (ORDER BY wealth_inr DESC, politician_id) <= 3 AS badge FROM p""")

# --- crawl rows ---


def _crawl(spark: SparkSession, d: str) -> DataFrame:
    """Orders as crawled cards: addresses and affidavit ids repeat, statuses come in any case or not at all."""
    o = model.table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderstatus") == "O", "Accepted").when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("withdrawn")
    return o.select(
        (F.col("o_orderkey") % 7).alias("page"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("https://x.org/"), _s("o_custkey")).alias("profile_url"),
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("A"), (F.col("o_orderkey") % 5000).cast("string"))).otherwise("").alias("affidavit_id"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("download_succeeded"))


_CRAWL = """WITH c AS (SELECT o_orderkey % 7 AS page, o_orderkey AS pos, 'https://x.org/' || o_custkey AS profile_url, CASE WHEN o_orderkey % 4 > 0 THEN 'A' || (o_orderkey % 5000) ELSE '' END AS affidavit_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'Accepted' WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'withdrawn' END AS status, o_orderkey % 3 = 0 AS download_succeeded FROM orders)"""
_register("crawl_dedupe", lambda s, d: files.crawl_dedupe(_crawl(s, d)).select("page", "pos", "profile_url", "affidavit_id"), _CRAWL.replace("WITH c", "WITH RECURSIVE c") + """,
r AS (
  SELECT page, pos, profile_url, affidavit_id, false AS kept FROM c
  UNION ALL
  SELECT page, pos, profile_url, affidavit_id, k FROM (
    SELECT *, bool_or(k) OVER (PARTITION BY profile_url) OR (affidavit_id <> '' AND bool_or(k) OVER (PARTITION BY affidavit_id)) AS taken FROM (
      SELECT *, row_number() OVER (PARTITION BY profile_url ORDER BY page, pos) = 1 AND (affidavit_id = '' OR row_number() OVER (PARTITION BY affidavit_id ORDER BY page, pos) = 1) AS k FROM r WHERE NOT kept))
  WHERE k OR NOT taken)
SELECT page, pos, profile_url, affidavit_id FROM r WHERE kept""")
_register("crawl_status", lambda s, d: files.with_status(_crawl(s, d), ("accepted", "withdrawn"), keep_unknown=True).select("pos", "status"), _CRAWL + " SELECT pos, status FROM c WHERE lower(coalesce(status, '')) IN ('accepted', 'withdrawn', '')")
_register("crawl_status_counts", lambda s, d: files.status_counts(_crawl(s, d)), _CRAWL + " SELECT coalesce(status, '(blank)') AS status, count(*) AS n FROM c GROUP BY 1")
_register("crawl_pending", lambda s, d: files.pending(_crawl(s, d), _crawl(s, d)).select("pos"), _CRAWL + " SELECT pos FROM c WHERE profile_url NOT IN (SELECT profile_url FROM c WHERE download_succeeded)")
_register("first_option", lambda s, d: files.first_option(model.table(s, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 10 != 1, _s("n_nationkey")).otherwise("").alias("value")), "nation_1"),
          "SELECT n_nationkey AS position, n_name AS label, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_nationkey % 10 <> 1 AND contains(lower(n_name), 'nation_1') ORDER BY position LIMIT 1")
_register("page_addresses", lambda s, d: model.table(s, d, "pages").select("page_id", files.with_page(F.col("url"), F.col("page_id")).alias("address")), """SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=\\d*') THEN regexp_replace(url, '([?&])page=\\d*', '\\1page=' || page_id)
  WHEN contains(url, '?') THEN url || '&page=' || page_id ELSE url || '?page=' || page_id END AS address FROM pages""")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    p = model.table(spark, d, "pages")
    head = F.when(F.col("page_id") % 5 == 0, "404 ").otherwise("")
    return p.select("page_id", F.concat(head, F.lit("Candidates of a "), F.when(F.col("page_id") % 3 > 0, "CONSTITUENCY").otherwise("town"), "html").alias("html"))


_register("listing_answers", lambda s, d: _answers(s, d).select("page_id", html_tables.looks_like_listing(F.col("html")).alias("listing")), """WITH a AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '404 ' ELSE '' END || 'Candidates of a ' || CASE WHEN page_id % 3 > 0 THEN 'CONSTITUENCY' ELSE 'town' END || html AS html FROM pages)
SELECT page_id, length(html) >= 1000 AND contains(lower(html), 'constituency') AND NOT contains(substr(html, 1, 500), '404') AS listing FROM a""")
_register("cached_pages", lambda s, d: html_tables.cached(model.table(s, d, "pages").select("url").distinct().unionByName(s.createDataFrame([("https://not.saved/",)], "url string")), model.table(s, d, "pages").select(F.sha1("url").alias("sha1"), "html")).select("url", F.char_length("html").cast("long").alias("chars")),
          "SELECT url, length(html) AS chars FROM (SELECT DISTINCT url FROM pages) JOIN pages USING (url)")

# --- candidate pages ---


def _candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pages of candidates: a heading, facts, a table of cases and one of assets."""
    k = F.col("c_custkey")
    cases = F.concat(F.lit("<table><tr><th>Serial</th><th>IPC sections</th><th>Details</th></tr><tr><td>1</td><td>IPC "), (k % 500).cast("string"), F.lit("</td><td>A quarrel about the town's well, told at length</td></tr></table>"))
    assets = F.concat(F.lit("<h3>Movable Assets</h3><table><tr><td>Sr No</td><td>Description</td><td>Self</td></tr><tr><td>i</td><td>Bank deposits</td><td>Rs "), F.format_number(k * 1000, 0), F.lit("</td><td>Rs 5</td></tr><tr><td>ii</td><td>Gross Total Value</td><td>Rs 9</td></tr></table>"))
    facts = F.concat(F.lit("<p>Self Age: "), (k % 130).cast("string"), F.lit("</p><p>Self Profession: Farmer Self</p><p>Total Movable Assets: Rs "), F.format_number(k * 1000, 0), F.lit("</p><p>"), (k % 4).cast("string"), F.lit(" Number of Serious IPC counts</p>"))
    name = F.concat(F.lit("Ada No "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    return model.spread(model.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.cast("string").alias("slug"), F.lit(1).alias("page"), F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body><h2>"), name, F.lit("</h2>"), facts, cases, assets, F.lit("</body></html>")).alias("html"))


_register("candidate_details", lambda s, d: html_tables.details(_candidate_pages(s, d)).select("slug", "age", "profession", "movable_total_inr", "immovable_total_inr", "serious_cases", "name"), """SELECT CAST(c_custkey AS VARCHAR) AS slug, CAST(CASE WHEN c_custkey % 130 BETWEEN 18 AND 110 THEN c_custkey % 130 END AS INTEGER) AS age,
  'Farmer' AS profession, c_custkey * 1000 AS movable_total_inr, CAST(0 AS BIGINT) AS immovable_total_inr, CAST(c_custkey % 4 AS INTEGER) AS serious_cases, 'Ada No ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS name FROM customer""")
_register("candidate_cases", lambda s, d: html_tables.detail_cases(html_tables.table_rows(_candidate_pages(s, d))).select("slug", "ipc_sections", "description", "status"), "SELECT CAST(c_custkey AS VARCHAR) AS slug, 'IPC ' || (c_custkey % 500) AS ipc_sections, 'A quarrel about the town''s well, told at length' AS description, 'pending' AS status FROM customer")
_register("candidate_assets", lambda s, d: html_tables.detail_assets(html_tables.table_rows(_candidate_pages(s, d))).select("slug", "category", "subcategory", "value_inr"), "SELECT CAST(c_custkey AS VARCHAR) AS slug, 'movable' AS category, 'Bank deposits' AS subcategory, greatest(c_custkey * 1000, 5) AS value_inr FROM customer")

# --- columns ---

_register("display_names", lambda s, d: model.table(s, d, "customer").select("c_custkey", names.display_name(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise(" "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 5), F.col("c_custkey")).alias("shown")),
          "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'Candidate #' || (c_custkey + 5) ELSE 'Politician #' || c_custkey END AS shown FROM customer")
_register("crore_labels", lambda s, d: model.table(s, d, "part").select("p_partkey", money.crore_label(F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") * 100_000 * 9973)).alias("label")), "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN format('{:,.2f}', p_partkey * 9973 / 100.0) ELSE '0.00' END AS label FROM part")
_register("case_sections", lambda s, d: catalog._ipc(s, d).select(F.explode(C.sections(F.col("ipc"))).alias("section")).groupBy("section").agg(F.count("*").alias("n")), f"WITH t AS (SELECT unnest(string_split({catalog._IPC}, ',')) AS s FROM lineitem) SELECT trim(s) AS section, count(*) AS n FROM t GROUP BY 1")
_register("page_layers", lambda s, d: model.table(s, d, "part").select("p_partkey", D.page_text(F.when(F.col("p_partkey") % 3 > 0, F.repeat(F.concat("p_name", F.lit(" ")), 12)).otherwise(F.lit(" short ")), F.when(F.col("p_partkey") % 2 > 0, F.col("p_name"))).alias("text")),
          "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND length(trim(repeat(p_name || ' ', 12))) >= 150 THEN repeat(p_name || ' ', 12) WHEN p_partkey % 2 > 0 THEN p_name ELSE '' END AS text FROM part")


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pieces of text: two of an order stand within three units of each other, the next two far below."""
    n = F.col("l_linenumber")
    piece = F.struct((F.floor(n / 2) * 40 + n % 2 * 3).cast("double").alias("y"), (F.col("l_partkey") * 10 + n).cast("double").alias("x"), _s("l_partkey").alias("text"))
    return model.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(piece).alias("fragments"))


_register("folded_rows", lambda s, d: _fragments(s, d).select("l_orderkey", D.joined_rows(F.col("fragments")).alias("text")), """WITH r AS (SELECT l_orderkey, l_linenumber // 2 AS y, string_agg(CAST(l_partkey AS VARCHAR), ' | ' ORDER BY l_partkey * 10 + l_linenumber) AS t FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(t, chr(10) ORDER BY y) AS text FROM r GROUP BY 1""")

# --- documents and reports ---


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    total = lambda x: F.concat(F.lit('{"movable":{"self":{"gross_total":'), x.cast("string"), F.lit("}}}"))
    parts = [F.lit('{"candidate":{"name":"x"},"election":{"house":"'), F.when(k % 5 == 0, "Senate").otherwise("Assembly"), F.lit('"},"criminal":{"pending_cases_count":1},"assets":'), total(k), F.lit(',"abstract":{"movable_self":'), (k + (k % 7 == 0).cast("long")).cast("string"),
             F.lit('},"liabilities":{"grand_total":'), F.when(k % 3 == 0, "-1").otherwise("1"), F.lit("}"), F.when(k % 4 == 0, "").otherwise(',"provenance":{}'), F.lit("}")]
    return model.table(spark, d, "orders").select(k.alias("doc"), F.concat(*parts).alias("json"))


_register("extracted_problems", lambda s, d: entity.validate_extracted(_extracted(s, d)), """SELECT o_orderkey AS doc, concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'missing provenance' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown house' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'negative liabilities.grand_total' END, CASE WHEN o_orderkey % 7 = 0 THEN 'totals differ' END) AS problems FROM orders""")
_register("reconcile_gate", lambda s, d: entity.flag_gate(entity.status_shares(catalog._recon(s, d), entity.RECON_STATUSES)), catalog._RECON + " SELECT 100.0 * count(*) FILTER (WHERE status = 'FLAG') / count(*) <= 10 AS passes, CAST(100 * count(*) FILTER (WHERE status = 'FLAG') AS DOUBLE) / count(*) AS pct FROM s")


def _two_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return model.table(spark, d, "customer").select(k.alias("key"), k.alias("assets_db"), F.when(k % 3 > 0, k + (k % 4 == 0).cast("long")).alias("assets_doc"), F.when(k % 5 > 0, "x").alias("party_db"), F.lit("x").alias("party_doc"))


_register("field_comparison", lambda s, d: files.field_comparison(_two_sources(s, d), ["assets", "party"], "db", "doc"), """WITH x AS (SELECT c_custkey AS key, 'assets' AS field, CAST(c_custkey AS VARCHAR) AS db, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS doc FROM customer
  UNION ALL SELECT c_custkey, 'party', CASE WHEN c_custkey % 5 > 0 THEN 'x' END, 'x' FROM customer)
SELECT *, CASE WHEN db IS NULL OR doc IS NULL THEN 'MISSING' WHEN db = doc THEN 'SAME' ELSE 'DIFFERENT' END AS verdict FROM x""")

# --- fills ---


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_orderkey"), model.table(spark, d, "orders")
    rows = o.select(k.alias("appearance_id"), F.when(k % 2 == 0, 40).alias("age"), F.when(k % 3 == 0, "Farmer").when(k % 3 == 1, "").alias("profession"), k.alias("movable_assets_inr"), F.lit(7).cast("long").alias("immovable_assets_inr"), F.lit(1).alias("serious_cases_count"))
    read = o.where(k % 5 > 0).select(k.alias("appearance_id"), F.lit(50).alias("age"), F.lit("Doctor").alias("profession"), F.when(k % 4 > 0, k * 2).otherwise(0).alias("movable_assets_inr"), F.lit(-1).cast("long").alias("immovable_assets_inr"), (k % 3).cast("int").alias("serious_cases_count"))
    return ingest.enrich(rows, read)


_register("enrich_fill", _enriched, """SELECT o_orderkey AS appearance_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 40 WHEN o_orderkey % 5 > 0 THEN 50 END AS INTEGER) AS age,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Farmer' WHEN o_orderkey % 5 > 0 THEN 'Doctor' END AS profession, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 4 > 0 THEN o_orderkey * 2 ELSE o_orderkey END AS movable_assets_inr,
  CAST(7 AS BIGINT) AS immovable_assets_inr, CAST(CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS INTEGER) AS serious_cases_count FROM orders""")


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("c_custkey"), model.table(spark, d, "customer")
    people = c.select(k.alias("id"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("e"), _s("c_nationkey")).alias("election"), (k % 50).alias("candidate_id"))
    source = c.select(F.concat(F.lit("e"), _s("c_nationkey")).alias("election"), (k % 50).alias("candidate_id"), F.concat(F.lit("Source "), _s("c_nationkey"), F.lit("/"), (k % 50).cast("string")).alias("name"))
    return ingest.repair_names(people, source)


_register("repair_names", _renamed, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Source ' || c_nationkey || '/' || (c_custkey % 50) ELSE c_name END AS name, 'e' || c_nationkey AS election, c_custkey % 50 AS candidate_id FROM customer")
_register("added_columns", lambda s, d: ingest.add_missing_columns(model.table(s, d, "region").select("r_regionkey", "r_name"), {"r_name": "string", "zone": "string", "seats": "int"}), "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS zone, CAST(NULL AS INTEGER) AS seats FROM region")
