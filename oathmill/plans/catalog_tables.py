"""Queries over the normalised tables: newest elections, bulk copies, scoped reconciliation, slugs, lookups, cards. Registered with those of ``catalog``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.functions import names
from oathmill.operators import entity, ingest
from oathmill.plans import analytics as A
from oathmill.plans import model
from oathmill.plans.catalog import _KPIS, FACT, _register
from oathmill.sources import cards, html_tables

# --- elections as a relation ---


def _kpis(spark: SparkSession, d: str, known: bool) -> DataFrame:
    tables = model.normalised(spark, d)
    return A.hero_kpis(model.from_tables(tables), scope="current", elections=model.elections(tables) if known else None)


_register("kpis_newest_appearance", partial(_kpis, known=False), f"WITH {FACT} SELECT 'Assembly' AS house, {_KPIS} FROM current_assembly")
_register("kpis_newest_election", partial(_kpis, known=True), f"""WITH {FACT}, e AS (SELECT state, house, year FROM fact UNION SELECT n_name, 'Assembly', 2050 FROM nation)
SELECT 'Assembly' AS house, {_KPIS.replace('/ count(*)', '/ nullif(count(*), 0)')} FROM fact WHERE house = 'Assembly' AND won AND year = (SELECT max(year) FROM e WHERE house = 'Assembly')""")
_register("fact_from_tables", lambda s, d: model.from_tables(model.normalised(s, d)).drop("zone", "candidate_id"),
          f"WITH {FACT} SELECT appearance_id, politician_id, name, slug, state, house, year, constituency, party, won, assets, cases FROM fact")
_register("politician_lookup", lambda s, d: A.lookup(model.from_tables(model.normalised(s, d)), s.createDataFrame([("customer-000000007",), ("500009",), ("12",), ("CUSTOMER-000000015",), ("nobody",)], "key string")),
          f"""WITH {FACT}, p AS (SELECT politician_id, any_value(name) AS name, any_value(slug) AS slug FROM fact GROUP BY politician_id), k AS (SELECT unnest(['customer-000000007', '500009', '12', 'CUSTOMER-000000015', 'nobody']) AS key),
h AS (SELECT key, CASE WHEN slug = key THEN 1 WHEN CAST(politician_id + 500000 AS VARCHAR) = key THEN 2 WHEN CAST(politician_id AS VARCHAR) = key THEN 3 ELSE 4 END AS way, politician_id, name FROM p JOIN k
  ON slug = key OR CAST(politician_id + 500000 AS VARCHAR) = key OR CAST(politician_id AS VARCHAR) = key OR lower(slug) = lower(key))
SELECT key, CAST(way AS INTEGER) AS way, politician_id, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY way, politician_id) AS n FROM h) WHERE n = 1""")

# --- bulk copies ---


def _copied(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables into ones that hold a part already; a tenth of the politicians is missing, so their appearances and these's assets are orphans."""
    src = model.normalised(spark, d)
    assets = src["assets"].groupBy("appearance_id").agg(F.count("*").cast("int").alias("n")).select(F.col("appearance_id").alias("id"), "appearance_id", F.col("n").cast("string").alias("category"))
    src |= {"politicians": src["politicians"].where("id % 10 <> 3"), "assets": model._typed(assets, "assets")}
    dst = {name: spark.createDataFrame([], model.schema(name)) for name in model.SCHEMAS}
    dst["politicians"] = src["politicians"].where("id % 4 = 0").withColumn("name", F.lit("kept as it was"))
    return ingest.bulk_copy(src, dst)


_COPY = f"""WITH {FACT}, p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'kept as it was' ELSE c_name END AS name FROM customer WHERE c_custkey % 10 <> 3),
a AS (SELECT * FROM fact WHERE politician_id IN (SELECT id FROM p)), c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
_register("copied_politicians", lambda s, d: _copied(s, d)[0]["politicians"].select("id", "name"), f"{_COPY} SELECT CAST(id AS INTEGER) AS id, name FROM p")
_register("copied_appearances", lambda s, d: _copied(s, d)[0]["election_appearances"].select("id", "politician_id", "won", "total_assets_inr"), f"{_COPY} SELECT CAST(appearance_id AS INTEGER) AS id, CAST(politician_id AS INTEGER) AS politician_id, won, assets AS total_assets_inr FROM a")
_register("copied_assets", lambda s, d: _copied(s, d)[0]["assets"].select("id", "category"), f"{_COPY} SELECT CAST(id AS INTEGER) AS id, CAST(n AS VARCHAR) AS category FROM c WHERE id IN (SELECT appearance_id FROM a)")


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    lost = _copied(spark, d)[1]
    out = None
    for name in ingest.dependency_order(ingest.REFERENCES):
        part = lost[name].select(F.lit(name).alias("name"), "id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_register("copy_rejected", _rejected, f"""{_COPY} SELECT 'election_appearances' AS name, count(*) AS n, CAST(sum(appearance_id) AS BIGINT) AS ids FROM fact WHERE politician_id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'assets', count(*), CAST(sum(id) AS BIGINT) FROM c WHERE id NOT IN (SELECT appearance_id FROM a)""")


def _next_ids(spark: SparkSession, d: str) -> DataFrame:
    following = _copied(spark, d)[2]
    parts = [following[name].select(F.lit(name).alias("name"), "next_id") for name in ("states", "politicians", "election_appearances", "assets", "liabilities")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_register("copy_next_ids", _next_ids, f"""{_COPY} SELECT 'states' AS name, CAST(max(n_nationkey) + 2 AS INTEGER) AS next_id FROM nation UNION ALL SELECT 'politicians', CAST(max(id) + 1 AS INTEGER) FROM p
UNION ALL SELECT 'election_appearances', CAST(max(appearance_id) + 1 AS INTEGER) FROM a UNION ALL SELECT 'assets', CAST(max(id) + 1 AS INTEGER) FROM c WHERE id IN (SELECT appearance_id FROM a) UNION ALL SELECT 'liabilities', 1""")

# --- scoped reconciliation ---


def _scoped_recon(spark: SparkSession, d: str) -> DataFrame:
    """Ten names for all: each stands in many states and years, once or several times."""
    fact = model.from_driver(spark, d)
    name = F.concat(F.lit("Person "), (F.col("politician_id") % 10).cast("string"))
    recorded = fact.select(F.col("appearance_id").alias("id"), name.alias("name"), "year", "state", "assets", "cases")
    asked = F.when(F.col("appearance_id") % 5 == 0, F.lower("state")).when(F.col("appearance_id") % 7 == 0, F.lit("nat 7")).otherwise(F.col("state"))
    read = fact.where("appearance_id % 3 = 0").select(
        F.col("appearance_id").alias("doc"), F.when(F.col("appearance_id") % 11 > 0, F.upper(name)).otherwise(" ").alias("name"), "year", F.replace(asked, F.lit("_"), F.lit(" ")).alias("state"), F.col("assets").alias("read_assets"), F.col("cases").alias("read_cases"))
    return entity.reconcile_scoped(read, recorded.withColumn("state", F.replace(F.col("state"), F.lit("_"), F.lit(" of ")))).select("doc", "id", "status")


_register("reconcile_scoped", _scoped_recon, f"""WITH {FACT}, db AS (SELECT appearance_id AS id, politician_id % 10 AS who, year, replace(state, '_', ' of ') AS held, assets, cases FROM fact),
r AS (SELECT appearance_id AS doc, CASE WHEN appearance_id % 11 > 0 THEN politician_id % 10 END AS who, year, assets AS ra, cases AS rc,
  replace(CASE WHEN appearance_id % 5 = 0 THEN lower(state) WHEN appearance_id % 7 = 0 THEN 'nat 7' ELSE state END, '_', '%') AS asked FROM fact WHERE appearance_id % 3 = 0),
m AS (SELECT doc, arg_min({{'id': id, 'a': assets, 'c': cases}}, id) AS b FROM r JOIN db USING (who, year) WHERE held ILIKE '%' || replace(asked, ' ', '%') || '%' GROUP BY doc),
g AS (SELECT doc, b.id AS id, b.a AS a, abs(rc - b.c) AS dc, ra, CASE WHEN b.a = 0 THEN CASE WHEN ra = 0 THEN 0.0 ELSE 100.0 END ELSE CAST(abs(ra - b.a) AS DOUBLE) / CAST(b.a AS DOUBLE) * 100 END AS gap FROM r LEFT JOIN m USING (doc))
SELECT doc, id, CASE WHEN a IS NULL THEN 'NO_DB_ROW' WHEN gap <= 5 AND dc <= 0 THEN 'MATCH' WHEN gap <= 10 AND dc <= 1 THEN 'CLOSE' ELSE 'FLAG' END AS status FROM g""")

# --- slugs of other scripts ---

_SPELLED = ("Crème Brûlée", "ﬁne Œuvre Straße", "été", "राम", "ਗੁਰਦਾਸਪੁਰ", "Юлия", "O'Neil 1,000", "数 x")
_SLUGS = ("creme-brulee", "fine-oeuvre-strasse", "ete", "raam", "gurdaaspur", "iuliia", "o-neil-1000", "x")
_register("slugs", lambda s, d: model.table(s, d, "customer").select("c_custkey", names.slugify(F.concat(F.get(F.array(*[F.lit(x) for x in _SPELLED]), (F.col("c_custkey") % len(_SPELLED)).cast("int")), F.lit(" "), F.col("c_name"))).alias("slug")),
          f"SELECT c_custkey, {list(_SLUGS)}[c_custkey % {len(_SLUGS)} + 1] || '-' || replace(lower(c_name), '#', '-') AS slug FROM customer")

# --- cards ---


def _card_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pages of candidate cards, one page per nation; labels, badges and download links are absent on some."""
    k = F.col("c_custkey")
    text = lambda x: x if not isinstance(x, str) else F.lit(x)
    cat = lambda *xs: F.concat(*[text(x) for x in xs])
    status = F.when(k % 3 == 0, "<p>Status: <b>ACCEPTED</b></p>").when(k % 3 == 1, '<span class="badge">rejected</span>').otherwise("")
    name = F.when(k % 4 > 0, cat("<p>Name : ", F.col("c_name"), "</p>")).otherwise(cat("<h4>", F.col("c_name"), "</h4>"))
    number = F.when(k % 5 == 0, cat(' data-affidavit-id="A', k.cast("string"), '"')).otherwise("")
    link = F.when(k % 5 == 1, cat('<a href="/download/', (k + 1000).cast("string"), '">pdf</a>')).otherwise("")
    card = cat('<div class="candidate card">', name, "<p>Party : ", F.col("c_mktsegment"), "</p>", status, "<p>State: N", F.col("c_nationkey").cast("string"), "</p><a href=\"/show-profile/", k.cast("string"), '"', number, ">View</a>", link, "</div>")
    rows = model.table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.struct("c_custkey", card.alias("card")).alias("c"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("c")).alias("cards"))
    return pages.select("page", F.concat(F.lit("<html><body><a href='/'>home</a>"), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), F.lit("</body></html>")).alias("html"))


_register("listing_cards", lambda s, d: cards.listing_cards(_card_pages(s, d)), """SELECT CAST(c_nationkey AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_name AS name, c_mktsegment AS party,
  CASE c_custkey % 3 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Rejected' ELSE '' END AS status, 'N' || c_nationkey AS state, '' AS constituency, '/show-profile/' || c_custkey AS profile_url,
  CASE c_custkey % 5 WHEN 0 THEN 'A' || c_custkey WHEN 1 THEN CAST(c_custkey + 1000 AS VARCHAR) ELSE '' END AS affidavit_id FROM customer""")
_register("near_seats", lambda s, d: html_tables.near_names(model.table(s, d, "customer").select("c_custkey", F.col("c_name").alias("constituency")), model.table(s, d, "customer").where("c_custkey % 50 = 3").select(F.substring("c_name", 1, 17).alias("seat"))).select("c_custkey"),
          "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey % 50 = 3 AND starts_with(c.c_name, substr(k.c_name, 1, 17)))")
