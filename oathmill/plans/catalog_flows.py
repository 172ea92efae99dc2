"""Queries over whole pages and loads: the home page, landed files, streamed manifests. Registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.plans import catalog, catalog_rows, home, jobs, model
from oathmill.plans.catalog import FACT, _fact, _register
from oathmill.plans.commits import Log
from oathmill.sources import html_tables, readers
from oathmill.store import Scratch, filesystem
from oathmill.streaming import landing

# --- home page ---

_SQL_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE"}


def _cells(section: str, **cells: str) -> str:
    """A select list of the page's columns; what is not given is null."""
    cells["section"] = f"'{section}'"
    return ", ".join(f"CAST({cells.get(c, 'NULL')} AS {_SQL_KINDS[kind]}) AS {c}" for c, kind in home.OUT.items())


def _home_sql(house: str, scope: str, state: str | None) -> str:
    here = f"state = '{state}'" if state else "true"
    place = lambda order: f"row_number() OVER (ORDER BY {order})"
    sums = {"count": "count(*)", "with_cases": "count(*) FILTER (WHERE cases > 0)", "crorepati": "count(*) FILTER (WHERE assets >= 10000000)", "amount_inr": "coalesce(sum(assets), 0)", "cases": "coalesce(sum(cases), 0)",
            "pct": "coalesce(CAST(100 * count(*) FILTER (WHERE cases > 0) AS DOUBLE) / nullif(count(*), 0), 0)"}
    of = lambda on: {k: v.replace("count(*) FILTER (WHERE", f"count(*) FILTER (WHERE {on} AND").replace("count(*)", f"count(*) FILTER (WHERE {on})", 1) if k in ("count",) else
                     v.replace("FILTER (WHERE", f"FILTER (WHERE {on} AND").replace("nullif(count(*), 0)", f"nullif(count(*) FILTER (WHERE {on}), 0)").replace("sum(assets)", f"sum(assets) FILTER (WHERE {on})").replace("sum(cases)", f"sum(cases) FILTER (WHERE {on})") for k, v in sums.items()}
    card = {"id": "appearance_id", "name": "name", "label": "constituency", "year": "year", "party": "coalesce(party, 'IND')", "amount_inr": "assets", "cases": "cases"}
    point = card | {"state": "state", "house": "house"}
    grown = {"id": "politician_id", "name": "name", "label": "label", "year": "last_year", "party": "party", "from_inr": "from_inr", "amount_inr": "to_inr"}
    parts = [
        f"SELECT {_cells('top_wealth', pos=place('assets DESC, appearance_id'), **card)} FROM shown WHERE assets <> 0",
        f"SELECT {_cells('top_cases', pos=place('cases DESC, appearance_id'), **card)} FROM shown WHERE cases > 0",
        f"SELECT {_cells('clean_wealthy', pos=place('assets DESC, appearance_id'), **card)} FROM shown WHERE assets >= 50000000 AND cases = 0",
        f"SELECT {_cells('wealth_multipliers', pos=place('pct DESC, politician_id'), pct='pct', **grown)} FROM (SELECT *, round(CAST(to_inr - from_inr AS DOUBLE) / CAST(from_inr AS DOUBLE) * 100) AS pct FROM ways WHERE from_inr >= 100000 AND to_inr > from_inr)",
        f"SELECT {_cells('crorepati_newcomers', pos=place('to_inr DESC, politician_id'), pct='CAST(to_inr - from_inr AS DOUBLE) * 100 / greatest(from_inr, 1)', **grown)} FROM ways WHERE from_inr < 10000000 AND to_inr >= 10000000",
        f"""SELECT {_cells('long_servers', pos=place('wins DESC, year DESC, politician_id'), id='politician_id', name='name', year='year', count='wins')} FROM
  (SELECT politician_id, any_value(name) AS name, count(*) AS wins, max(year) AS year FROM fact WHERE won AND house = '{house}' AND {here} GROUP BY politician_id HAVING count(*) >= 2)""",
        f"""SELECT {_cells('switchers', pos=place('n DESC, year DESC, politician_id'), id='politician_id', name='name', label='journey', year='year', party='party', count='n')} FROM
  (SELECT politician_id, any_value(name) AS name, count(*) FILTER (WHERE party <> before) AS n, max(year) AS year, arg_max(party, (year, appearance_id)) AS party, string_agg(party, ' > ' ORDER BY year, appearance_id) AS journey
   FROM (SELECT *, lag(party) OVER (PARTITION BY politician_id ORDER BY year, appearance_id) AS before FROM fact WHERE party IS NOT NULL AND {here}) GROUP BY politician_id HAVING count(DISTINCT party) >= 2)"""]
    ranked = " UNION ALL ".join(f"SELECT * FROM ({p}) WHERE pos <= 10" for p in parts)
    winners = f"(SELECT * FROM fact WHERE won AND house = 'Assembly' AND {here})"
    zone = sums | {"pct": "CAST(100 * count(*) FILTER (WHERE cases = 0) AS DOUBLE) / count(*)"}
    seat = of("w.year = y.year")
    rest = [
        f"SELECT {_cells('kpis_all', **sums)} FROM latest_house WHERE {here}",
        f"SELECT {_cells('kpis_current', **sums)} FROM current_house",
        f"SELECT {_cells('cycles', state='state', house='house', year='year', **of('won'))} FROM fact GROUP BY state, house, year",
        f"SELECT {_cells('trends', state='state', house='house', year='year', **sums)} FROM fact WHERE won AND {here} GROUP BY state, house, year",
        f"""SELECT {_cells('parties', party='party', from_inr='max(CASE WHEN i = n - CAST(floor((n - 1) / 2) AS BIGINT) THEN assets END)', **sums)} FROM
  (SELECT *, row_number() OVER (PARTITION BY party ORDER BY assets) AS i, count(*) OVER (PARTITION BY party) AS n FROM fact WHERE won AND party IS NOT NULL AND {here}) GROUP BY party""",
        f"SELECT {_cells('party_seats', party='party', year='year', **seat)} FROM (SELECT w.* REPLACE (coalesce(party, 'IND') AS party, y.year AS year), w.year = y.year AS hit FROM {winners} w CROSS JOIN (SELECT DISTINCT year FROM {winners}) y) GROUP BY party, year".replace("w.year = y.year AND", "hit AND").replace("(WHERE w.year = y.year)", "(WHERE hit)"),
        f"""SELECT {_cells('party_wealth', party='party', year='year', **seat)} FROM (SELECT w.* REPLACE (y.year AS year), w.year = y.year AS hit FROM {winners} w CROSS JOIN (SELECT DISTINCT year FROM {winners}) y
  WHERE party IN (SELECT party FROM {winners} WHERE party IS NOT NULL GROUP BY party ORDER BY sum(assets) DESC, party LIMIT 5)) GROUP BY party, year""".replace("w.year = y.year AND", "hit AND").replace("(WHERE w.year = y.year)", "(WHERE hit)"),
        f"SELECT {_cells('india_states', state='state', **sums)} FROM current_by_state GROUP BY state",
        f"SELECT {_cells('zones', label='zone', **zone)} FROM current_by_state WHERE zone IS NOT NULL GROUP BY zone",
        f"SELECT {_cells('scatter', **point)} FROM latest_all WHERE {here}",
        f"SELECT {_cells('tiles', **point)} FROM latest_assembly WHERE {here}",
        f"SELECT {_cells('dots_by_year', **point)} FROM fact WHERE won AND house = 'Assembly' AND {here}",
        f"SELECT {_cells('unique_constituencies', count='count(DISTINCT (state, house, constituency))')} FROM fact",
        f"SELECT {_cells('facts', pos='row_number() OVER (ORDER BY p) - 1', label='fact')} FROM u WHERE fact IS NOT NULL"]
    return f"""WITH {FACT},
latest_house AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY politician_id ORDER BY year DESC) AS rk FROM fact WHERE house = '{house}') WHERE rk = 1),
current_house AS (SELECT * FROM fact WHERE house = '{house}' AND won AND {here} AND year = (SELECT max(year) FROM fact WHERE house = '{house}' AND {here})),
shown AS (SELECT * {'FROM current_house' if scope == 'current' else f'EXCLUDE (rk) FROM latest_house WHERE {here}'}),
told AS (SELECT *, row_number() OVER (PARTITION BY politician_id ORDER BY year, appearance_id) AS i, count(*) OVER (PARTITION BY politician_id) AS n FROM fact WHERE house = '{house}' AND {here}),
ways AS (SELECT b.politician_id, b.name, b.constituency AS label, b.year AS last_year, b.party, a.assets AS from_inr, b.assets AS to_inr FROM told a JOIN told b USING (politician_id) WHERE a.i = 1 AND b.i = b.n AND b.n >= 2),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE cases > 0) AS c, count(*) FILTER (WHERE assets >= 10000000) AS r, min(year) AS y1, max(year) AS y2, count(DISTINCT year) AS ys, arg_max(name, (assets, -appearance_id)) AS wn, max(assets) AS wx,
  arg_max(name, (cases, -appearance_id)) AS cn, max(cases) AS cx FROM latest_all WHERE {here}),
g AS (SELECT count(*) - count(DISTINCT politician_id) AS again FROM fact),
u AS (SELECT unnest([
  'The wealthiest member on record is ' || wn || ' with declared assets of ' || CAST(wx // 10000000 AS VARCHAR) || ' crore.',
  CAST(CAST(floor(CAST(c * 100 AS DOUBLE) / n + 0.5) AS BIGINT) AS VARCHAR) || '% of members on record have at least one declared criminal case.',
  CASE WHEN cx > 0 THEN cn || ' faces the most pending criminal cases: ' || CAST(cx AS VARCHAR) || '.' END,
  CAST(CAST(floor(CAST(r * 100 AS DOUBLE) / n + 0.5) AS BIGINT) AS VARCHAR) || '% of members are crorepatis.',
  'The data covers elections from ' || CAST(y1 AS VARCHAR) || ' to ' || CAST(y2 AS VARCHAR) || ': ' || CAST(ys AS VARCHAR) || ' cycles.',
  CASE WHEN again > 0 THEN CAST(again AS VARCHAR) || ' entries are of politicians who stood more than once.' END]) AS fact, unnest(range(6)) AS p FROM s CROSS JOIN g)
{ranked} UNION ALL {' UNION ALL '.join(rest)}"""


_register("home_page", lambda s, d: home.home(model.from_driver(s, d), state="NATION_7"), _home_sql("Assembly", "current", "NATION_7"))
_register("home_page_all", lambda s, d: home.home(model.from_driver(s, d), house="LokSabha", scope="all"), _home_sql("LokSabha", "all", None))

# --- landed files ---

_LANDED = "custkey long, orderkey long, status string, cents long"


def _landed(spark: SparkSession, d: str, name: str) -> tuple[Scratch, DataFrame]:
    """Orders as lines of files, cut anew by hash, so that a customer's lines are in several files in any order."""
    rows = model.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return Scratch(spark, name), rows


def landing_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest order, from files landed batch by batch in a table of the commit log."""
    scratch, rows = _landed(spark, d, "landing")
    rows.repartition(6, "orderkey").write.json(f"{scratch.root}/in")
    log = Log(spark, f"{scratch.root}/log")
    landing.land_upsert(spark, f"{scratch.root}/in", _LANDED, log, "newest", ["custkey"], ["orderkey"], f"{scratch.root}/done", files=2)
    return log.read("newest", _LANDED)


_register("landing_upsert", landing_upsert, """SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) AS cents FROM orders GROUP BY o_custkey""")


def manifest_state(spark: SparkSession, d: str) -> DataFrame:
    """Each address's last manifest line by streaming state, files in order of their names."""
    scratch, rows = _landed(spark, d, "manifest")
    lines = rows.select(F.concat(F.lit("https://x.org/"), F.col("custkey").cast("string")).alias("profile_url"), F.col("orderkey").cast("string").alias("affidavit_id"), "status", (F.col("orderkey") % 3 == 0).alias("download_succeeded"), "orderkey")
    lines.repartitionByRange(4, "orderkey").sortWithinPartitions("orderkey").drop("orderkey").write.json(f"{scratch.root}/in")
    log = Log(spark, f"{scratch.root}/log")
    landing.follow_manifest(spark, f"{scratch.root}/in", log, "manifest", f"{scratch.root}/done", files=2)
    return log.read("manifest", landing.STATE).select("profile_url", "affidavit_id", "status", "download_succeeded")


_register("manifest_state", manifest_state, """SELECT 'https://x.org/' || o_custkey AS profile_url, CAST(max(o_orderkey) AS VARCHAR) AS affidavit_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) % 3 = 0 AS download_succeeded FROM orders GROUP BY o_custkey""")

# --- targets ---

_SLUGS = ("Goa2022", "goa2017", "goa2012", "goa2007", "Delhi2025")


def _loaded(spark: SparkSession, d: str) -> Log:
    """Customers as candidates of five elections; those with an even key have won. One state is loaded, then its winners' pages."""
    slug = F.get(F.array(*[F.lit(x) for x in _SLUGS]), (F.col("slug").cast("int") % len(_SLUGS)).cast("int"))
    pages = catalog._listing_pages(spark, d)
    scratch = Scratch(spark, "targets")
    listings = scratch.write(pages.select(slug.alias("slug"), "page", "html"), "listings")
    everyone = scratch.write(html_tables.candidates(html_tables.table_rows(listings)).select("slug", "candidate_id", "name"), "everyone")
    won = F.concat(F.lit("<table><tr><th>Sno</th><th>Candidate</th><th>Constituency</th></tr>"), F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit('<tr><td>1</td><td><a href="/c.php?candidate_id='), F.col("candidate_id").cast("string"), F.lit('">'), "name", F.lit("</a></td><td>X</td><td>ALPHA</td><td>0</td><td>Graduate</td><td>Rs 5</td><td>Rs 1</td></tr>")))), ""), F.lit("</table>"))
    winners = everyone.where("candidate_id % 2 = 0").groupBy("slug", F.floor(F.col("candidate_id") / catalog._PAGE_KEYS).alias("part")).agg(won.alias("html")).select("slug", F.lit(1).alias("page"), "html")
    log = Log(spark, f"{scratch.root}/log")
    jobs.run_target(log, "goa_all", listings, scratch.write(winners, "winners"))
    own = catalog_rows._candidate_pages(spark, d).select(F.col("slug").cast("int").alias("candidate_id"), "html")
    own = own.join(everyone.select(F.col("slug").alias("election"), "candidate_id").distinct(), "candidate_id")
    jobs.run_target(log, "goa_detail", own)
    return log


_OF = f"(SELECT c_custkey AS k, {list(_SLUGS)}[c_nationkey % {len(_SLUGS)} + 1] AS election, c_name FROM customer WHERE c_custkey > 0)"
_register("target_all", lambda s, d: _loaded(s, d).read("appearances", jobs.FACTS).select("election", "candidate_id", "name", "won"),
          f"SELECT election, CAST(k AS INTEGER) AS candidate_id, c_name AS name, k % 2 = 0 AS won FROM {_OF} WHERE election <> 'Delhi2025'")
_register("target_detail", lambda s, d: _loaded(s, d).read("enriched", jobs.ENRICHED), f"""SELECT election || '/' || k AS appearance_id, CAST(CASE WHEN k % 130 BETWEEN 18 AND 110 THEN k % 130 END AS INTEGER) AS age, 'Farmer' AS profession,
  k * 1000 AS movable_assets_inr, CAST(NULL AS BIGINT) AS immovable_assets_inr, CAST(nullif(k % 4, 0) AS INTEGER) AS serious_cases_count FROM {_OF} WHERE election <> 'Delhi2025' AND k % 2 = 0""")

# --- saved crawls as data sources ---


def manifest_source(spark: SparkSession, d: str) -> DataFrame:
    """Orders as manifest lines, some broken, read by the data source with a filter that it takes over, and counted."""
    scratch, rows = _landed(spark, d, "lines")
    line = F.to_json(F.struct(F.col("custkey").cast("string").alias("profile_url"), "status", F.col("orderkey").cast("string").alias("affidavit_id")))
    lines = rows.select(F.when(F.col("orderkey") % 50 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    lines.write.option("lineSep", "\n").text(f"{scratch.root}/in")
    renamed, cls = filesystem(spark, f"{scratch.root}/in")
    for s in renamed.listStatus(cls(f"{scratch.root}/in")):  # the source reads .jsonl
        name = s.getPath().getName()
        if name.endswith(".txt"):
            renamed.rename(s.getPath(), cls(f"{scratch.root}/in/{name[:-4]}.jsonl"))
    readers.register(spark)
    load = lambda: spark.read.format("manifest").option("push", True).load(f"{scratch.root}/in")  # noqa: E731 - one frame for each pushed filter
    kept = load().where("status = 'F'").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("profile_url").alias("people"), F.max(F.col("affidavit_id").cast("long")).alias("last"))
    broken = load().where("error is not null").agg(F.count("*").alias("n")).select(F.lit("broken").alias("status"), "n", F.lit(None).cast("long").alias("people"), F.lit(None).cast("long").alias("last"))
    return kept.unionByName(broken)


_register("manifest_source", manifest_source, """SELECT 'F' AS status, count(*) AS n, count(DISTINCT o_custkey) AS people, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 50 <> 0
UNION ALL SELECT 'broken', count(*), NULL, NULL FROM orders WHERE o_orderkey % 50 = 0""")
