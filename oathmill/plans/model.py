"""The logical model: typed tables of candidates, elections and declarations, and an adapter onto the driver's tables.

Every analytic reads one wide fact, ``appearances``: appearance_id, politician_id,
name, slug, state, zone, house, year, constituency, party, won, assets, cases.
``from_tables`` builds it from normalised tables with broadcast dimensions;
``from_driver`` projects the same shape out of the star schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oathmill.functions import names

CRORE, LAKH = 10_000_000, 100_000

SCHEMAS = {
    "states": "id int, name string, code string",
    "parties": "id int, short_name string, full_name string",
    "constituencies": "id int, name string, state_id int, house string, reserved_for string",
    "elections": "id int, year int, house string, state_id int, slug string",
    "politicians": "id int, name string, slug string, candidate_id int, photo_url string, dob string, gender string, age int, profession string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "election_appearances": "id int, politician_id int, election_id int, constituency_id int, party_id int, age int, education string, profession string, won boolean, votes_received int, vote_share_pct double, total_assets_inr bigint, total_liabilities_inr bigint, movable_assets_inr bigint, immovable_assets_inr bigint, criminal_cases_count int, serious_cases_count int, source_url string, scraped_at timestamp_ntz",
    "assets": "id int, appearance_id int, category string, subcategory string, description string, value_inr bigint",
    "liabilities": "id int, appearance_id int, creditor string, description string, amount_inr bigint",
    "criminal_cases": "id int, appearance_id int, ipc_sections string, description string, case_number string, court string, charges_framed boolean, is_serious boolean, status string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to four tasks a core: a small file is one task, however long the work on each of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def from_tables(tables: dict[str, DataFrame], zones: DataFrame | None = None) -> DataFrame:
    """The wide fact from normalised tables; dimensions are left joins, so rows without a party, seat or state stay."""
    a, e = tables["election_appearances"].alias("a"), tables["elections"].alias("e")
    p, s, c, pol = (tables[t].alias(n) for t, n in (("parties", "p"), ("states", "s"), ("constituencies", "c"), ("politicians", "pol")))
    wide = (
        a.join(e, F.col("a.election_id") == F.col("e.id"))
        .join(pol, F.col("a.politician_id") == F.col("pol.id"), "left")
        .join(s, F.col("e.state_id") == F.col("s.id"), "left")
        .join(p, F.col("a.party_id") == F.col("p.id"), "left")
        .join(c, F.col("a.constituency_id") == F.col("c.id"), "left")
    )
    out = wide.select(
        F.col("a.id").cast("long").alias("appearance_id"), F.col("a.politician_id").cast("long").alias("politician_id"), F.col("pol.name").alias("name"), F.col("pol.slug").alias("slug"),
        F.col("s.name").alias("state"), F.col("e.house").alias("house"), F.col("e.year").alias("year"), F.col("c.name").alias("constituency"), F.col("p.short_name").alias("party"),
        F.col("a.won").alias("won"), F.col("a.total_assets_inr").alias("assets"), F.col("a.criminal_cases_count").cast("long").alias("cases"), F.col("pol.candidate_id").alias("candidate_id"))
    if zones is None:
        return out.withColumn("zone", F.lit(None).cast("string"))
    return out.join(F.broadcast(zones.select("state", "zone")), "state", "left")  # a registry row per state


def elections(tables: dict[str, DataFrame]) -> DataFrame:
    """state, house, year of every election, with appearances or without."""
    e, s = tables["elections"], tables["states"].select(F.col("id").alias("state_id"), F.col("name").alias("state"))
    return e.join(s, "state_id", "left").select("state", "house", "year")


def normalised(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star schema as normalised tables: what ``from_driver`` reads, before it is joined, with one more election (2050) that nobody stood in yet."""
    orders = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "house": F.when(F.col("o_orderkey") % 10 == 0, "LokSabha").otherwise("Assembly")})
    orders = orders.groupBy("o_custkey", "year", "house").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey").alias("r")).select("o_custkey", "year", "house", "r.*")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n"))
    rows = rows.join(cases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    number = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(2**31 - 1))).cast("int")  # noqa: E731 - ids of dimensions by hash
    held = rows.select("year", "house", "c_nationkey").distinct()
    later = table(spark, sf_dir, "nation").select(F.lit(2050).alias("year"), F.lit("Assembly").alias("house"), F.col("n_nationkey").alias("c_nationkey"))
    held = held.unionByName(later).distinct()
    seats = people.select("c_nationkey", "c_mktsegment").distinct()
    tables = {
        "states": table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"), F.lit(None).alias("code")),
        "parties": rows.where("o_orderpriority <> '4-NOT SPECIFIED'").select("o_orderpriority").distinct().select(number("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("short_name")),
        "constituencies": seats.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(number("c_nationkey", "c_mktsegment").alias("id"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"), (F.col("c_nationkey") + 1).alias("state_id")),
        "elections": held.select(number("year", "house", "c_nationkey").alias("id"), "year", "house", (F.col("c_nationkey") + 1).alias("state_id")),
        "politicians": people.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), names.slugify(F.col("c_name")).alias("slug"), (F.col("c_custkey") + 500_000).alias("candidate_id")),
        "election_appearances": rows.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("politician_id"), number("year", "house", "c_nationkey").alias("election_id"), number("c_nationkey", "c_mktsegment").alias("constituency_id"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", number("o_orderpriority")).alias("party_id"), (F.col("o_orderstatus") != "P").alias("won"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total_assets_inr"), F.coalesce("n", F.lit(0)).alias("criminal_cases_count")),
        "assets": asset_rows(spark, sf_dir).select("appearance_id", "category", "subcategory", "value_inr"),
    }
    return {name: _typed(rows, name) for name, rows in tables.items()}


def _typed(rows: DataFrame, name: str) -> DataFrame:
    """The table's columns; those that are absent are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def from_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for politicians, orders for appearances, nations for states, regions for zones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    orders = orders.withColumn("house", F.when(F.col("o_orderkey") % 10 == 0, "LokSabha").otherwise("Assembly"))
    newest = Window.partitionBy("o_custkey", "year", "house").orderBy(F.desc("o_orderkey"))
    orders = orders.withColumn("n", F.row_number().over(newest)).where("n = 1")
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("cases"))
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    people = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(cases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("appearance_id"), F.col("o_custkey").alias("politician_id"), F.col("c_name").alias("name"), names.slugify(F.col("c_name")).alias("slug"),
        F.col("n_name").alias("state"), F.col("r_name").alias("zone"), "house", F.col("year").cast("int").alias("year"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("constituency"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("party"), (F.col("o_orderstatus") != "P").alias("won"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("assets"), F.coalesce("cases", F.lit(0)).cast("long").alias("cases"))


def asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """appearance_id, category, subcategory, value_inr."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("appearance_id"), F.when(F.col("l_linestatus") == "O", "movable").otherwise("immovable").alias("category"),
        F.col("p_type").alias("subcategory"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value_inr"))
