"""Loads as jobs: saved pages in, tables out.

``run_target`` is the command line's dispatch: a state's key loads its winners, ``<state>_all`` all candidates,
``<state>_detail`` and ``<state>_detail_all`` enrich winners or all from their own pages, ``punjab_ls`` loads the
members of parliament, who have always won, ``all`` every state. A target commits its tables to a commit log at once, so a lost run, or one
that another writer overtook, leaves whole versions. ``load_listings`` is the older form for one table, in numbered folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.operators import ingest
from oathmill.plans.commits import Change, Log, Snapshot
from oathmill.sources import html_tables, registry
from oathmill.store import Scratch

FACTS = "election string, candidate_id int, name string, constituency string, party string, education string, won boolean, assets long, liabilities long, cases int"


def listing_facts(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """Candidates of all pages in one pass, flagged by the winners' pages; ``seq`` orders repeated ones. Pages are parsed once: what is read
    more than once is written first, which also tells the planner its size."""
    scratch = Scratch(pages.sparkSession, "listings")
    everyone = scratch.write(html_tables.paged_candidates(scratch.write(html_tables.table_rows(pages), "rows")), "everyone")
    named = scratch.write(html_tables.candidates(html_tables.table_rows(winners)), "named")
    won = named.select("slug", "candidate_id")
    both = everyone.unionByName(named.join(everyone, ["slug", "candidate_id"], "left_anti"))
    rows = ingest.flag_winners(both, won, ["slug", "candidate_id"])
    return rows.select(F.col("slug").alias("election"), "candidate_id", "name", "constituency", "party", "education", "won", F.col("total_assets_inr").alias("assets"), F.col("total_liabilities_inr").alias("liabilities"), F.col("criminal_cases").alias("cases"), (-F.col("page")).alias("seq"))


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest complete version of a table, or an empty one."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName()[1:]) for s in (store.listStatus(base) if store.exists(base) else []) if store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.schema(schema).parquet(f"{root}/v{done[-1]}") if done else spark.createDataFrame([], schema)


def published(spark: SparkSession, root: str, version: int) -> bool:
    """Whether a version is complete."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def publish(spark: SparkSession, rows: DataFrame, root: str, version: int) -> None:
    """Write one version; it counts once Spark has put its success mark. A complete version is never written again."""
    if published(spark, root, version):
        raise ValueError(f"version {version} is published")
    rows.write.mode("overwrite").parquet(f"{root}/v{version}")


def load_listings(spark: SparkSession, pages: DataFrame, winners: DataFrame, root: str, version: int, reset: bool = False) -> None:
    """The job for one election, one state or all: whatever the pages hold. A version that is published stays as it is,
    so running it twice changes nothing."""
    if published(spark, root, version):
        return
    old = spark.createDataFrame([], FACTS) if reset else current(spark, root, FACTS)
    publish(spark, ingest.upsert_appearances(old, listing_facts(pages, winners)), root, version)


def targets(spark: SparkSession, name: str) -> DataFrame:
    """The cycles of a target: a state's key, or ``all``."""
    rows = registry.cycles(spark)
    return rows if name == "all" else rows.where(F.col("key") == name)


def load_target(spark: SparkSession, name: str, pages: DataFrame, winners: DataFrame, root: str, version: int, reset: bool = False) -> None:
    """The job for a target: the pages of its elections alone."""
    of = lambda rows: rows.join(F.broadcast(targets(spark, name).select("slug")), "slug", "left_semi")  # noqa: E731 - the registry is of fixed size
    load_listings(spark, of(pages), of(winners), root, version, reset)


# --- targets in a commit log ---

ENRICHED = "appearance_id string, age int, profession string, movable_assets_inr long, immovable_assets_inr long, serious_cases_count int"
ASSETS = "appearance_id string, category string, subcategory string, value_inr long"
CASES = "appearance_id string, ipc_sections string, description string, status string"
MODES = ("_detail_all", "_detail", "_all", "_ls", "")


def parse_target(name: str) -> tuple[str, str]:
    """(state's key or ``all``, mode) of a target's name; the mode is one of MODES. Only one state has parliamentary pages."""
    keys = {k for k, *_ in registry.STATES} | {"all"}
    mode = next((m for m in MODES if name.endswith(m) and name[: len(name) - len(m)] in keys), None)
    if mode is None or (mode == "_ls" and name != "punjab_ls"):
        raise ValueError(f"unknown target {name}; known are {', '.join(sorted(keys))}, each with {', '.join(m for m in MODES if m and m != '_ls')}, and punjab_ls")
    return name[: len(name) - len(mode)], mode


def appearance_id() -> Column:
    return F.concat_ws("/", "election", F.col("candidate_id").cast("string")).alias("appearance_id")


def _facts(found: DataFrame) -> DataFrame:
    """Listing rows as facts; a candidate's first page comes last, so it counts."""
    return found.select(F.col("slug").alias("election"), "candidate_id", "name", "constituency", "party", "education", "won", F.col("total_assets_inr").alias("assets"), F.col("total_liabilities_inr").alias("liabilities"), F.col("criminal_cases").alias("cases"), (-F.col("page")).alias("seq"))


def _enrichment(log: Log, at: Snapshot, wanted: DataFrame, pages: DataFrame, force: bool) -> Change:
    """Tables of the appearances (appearance_id) that are wanted, from their pages (election, candidate_id, html)."""
    assets, cases, known = log.read("assets", ASSETS, at), log.read("cases", CASES, at), log.read("enriched", ENRICHED, at)
    todo = ingest.not_enriched(wanted, assets, force)
    own = pages.select(appearance_id(), "html").join(todo, "appearance_id", "left_semi").select(F.col("appearance_id").alias("slug"), F.lit(1).alias("page"), "html")
    scratch = Scratch(log.spark, "details")
    own = scratch.write(own, "pages")
    rows = scratch.write(html_tables.table_rows(own), "rows")
    read = scratch.write(html_tables.details(own).select(F.col("slug").alias("appearance_id"), "age", "profession", F.col("movable_total_inr").alias("movable_assets_inr"), F.col("immovable_total_inr").alias("immovable_assets_inr"), F.col("serious_cases").alias("serious_cases_count")), "read")
    fresh = todo.join(known, "appearance_id", "left_anti").join(read.select("appearance_id"), "appearance_id", "left_semi")
    enriched = ingest.enrich(known.unionByName(fresh, allowMissingColumns=True), read)
    found = lambda df: df.withColumnRenamed("slug", "appearance_id").drop("page")
    return {"enriched": enriched, "assets": ingest.replace_children(assets, found(html_tables.detail_assets(rows)), "value_inr"), "cases": ingest.replace_children(cases, found(html_tables.detail_cases(rows)))}, {}


def run_target(log: Log, name: str, pages: DataFrame, winners: DataFrame | None = None, force: bool = False) -> Snapshot:
    """Load one target. pages: (slug, page, html) of listings, or (election, candidate_id, html) of candidates for the detail targets;
    winners: the listings of winners, for ``_all``. Running it again changes nothing but the version."""
    key, mode = parse_target(name)
    spark = log.spark
    slugs = F.broadcast(targets(spark, key).select("slug"))  # the registry is of fixed size
    of = lambda rows: rows.join(slugs, "slug", "left_semi")

    def change(at: Snapshot) -> Change:
        old = log.read("appearances", FACTS, at)
        if mode.startswith("_detail"):
            mine = of(old.withColumnRenamed("election", "slug")).withColumnRenamed("slug", "election")
            wanted = (mine if mode == "_detail_all" else mine.where("won")).select(appearance_id())
            return _enrichment(log, at, wanted, pages, force)
        if mode == "_all":
            new = listing_facts(of(pages), of(winners))
        else:  # pages of winners: all on them have won
            found = html_tables.candidates(html_tables.table_rows(pages if mode == "_ls" else of(pages)))
            if mode == "_ls":
                found = html_tables.near_names(found, registry.parliamentary_seats(spark))
            new = _facts(found.withColumn("won", F.lit(True)))
        return {"appearances": ingest.upsert_appearances(old, new)}, {}

    return log.update(change)
