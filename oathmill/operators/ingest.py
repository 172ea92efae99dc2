"""Idempotent loads: natural-key dimensions, upserts, enrichment, re-keying, repairs. Frames in, frames out; the caller writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oathmill.functions import names
from oathmill.functions.money import safe_inr


def get_or_create(dim: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The dimension with a row for each new natural key. New ids follow the largest old one, in key order: each range of
    keys numbers its own rows from the counts of the ranges before it, so no task sees all."""
    fresh = incoming.select(*key).distinct().join(dim, key, "left_anti")
    return dim.unionByName(_numbered(fresh, key, dim, "id"), allowMissingColumns=True)


def _numbered(rows: DataFrame, order: list[str], existing: DataFrame, name: str) -> DataFrame:
    dealt = rows.withColumn("b_", F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int"))
    counts = dealt.groupBy("b_").agg(F.count("*").alias("c_"))
    before = counts.select("b_", (F.sum("c_").over(Window.orderBy("b_")) - F.col("c_")).alias("before_"))  # 1024 rows at most
    top = existing.agg(F.coalesce(F.max(name), F.lit(0)).alias("top_")).withColumn("k_", F.lit(1))
    nth = F.row_number().over(Window.partitionBy("b_").orderBy(*order))
    out = dealt.join(F.broadcast(before), "b_").withColumn("k_", F.lit(1)).join(F.broadcast(top), "k_")
    return out.withColumn(name, (F.col("top_") + F.col("before_") + nth).cast(existing.schema[name].dataType)).drop("b_", "before_", "top_", "k_")


def upsert_appearances(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key (election, candidate_id): new facts replace old ones, a win is never taken back. The last new row of a key counts
    (by ``seq``); loading a batch twice changes nothing."""
    key = ["election", "candidate_id"]
    facts = [c for c in old.columns if c not in key]
    batch = new.groupBy(*key).agg(*[F.max_by(c, "seq").alias(c) for c in facts if c != "won"], F.bool_or(F.coalesce("won", F.lit(False))).alias("won"))
    both = old.alias("o").join(batch.alias("n"), key, "full")
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c != "won" else (F.coalesce("o.won", F.lit(False)) | F.coalesce("n.won", F.lit(False))).alias("won") for c in facts]
    return both.select(*key, *pick)


def flag_winners(everyone: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """All candidates, ``won`` where the key is among the winners."""
    hit = winners.select(*key).distinct().withColumn("hit_", F.lit(True))
    return everyone.join(hit, key, "left").withColumn("won", F.col("hit_").isNotNull()).drop("hit_")


def not_enriched(appearances: DataFrame, children: DataFrame, force: bool = False) -> DataFrame:
    return appearances if force else appearances.join(children.select("appearance_id").distinct(), "appearance_id", "left_anti")


def enrich(appearances: DataFrame, details: DataFrame) -> DataFrame:
    """Fill age and profession where empty; take totals that are not 0 and sensible."""
    d = details.select("appearance_id", *[F.col(c).alias(f"d_{c}") for c in ("age", "profession", "movable_assets_inr", "immovable_assets_inr", "serious_cases_count")])
    rows = appearances.join(d, "appearance_id", "left")
    total = lambda c: F.coalesce(F.nullif(safe_inr(F.col(f"d_{c}")), F.lit(0)), F.col(c))
    return rows.select(
        *[c for c in appearances.columns if c not in ("age", "profession", "movable_assets_inr", "immovable_assets_inr", "serious_cases_count")],
        F.coalesce("age", "d_age").alias("age"), F.coalesce(F.nullif("profession", F.lit("")), "d_profession").alias("profession"), total("movable_assets_inr").alias("movable_assets_inr"),
        total("immovable_assets_inr").alias("immovable_assets_inr"), F.coalesce(F.nullif("d_serious_cases_count", F.lit(0)), "serious_cases_count").alias("serious_cases_count"))


def replace_children(old: DataFrame, new: DataFrame, value: str | None = None) -> DataFrame:
    """Child rows of appearances that have new ones are replaced; others stay. Null and 0 values are not taken."""
    fresh = new.where(F.coalesce(safe_inr(F.col(value)), F.lit(0)) != 0) if value else new
    return old.join(fresh.select("appearance_id").distinct(), "appearance_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_missing(dst: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    """Bulk load that leaves rows with a known key alone; of repeated new keys one row is taken."""
    order = Window.partitionBy(*key).orderBy(*[c for c in src.columns if c not in key] or key)
    once = src.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")
    return dst.unionByName(once.join(dst.select(*key), key, "left_anti"), allowMissingColumns=True)


#: What each table's columns refer to.
REFERENCES = {
    "states": {}, "parties": {}, "politicians": {}, "constituencies": {"state_id": "states"}, "elections": {"state_id": "states"},
    "election_appearances": {"politician_id": "politicians", "election_id": "elections", "constituency_id": "constituencies", "party_id": "parties"},
    "assets": {"appearance_id": "election_appearances"}, "liabilities": {"appearance_id": "election_appearances"}, "criminal_cases": {"appearance_id": "election_appearances"},
}


def dependency_order(references: dict[str, dict[str, str]]) -> list[str]:
    """Tables with those they refer to before them; by name where either could come first."""
    out: list[str] = []
    while len(out) < len(references):
        ready = sorted(t for t, refs in references.items() if t not in out and set(refs.values()) <= set(out) | {t})
        if not ready:
            raise ValueError("tables refer to each other in a circle")
        out += ready
    return out


def bulk_copy(src: dict[str, DataFrame], dst: dict[str, DataFrame], reset: bool = False, references: dict[str, dict[str, str]] = REFERENCES) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """Copy all tables, parents before children: (tables after, rows rejected, next free id of each).

    Rows with a known id are left alone, so a copy may be repeated. A row that refers to no row of the table after its own copy is
    rejected, and with it whatever refers to it in turn; null references are none. ``reset`` starts from empty tables. A
    table that the source lacks stays; one that only the source has is not made. Rows that repeat an id count once.
    """
    after, rejected, following = {}, {}, {}
    for name in dependency_order(references):
        if name not in dst:
            continue
        old = dst[name].limit(0) if reset else dst[name]
        rows = src[name] if name in src else old.limit(0)
        fresh = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct(*rows.columns)).alias("r")).select("r.*").join(old.select("id"), "id", "left_anti")
        lost = F.lit(False)
        for column, parent in references[name].items():
            if column in rows.columns and parent in after:
                held = after[parent].select(F.col("id").alias(f"held_{column}"))
                fresh = fresh.join(held, F.col(column) == F.col(f"held_{column}"), "left")
                lost = lost | (F.col(column).isNotNull() & F.col(f"held_{column}").isNull())
        marked = fresh.withColumn("lost_", lost)
        rejected[name] = marked.where("lost_").select(*rows.columns)
        after[name] = old.unionByName(marked.where("not lost_").select(*[c for c in rows.columns if c in old.columns]), allowMissingColumns=True)
        following[name] = after[name].agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
    return after, rejected, following


def split_merged(appearances: DataFrame, politicians: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One politician per (election slug, candidate id) of the source address: (politicians, appearances with the new ids).
    The longest name of a group stays (the first by id); ids start over above the largest."""
    slug, cid = names.source_url_parts(F.col("source_url"))
    rows = appearances.withColumns({"election_slug": slug, "candidate_id": cid}).where("election_slug is not null and candidate_id is not null")
    named = rows.join(politicians.select(F.col("id").alias("politician_id"), "name"), "politician_id", "left")
    group = named.groupBy("election_slug", "candidate_id").agg(F.min_by("name", F.struct(-F.char_length(F.coalesce("name", F.lit(""))), F.col("politician_id"))).alias("name"))
    made = _numbered(group, ["election_slug", "candidate_id"], politicians, "id")
    base = F.coalesce(F.nullif(names.slugify(F.col("name")), F.lit("")), F.lit("candidate"))
    made = made.withColumn("slug", F.substring(F.concat(base, F.lit("-"), F.lower("election_slug"), F.lit("-"), F.col("candidate_id").cast("string")), 1, 240))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    made = made.withColumn("slug", names.numbered_slug(F.col("slug"), nth))
    moved = rows.drop("politician_id").join(made.select("election_slug", "candidate_id", F.col("id").alias("politician_id")), ["election_slug", "candidate_id"])
    return made, moved.select(*appearances.columns)


def repair_slugs(politicians: DataFrame) -> DataFrame:
    """Every slug filled and unique: the first row of a slug keeps it; empty and later ones get name slugs that no row has."""
    base = F.coalesce(F.nullif(F.substring(names.slugify(F.col("name")), 1, 200), F.lit("")), F.concat(F.lit("politician-"), F.col("id").cast("string")))
    blank = F.coalesce("slug", F.lit("")) == ""
    first = politicians.where(~blank).groupBy("slug").agg(F.min("id").alias("first_"))
    known = politicians.where(~blank).join(first, "slug").withColumn("keeps", F.col("id") == F.col("first_")).select(*politicians.columns, "keeps")
    rows = known.unionByName(politicians.where(blank).withColumn("keeps", F.lit(False))).withColumn("base", base)
    kept = rows.where("keeps").select(F.col("slug").alias("k"))
    broken = rows.where("not keeps").withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    # numbers that kept slugs of this base already use
    used = kept.select(F.regexp_replace("k", r"-\d+$", "").alias("b1"), F.col("k").alias("b2"), F.regexp_extract("k", r"-(\d+)$", 1).try_cast("int").alias("number"))
    used = used.select(F.col("b2").alias("base"), F.lit(1).alias("number")).unionByName(used.where("number > 1").select(F.col("b1").alias("base"), "number"))
    used = used.groupBy("base").agg(F.array_sort(F.collect_set("number")).alias("used"))
    broken = broken.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    # the nth free number: each used number at or under it pushes it up by one
    number = F.aggregate("used", F.col("nth"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    fixed = broken.withColumn("slug", names.numbered_slug(F.col("base"), number))
    return rows.where("keeps").select(*politicians.columns).unionByName(fixed.select(*politicians.columns))


def repair_names(politicians: DataFrame, source: DataFrame) -> DataFrame:
    """Blank names from a source keyed by (election, candidate_id), since candidate ids repeat between elections."""
    src = source.groupBy("election", "candidate_id").agg(F.max_by("name", F.char_length("name")).alias("source_name"))
    rows = politicians.join(src, ["election", "candidate_id"], "left")
    return rows.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "source_name")).select(*politicians.columns)


def add_missing_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns}) if set(wanted) - set(rows.columns) else rows


def relink(appearances: DataFrame, name: Column, state: Column) -> DataFrame:
    """An extension: one id per normalised (name, state), to follow people across elections."""
    return appearances.withColumn("person_id", F.xxhash64(names.person_key(name), F.coalesce(state, F.lit(""))))
