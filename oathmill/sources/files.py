"""Files in and out: manifests, page text, centroids, rosters, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.store import Scratch

MANIFEST = "name string, party string, status string, state string, constituency string, profile_url string, affidavit_id string, pdf_path string, download_attempted boolean, download_succeeded boolean, error string"
PAGE_DOC = "source_pdf string, page_count int, pages array<struct<page:int, method:string, text:string>>, stats struct<pages_pdfplumber:int, pages_easyocr:int, elapsed_seconds:double>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each address, over files in name order; blank lines and lines without an address are skipped."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = lines.select(F.from_json("value", MANIFEST).alias("r"), "file_path", "file_block_start", "n").where("coalesce(r.profile_url, '') <> ''")
    return rows.groupBy(F.col("r.profile_url").alias("u")).agg(F.max_by("r", F.struct("file_path", "file_block_start", "n")).alias("r")).select("r.*")


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.where("download_succeeded").select("profile_url"), "profile_url", "left_anti")


def with_status(rows: DataFrame, wanted: tuple[str, ...], keep_unknown: bool = False) -> DataFrame:
    """Rows of the wanted statuses in any case; "all" keeps every row."""
    low = F.lower(F.coalesce("status", F.lit("")))
    if "all" in wanted:
        return rows
    return rows.where(low.isin(*[w.lower() for w in wanted]) | (F.lit(keep_unknown) & (low == "")))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("(blank)")).alias("status")).agg(F.count("*").alias("n"))


def crawl_dedupe(rows: DataFrame) -> DataFrame:
    """rows (page, pos, profile_url, affidavit_id and any others): what a crawl in order of (page, pos) keeps, which passes over a row
    if a kept one before it has its address or its affidavit id; blank ids never meet, null addresses are one address.

    Rounds: rows that are the first of both their keys are kept, those that share a key with a kept one go, and the rest
    is looked at again. Of rows with one pair of keys only the first can be kept. The first row of all is first on both keys,
    so every round keeps one at least; in practice a few rounds do. Each round is a table in the shared folder.
    """
    scratch = Scratch(rows.sparkSession, "crawl")
    at = F.struct("page", "pos")
    pairs = rows.groupBy(F.coalesce("profile_url", F.lit("")).alias("u"), F.coalesce("affidavit_id", F.lit("")).alias("f")).agg(F.min(at).alias("at"), F.min_by(F.struct(*rows.columns), at).alias("row"))
    pairs = scratch.write(pairs, "pairs")
    open_, kept, turn = pairs.drop("row"), None, 0
    while turn == 0 or not open_.isEmpty():
        turn += 1
        named = open_.where("f <> ''")
        by_url = open_.groupBy("u").agg(F.min("at").alias("first_u"))
        by_id = named.groupBy("f").agg(F.min("at").alias("first_f"))
        seen = open_.join(by_url, "u")
        first = seen.where("f = ''").withColumn("k", F.col("at") == F.col("first_u")).select("u", "f", "at", "k")
        both = seen.where("f <> ''").join(by_id, "f").withColumn("k", (F.col("at") == F.col("first_u")) & (F.col("at") == F.col("first_f")))
        marked = scratch.write(first.unionByName(both.select("u", "f", "at", "k")), f"marked{turn}")
        now = marked.where("k").select("u", "f", "at")
        kept = now if kept is None else kept.unionByName(now)
        left = marked.where("not k").drop("k").join(now.select("u"), "u", "left_anti")
        taken = now.where("f <> ''").select("f")
        left = left.where("f = ''").unionByName(left.where("f <> ''").join(taken, "f", "left_anti"))
        open_ = scratch.write(left, f"open{turn}")
    return pairs.join(kept.select("u", "f"), ["u", "f"], "left_semi").select("row.*")


def page_docs(spark: SparkSession, path: str) -> DataFrame:
    """Page-text documents, one JSON file each; Spark itself skips names that begin with an underscore. Broken files have a
    null source_pdf and their text in _corrupt."""
    return spark.read.schema(f"{PAGE_DOC}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def centroids(spark: SparkSession, path: str) -> DataFrame:
    """A flat map of names to {lat, lng}, or one nested by state; both give name, lat, lng."""
    text = spark.read.text(path, wholetext=True)
    flat = text.select(F.explode(F.from_json("value", "map<string, struct<lat:double, lng:double>>")).alias("name", "at"))
    nested = text.select(F.explode(F.from_json("value", "map<string, map<string, struct<lat:double, lng:double>>>")).alias("state", "m")).select(F.explode("m").alias("name", "at"))
    rows = flat.unionByName(nested).where("at.lat is not null and at.lng is not null")
    return rows.select("name", "at.lat", "at.lng")


def geojson_names(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The named property of each feature; a file that is no feature collection gives no rows."""
    text = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "type string, features array<struct<properties:map<string, string>>>")
    return text.select(doc.alias("d")).where("d.type = 'FeatureCollection'").select(F.explode("d.features").alias("f")).select(F.try_element_at("f.properties", F.lit(key)).alias("name"))


def first_option(options: DataFrame, wanted: str) -> DataFrame:
    """options (position, label, value): the first whose label holds the text in any case; placeholders (no value) are skipped."""
    hit = options.where((F.coalesce("value", F.lit("")) != "") & F.contains(F.lower("label"), F.lit(wanted.lower())))
    return hit.orderBy("position").limit(1)


def with_page(url: Column, page: Column) -> Column:
    """The address with its page parameter set."""
    number = page.cast("string")
    replaced = F.regexp_replace(url, r"([?&])page=\d*", "$1page=" + "\u0001")
    added = F.concat(url, F.when(F.contains(url, F.lit("?")), "&page=").otherwise("?page="), number)
    return F.when(url.rlike(r"[?&]page=\d*"), F.replace(replaced, F.lit("\u0001"), number)).otherwise(added)


def write_csv(rows: DataFrame, path: str) -> None:
    """Report with a header; list columns joined by "; "."""
    lists = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    rows.withColumns({c: F.array_join(c, "; ") for c in lists}).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def field_comparison(rows: DataFrame, fields: list[str], a: str, b: str) -> DataFrame:
    """Long form of two sources: key, field, value in a and b, verdict. Columns are <field>_<a> and <field>_<b>."""
    cell = lambda c: F.col(c).cast("string")
    items = F.array(*[F.struct(F.lit(f).alias("field"), cell(f"{f}_{a}").alias(a), cell(f"{f}_{b}").alias(b)) for f in fields])
    out = rows.select("key", F.explode(items).alias("x")).select("key", "x.*")
    return out.withColumn("verdict", F.when(F.col(a).isNull() | F.col(b).isNull(), "MISSING").when(F.col(a) == F.col(b), "SAME").otherwise("DIFFERENT"))
