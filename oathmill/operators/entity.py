"""Documents to candidates: grouping of filings, packaging, quality checks, parsing, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oathmill.functions import documents as D
from oathmill.functions import names
from oathmill.store import Scratch

RECON_STATUSES = ("MATCH", "CLOSE", "FLAG", "NO_DB_ROW", "PARSE_FAIL")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row. As plain ones the optimizer writes their expressions into every use of their fields."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def signature(path: Column, name: Column, party: Column, seat: Column) -> Column:
    """Candidate identity: file name and party, else read name and party, else seat and party, else the file alone."""
    file_name, party, name, seat = names.name_from_file(path), names.person_key(party), names.person_key(name), names.person_key(seat)
    key = lambda who: F.substring(F.sha2(F.concat(who, F.lit("|"), party), 256), 1, 16)
    out = F.when((file_name != "") & (party != ""), key(file_name)).when((name != "") & (party != ""), key(name)).when((seat != "") & (party != ""), key(seat))
    return out.otherwise(F.concat(F.lit("single_"), F.substring(F.sha2(path, 256), 1, 12)))


def drop_poisoned(records: DataFrame) -> DataFrame:
    """Records from which nothing was read go: no certificate, name or party."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return records.where(~(blank("estamp_cert") & blank("candidate_name") & blank("candidate_party")))


def filings(records: DataFrame) -> DataFrame:
    """signature, estamp_cert: files, bytes, the largest file (the first path on ties), whether it is the candidate's canonical filing."""
    return _filings(_signed(records))


def _signed(records: DataFrame) -> DataFrame:
    rows = _once(records, signature=signature(F.col("pdf_path"), F.col("candidate_name"), F.col("candidate_party"), F.col("candidate_constituency")))
    return rows.withColumn("estamp_cert", F.coalesce("estamp_cert", F.lit("")))


def _filings(rows: DataFrame, *more: Column) -> DataFrame:
    largest = F.min_by("pdf_path", F.struct(-F.col("file_size"), F.col("pdf_path")))
    out = rows.groupBy("signature", "estamp_cert").agg(F.count("*").alias("pdf_count"), F.sum("file_size").alias("total_bytes"), largest.alias("canonical_pdf"), *more)
    newest = Window.partitionBy("signature").orderBy(F.desc(D.cert_key(F.col("estamp_cert"))), F.desc("total_bytes"), "estamp_cert")
    return out.withColumn("filing", F.row_number().over(newest)).withColumn("is_canonical", F.col("filing") == 1)


def candidates(records: DataFrame) -> DataFrame:
    """One row per candidate: identity of the first record (by path), filings in order, canonical filing and file. Records are signed and
    dealt once: a filing carries its first record."""
    who = F.struct("candidate_name", "candidate_father", "candidate_party", "candidate_constituency")
    made = _filings(_signed(records), F.min("pdf_path").alias("first_"), F.min_by(who, "pdf_path").alias("who_")).groupBy("signature").agg(
        F.min_by("who_", "first_").alias("w"),
        F.array_sort(F.collect_list(F.struct("filing", "estamp_cert", "pdf_count", "canonical_pdf"))).alias("filings"),
        F.max(F.when(F.col("is_canonical"), F.col("estamp_cert"))).alias("canonical_cert"), F.max(F.when(F.col("is_canonical"), F.col("canonical_pdf"))).alias("canonical_pdf"))
    return made.select("signature", "w.*", "filings", "canonical_cert", "canonical_pdf")


def package(files: DataFrame) -> DataFrame:
    """files (path, size): per candidate prefix the largest file, its number in name order, the other ids by size."""
    rows = files.withColumns({"key": names.candidate_key(F.col("path")), "id": names.affidavit_id(F.col("path"))})
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "path", "id")))
    out = rows.groupBy("key").agg(by_size.alias("f")).select("key", F.col("f")[0]["path"].alias("canonical"), F.size("f").alias("n_files"), F.array_join(F.transform(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda x: x["id"]), "; ").alias("others"))
    return in_order(out, "key", "seq")


def in_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Number rows from 1 in order of ``key``: rows are dealt by ranges of the key and sorted there, each range numbers its own, and the
    counts of the ranges before it (a row per range) are added. No task sees all rows, or all that begin alike."""
    scratch = Scratch(rows.sparkSession, "ordered")
    dealt = scratch.write(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("at_", F.monotonically_increasing_id()), "dealt")
    split = {"range_": F.shiftright("at_", 33), "nth_": F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))}
    dealt = dealt.withColumns(split).drop("at_")
    counts = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    before = counts.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    return dealt.join(F.broadcast(before), "range_").withColumn(name, (F.col("before_") + F.col("nth_") + 1).cast("int")).drop("range_", "nth_", "before_")


def qc_report(pages: DataFrame) -> DataFrame:
    """pages (source_pdf, pages array<struct<page, method, text>>)."""
    text = F.array_join(F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return pages.select("source_pdf", D.qc(F.col("source_pdf"), text).alias("q")).select("source_pdf", "q.*")


def status_shares(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Count and percent of each status, absent ones with 0."""
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    dense = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string").join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return dense.withColumn("pct", F.coalesce(F.try_divide((F.col("n") * 100).cast("double"), total.cast("double")), F.lit(0.0)))


def parse_affidavits(docs: DataFrame) -> DataFrame:
    """docs (doc, pages array<string>): identity, counts, totals, with what each was read from as a confidence map."""
    rows = _once(docs, page_a=D.part_a_page(F.col("pages")), page_b=D.part_b_page(F.col("pages")), m=D.market_values(F.col("pages")))
    rows = _once(rows, a=D.part_a(F.col("page_a")), b=D.part_b(F.col("page_b")))
    sure = lambda key, got, level: F.when(got, F.create_map(F.lit(key), F.lit(level))).otherwise(F.create_map().cast("map<string,string>"))
    conf = F.map_concat(sure("name", F.col("a.name").isNotNull(), "high"), sure("party", F.col("a.party").isNotNull(), "high"), sure("age", F.col("a.age").isNotNull(), "high"), sure("constituency", F.col("a.constituency").isNotNull(), "high"),
                        sure("address", F.col("a.address").isNotNull(), "medium"), sure("phone", F.col("a.phone").isNotNull(), "medium"), sure("email", F.col("a.email").isNotNull(), "high"), sure("pending_cases", F.col("b.pending").isNotNull(), "high"),
                        sure("movable", F.col("b.movable_self").isNotNull(), "high"), sure("immovable", F.col("b.immovable_self").isNotNull(), "low"), sure("immovable_market", F.col("m.own").isNotNull() | F.col("m.spouse").isNotNull(), "high"))
    out = rows.select("doc", "a.*", F.col("b.pending").alias("pending"), F.col("b.convictions").alias("convictions"), "b.movable_self", "b.movable_spouse",
                      F.coalesce("m.own", "b.immovable_self").alias("immovable_self"), F.coalesce("m.spouse", "b.immovable_spouse").alias("immovable_spouse"), conf.alias("confidence"))
    total = D.sum_known(D.sum_known(F.col("movable_self"), F.col("movable_spouse")), D.sum_known(F.col("immovable_self"), F.col("immovable_spouse")))
    return out.withColumn("total_assets", total)


def stamp_metadata(covers: DataFrame) -> DataFrame:
    return covers.select("pdf_path", D.stamp(F.col("cover")).alias("s")).select("pdf_path", "s.*", D.stamp_time(F.col("s.issue_date")).alias("issue_dt"))


def _judged(rows: DataFrame) -> DataFrame:
    status = D.recon_status(F.col("db_assets"), F.col("read_assets"), F.col("db_cases"), F.col("read_cases"))
    gap = F.when(F.col("db_assets").isNotNull() & F.col("read_assets").isNotNull(), D.asset_gap(F.col("db_assets"), F.col("read_assets")))
    return rows.withColumns({"status": status, "asset_delta_pct": gap})


def reconcile(read: DataFrame, recorded: DataFrame) -> DataFrame:
    """read (name, read_assets, read_cases) against recorded (id, name, assets, cases): by person key, the smallest id of equals.
    Rows without a key meet nothing."""
    db = recorded.withColumn("key", names.person_key(F.col("name"))).where("key <> ''")
    db = db.groupBy("key").agg(F.min_by(F.struct("id", F.col("assets").alias("db_assets"), F.col("cases").alias("db_cases")), "id").alias("r")).select("key", "r.*")
    rows = read.withColumn("key", names.person_key(F.col("name")))
    met = rows.where("key <> ''").join(db, "key", "left").unionByName(rows.where("key = ''"), allowMissingColumns=True)
    return _judged(met)


def reconcile_scoped(read: DataFrame, recorded: DataFrame) -> DataFrame:
    """read (doc, name, year, state, read_assets, read_cases) against recorded (id, name, year, state, assets, cases): the candidate of that
    name in that year whose state holds the asked one (in any case, its words in order, with anything between them); of several
    the smallest id. Year and key block the join, so people of one name in other years or states do not meet.
    ``doc`` names a read row; rows without a key, year or state meet nothing."""
    rows = read.withColumn("key", names.person_key(F.col("name")))
    # equal questions have one answer, and of the recorded rows that are alike but for their ids the smallest counts: these meet, not the rows
    asked = rows.where("key <> '' and year is not null and coalesce(trim(state), '') <> ''").select("key", "year", "state").distinct()
    db = recorded.withColumn("key", names.person_key(F.col("name"))).where("key <> '' and year is not null")
    db = db.groupBy("key", "year", F.col("state").alias("held")).agg(F.min_by(F.struct("id", F.col("assets").alias("db_assets"), F.col("cases").alias("db_cases")), "id").alias("r"))
    fits = F.ilike(F.col("held"), F.concat(F.lit("%"), F.regexp_replace(F.trim("state"), r"\s+", "%"), F.lit("%")))
    found = asked.join(db, ["key", "year"]).where(fits).groupBy("key", "year", "state").agg(F.min_by("r", F.col("r.id")).alias("r"))
    found = found.select("key", "year", "state", "r.*")
    return _judged(rows.join(found, ["key", "year", "state"], "left"))


def flag_gate(summary: DataFrame, most_pct: float = 10.0) -> DataFrame:
    """Whether the share of FLAG is small enough."""
    return summary.where("status = 'FLAG'").select((F.col("pct") <= most_pct).alias("passes"), "pct")


#: What an extracted document must have.
REQUIRED = ("candidate", "election", "criminal", "assets", "liabilities", "abstract", "provenance")
EXTRACTED = "candidate struct<name:string,pan:string,age:int>, election struct<house:string,year:int,state:string>, criminal struct<pending_cases_count:int,convictions_count:int>, assets struct<movable:struct<self:struct<gross_total:bigint>,spouse:struct<gross_total:bigint>>,immovable:struct<self:struct<total:bigint>,spouse:struct<total:bigint>>>, liabilities struct<grand_total:bigint>, abstract struct<movable_self:bigint,movable_spouse:bigint,immovable_self:bigint,immovable_spouse:bigint>, provenance struct<source_pdf:string>, _corrupt string"


def validate_extracted(docs: DataFrame) -> DataFrame:
    """docs (doc, json): the problems of each document, '' if none; totals are held against the form's own summary."""
    x = F.from_json("json", EXTRACTED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = docs.withColumn("x", x)
    checks = [F.when(F.col("x._corrupt").isNotNull(), "not json")] + [F.when(F.col("x._corrupt").isNull() & F.col(f"x.{k}").isNull(), f"missing {k}") for k in REQUIRED]
    checks += [F.when(F.col("x.election.house").isNotNull() & ~F.col("x.election.house").isin("Assembly", "LokSabha", "RajyaSabha"), "unknown house")]
    checks += [F.when(F.col(f"x.{c}") < 0, f"negative {c}") for c in ("criminal.pending_cases_count", "criminal.convictions_count", "liabilities.grand_total")]
    part_a = D.sum_known(D.sum_known(F.col("x.assets.movable.self.gross_total"), F.col("x.assets.movable.spouse.gross_total")), D.sum_known(F.col("x.assets.immovable.self.total"), F.col("x.assets.immovable.spouse.total")))
    part_b = D.sum_known(D.sum_known(F.col("x.abstract.movable_self"), F.col("x.abstract.movable_spouse")), D.sum_known(F.col("x.abstract.immovable_self"), F.col("x.abstract.immovable_spouse")))
    checks.append(F.when(part_a != part_b, "totals differ"))
    return rows.select("doc", F.array_join(F.array_compact(F.array(*checks)), "; ").alias("problems"))
