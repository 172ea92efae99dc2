"""Saved listing and detail pages as rows. Only splitting HTML needs Python; everything after it is column expressions.

Pages come as a frame (slug, page, html); the network is out of scope. ``saved_pages``
reads files whose names are the sha1 of their address.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oathmill.functions import money, names

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset(("script", "style"))


class _Tables(HTMLParser):
    """Collects tables (rows of cells with text and links), the heading before each, and the page's own text."""

    def __init__(self, texts: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.texts = texts
        self.live: dict[int, dict] = {}
        self.seen = 0
        self.text: list[str] = []
        self.title: list[str] = []
        self.headings: list[str] = []
        self._open: list[dict] = []
        self._tags: list[str] = []
        self._last = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._open.append({"rows": [], "heading": self._last})
            self.live[self.seen] = self._open[-1]
            self.seen += 1
        elif self._open and tag == "tr":
            self._open[-1]["rows"].append([])
        elif self._open and tag in ("td", "th"):
            if not self._open[-1]["rows"]:
                self._open[-1]["rows"].append([])
            self._open[-1]["rows"][-1].append({"text": [], "links": [], "head": tag == "th"})
        elif tag == "a" and self._cell() is not None:
            self._cell()["links"].append({"href": dict(attrs).get("href") or "", "text": []})
        elif self.texts and tag in ("h2", "h3"):
            self.headings.append("")
        if tag not in _VOID:
            self._tags.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self._open:
            self._open.pop()
        if tag in self._tags:
            while self._tags.pop() != tag:
                pass

    def open_tables(self) -> list[dict]:
        return self._open

    def _cell(self) -> dict | None:
        rows = self._open[-1]["rows"] if self._open else []
        return rows[-1][-1] if rows and rows[-1] else None

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if not piece or (self._tags and self._tags[-1] in _UNSEEN):
            return
        if self.texts:
            if "title" in self._tags:
                self.title.append(piece)
            self.text.append(piece)
        if self._tags and self._tags[-1] in ("h2", "h3") and self.headings:
            self.headings[-1] += piece
        cell = self._cell()
        if cell is None:
            self._last = piece
            return
        cell["text"].append(piece)
        if "a" in self._tags and cell["links"]:
            cell["links"][-1]["text"].append(piece)


def parse(page: str) -> _Tables:
    """A page's own text, titles and headings."""
    out = _Tables(texts=True)
    out.feed(page)
    out.close()
    return out


_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])
_CELL = pa.struct([("text", pa.string()), ("links", pa.list_(_LINK))])
_ROWS = "slug string, page int, table_no int, row_no int, header string, heading string, cells array<struct<text:string, links:array<struct<href:string, text:string>>>>"


#: Characters of a page that the parser takes at a time; rows of tables, and pages with their texts, in an Arrow batch.
PIECE, ROWS, PAGES = 1 << 16, 1024, 64


def _pieces(page: str) -> Iterator[str]:
    """A page cut before table rows, so no text is cut."""
    begin = 0
    while begin < len(page):
        end = page.find("<tr", begin + PIECE)
        end = len(page) if end < 0 else end
        yield page[begin:end]
        begin = end


def _page_rows(page: str) -> Iterator[tuple]:
    """(table_no, row_no, header, heading, cells) of each table row. A row leaves once another has begun in its table or the table has ended,
    so what is held is about a piece of the page."""
    parser, done = _Tables(), {}

    def cell(c: dict) -> dict:
        return {"text": " ".join(c["text"]), "links": [{"href": x["href"], "text": " ".join(x["text"])} for x in c["links"]]}

    def ready(whole: bool) -> Iterator[tuple]:
        still = {id(t) for t in parser.open_tables()}
        for t in sorted(parser.live):
            table = parser.live[t]
            rows, ended = table["rows"], whole or id(table) not in still
            for row in rows[: len(rows) if ended else len(rows) - 1]:
                n, header = done.get(t, (0, None))
                if header is None:
                    header = " ".join(" ".join(c["text"]) for c in row).lower()
                done[t] = (n + 1, header)
                yield t, n, header, table["heading"], [cell(c) for c in row if not c["head"]]
            if ended:
                del parser.live[t]
                done.pop(t, None)
            elif rows:
                del rows[:-1]

    for piece in _pieces(page):
        parser.feed(piece)
        yield from ready(False)
    parser.close()
    yield from ready(True)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("slug", pa.string()), ("page", pa.int32()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("header", pa.string()), ("heading", pa.string()), ("cells", pa.list_(_CELL))]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])
    rows = []
    for batch in batches:
        for slug, page, raw in zip(*(batch.column(c) for c in ("slug", "page", "html")), strict=True):
            for row in _page_rows(raw.as_py() or ""):
                rows.append((slug.as_py(), page.as_py(), *row))
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def table_rows(pages: DataFrame) -> DataFrame:
    """A row per table row of each page, with the table's first row and the text before it."""
    return pages.select("slug", F.col("page").cast("int").alias("page"), "html").mapInArrow(_split, _ROWS)


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """html files as (sha1, html)."""
    rows = spark.read.format("text").option("wholetext", True).load(folder).select("value", "_metadata.file_name")
    return rows.select(F.regexp_extract("file_name", r"^(.*)\.html$", 1).alias("sha1"), F.col("value").alias("html"))


def cached(addresses: DataFrame, saved: DataFrame) -> DataFrame:
    """Addresses (url, ...) with their saved page."""
    return addresses.withColumn("sha1", F.sha1("url")).join(saved, "sha1").drop("sha1")


def candidates(rows: DataFrame) -> DataFrame:
    """Listing rows of eight cells or more: the candidate's link with text (else the first one), money, cases, by-elections."""
    rows = rows.where(F.contains("header", F.lit("candidate")) & F.contains("header", F.lit("constituency")) & (F.size("cells") >= 8))
    links = F.filter(F.get("cells", F.lit(1))["links"], lambda a: F.contains(a["href"], F.lit("candidate_id=")))
    rows = rows.withColumn("links", links).where(F.size("links") > 0)
    rows = rows.withColumn("link", F.coalesce(F.get(F.filter("links", lambda a: a["text"] != ""), F.lit(0)), F.get("links", F.lit(0))))
    seat, cell = F.get("cells", F.lit(2))["text"], lambda i: F.get("cells", F.lit(i))["text"]
    by = F.contains(seat, F.lit(":")) | F.contains(F.lower("heading"), F.lit("bye"))
    out = rows.select(
        "slug", "page", "table_no", "row_no", money.candidate_id(F.col("link.href")).alias("candidate_id"), F.coalesce(F.nullif(F.trim("link.text"), F.lit("")), F.nullif(F.trim(cell(1)), F.lit(""))).alias("name"),
        F.trim(F.split_part(seat, F.lit(":"), F.lit(1))).alias("constituency"), cell(3).alias("party"), money.parse_cases(cell(4)).alias("criminal_cases"), cell(5).alias("education"),
        money.parse_inr(cell(6)).alias("total_assets_inr"), money.parse_inr(cell(7)).alias("total_liabilities_inr"), by.alias("is_bye_election"), F.nullif(F.regexp_extract(seat, r":.*?(\d{2}-\d{2}-\d{4})", 1), F.lit("")).alias("bye_election_date"))
    return out.where("candidate_id is not null and candidate_id <> 0 and name is not null")


def paged_candidates(rows: DataFrame, most_pages: int = 80) -> DataFrame:
    """Each candidate once per slug, from the first page that has it; pages count up to the first one with nothing new."""
    found = candidates(rows).where(F.col("page") <= most_pages)
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("slug", "candidate_id").orderBy("page", "table_no", "row_no"))).where("n = 1").drop("n")
    pages = rows.select("slug", "page").distinct().join(first.groupBy("slug", "page").agg(F.count("*").alias("fresh")), ["slug", "page"], "left")
    stop = pages.where("fresh is null").groupBy("slug").agg(F.min("page").alias("stop"))
    return first.join(stop, "slug", "left").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")


def near_names(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """Rows whose seat and a known one (seat) begin with one another; an empty name fits any. Names meet by their prefixes, so the join
    is one of equal keys and neither side need be small. The rows are read three times, so those of parsed pages should be written first."""
    key = names.seat_key(F.col("constituency"), reserved=False)
    known = seats.select(names.seat_key(F.col("seat"), reserved=False).alias("known")).where("known is not null").distinct()
    asked = rows.select(key.alias("k_")).where("k_ is not null").distinct()
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.char_length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    longer = asked.select("k_", heads("k_").alias("known")).join(known, "known", "left_semi").select("k_")
    shorter = asked.join(known.select(heads("known").alias("k_")).distinct(), "k_", "left_semi")
    return rows.withColumn("k_", key).join(longer.unionByName(shorter).distinct(), "k_", "left_semi").select(*rows.columns)


# --- detail pages ---

_PAGE = "slug string, page int, text string, title string, headings array<string>"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in (whole.slice(i, PAGES) for i in range(0, whole.num_rows, PAGES))):
        made = [parse(h.as_py() or "") for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("slug"), batch.column("page"), pa.array([" ".join(m.text) for m in made], pa.string()), pa.array([" ".join(m.title) for m in made], pa.string()), pa.array([m.headings for m in made], pa.list_(pa.string()))], ["slug", "page", "text", "title", "headings"])


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("slug", F.col("page").cast("int").alias("page"), "html").mapInArrow(_texts, _PAGE)


def details(pages: DataFrame) -> DataFrame:
    """slug, page: age, profession, totals, serious cases and name out of a candidate's page."""
    text = F.col("text")
    age = F.nullif(F.regexp_extract(text, r"(?:Self\s+)?Age\s*:?\s*(\d+)", 1), F.lit("")).try_cast("int")
    job = F.trim(F.regexp_extract(text, r"(?:Self\s+)?Profession[s]?\s*:?\s*([^|\n]{2,200}?)(?:Self|Spouse|$)", 1))
    total = lambda kind: F.coalesce(F.when(money.parse_inr(F.regexp_extract(text, rf"Total {kind} Assets.*?Rs\s*([\d,]+)", 1)) <= money.MOST_RUPEES, money.parse_inr(F.regexp_extract(text, rf"Total {kind} Assets.*?Rs\s*([\d,]+)", 1))), F.lit(0).cast("long"))
    own = names.title_name(F.col("title"))
    heads = F.filter(F.transform("headings", names.clean_name), lambda h: ~names.is_chrome(h))
    return page_texts(pages).select(
        "slug", "page", F.when(age.between(18, 110), age).alias("age"), F.nullif(job, F.lit("")).alias("profession"), total("Movable").alias("movable_total_inr"), total("Immovable").alias("immovable_total_inr"),
        F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*Number of Serious IPC", 1), F.lit("")).try_cast("int").alias("serious_cases"),
        F.coalesce(F.when(~names.is_chrome(own), own), F.get(heads, F.lit(0)), F.lit("")).alias("name"))


def detail_cases(rows: DataFrame) -> DataFrame:
    """Case rows of tables whose first row speaks of IPC, sections or charges."""
    texts = F.transform("cells", lambda c: c["text"])
    rows = rows.where(F.col("header").rlike(OFFENCE_HEADER) & (F.col("row_no") > 0) & (F.size("cells") > 0)).withColumn("t", texts)
    return rows.select(
        "slug", "page", F.substring(F.coalesce(F.get(F.filter("t", lambda c: c.rlike(OFFENCES)), F.lit(0)), F.lit("")), 1, 255).alias("ipc_sections"),
        F.substring(F.coalesce(F.get(F.filter("t", lambda c: F.char_length(c) > 20), F.lit(0)), F.element_at("t", -1)), 1, 500).alias("description"), F.lit("pending").alias("status"))


#: Words of header and summary rows.
HEADER_WORDS = ("sr no", "description", "self", "spouse", "huf", "dependent", "value", "remarks", "self/spouse")
#: How rows are numbered (a letter in brackets or none, Roman or plain numbers), and what a cell of offences holds.
ROW_NUMBER = r"(?i)^(?:\(?[a-z]\)?|[ivxlcdm]+\.?|\d+\.?)$"
OFFENCES, OFFENCE_HEADER = r"(?i)\bIPC\b|\bsection\b", "ipc|section|charge"
SUMMARY_WORDS = ("total", "totals", "gross total", "sum of", "calculated as sum", "grand total")


def detail_assets(rows: DataFrame) -> DataFrame:
    """Asset rows of the tables that follow a "Movable Assets" or "Immovable Assets" heading."""
    has = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    kind = F.lower(F.regexp_extract("heading", r"(?i)\b(Movable|Immovable)\s+Assets\b", 1))
    rows = rows.withColumns({"category": kind, "t": F.transform("cells", lambda c: F.trim(c["text"]))}).where("category <> '' and size(cells) >= 2")
    joined = F.lower(F.array_join("t", " "))
    first = F.get("t", F.lit(0))
    shifted = (F.size("t") >= 3) & (first.rlike(ROW_NUMBER) | (F.char_length(first) <= 2))
    rows = rows.where(~(has(joined, HEADER_WORDS) & (F.char_length(joined) < 200)))
    rows = rows.withColumns({"sub": F.when(shifted, F.get("t", F.lit(1))).otherwise(first), "rest": F.when(shifted, F.slice("t", 3, F.size("t"))).otherwise(F.slice("t", 2, F.size("t")))})
    keep = (F.char_length("sub") > 3) & ~F.col("sub").rlike(r"^\d+$") & ~has(F.lower("sub"), SUMMARY_WORDS) & ~F.lower("sub").isin(*HEADER_WORDS)
    return rows.where(keep).select("slug", "page", "category", F.substring("sub", 1, 120).alias("subcategory"), money.pick_value(F.col("rest")).alias("value_inr")).where("value_inr <> 0")


def looks_like_listing(html: Column) -> Column:
    """Whether a saved answer is a listing at all."""
    return (F.char_length(html) >= 1000) & F.contains(F.lower(html), F.lit("candidates")) & F.contains(F.lower(html), F.lit("constituency")) & ~F.contains(F.substring(html, 1, 500), F.lit("404"))
