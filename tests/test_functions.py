"""Column functions on literals: the cases that the fixture notes list."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oathmill.functions import cases as C
from oathmill.functions import documents as D
from oathmill.functions import money, names
from oathmill.sources import files, registry


@pytest.fixture(scope="module")
def give(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


L = F.lit


@pytest.fixture(scope="module")
def null(spark):
    return F.lit(None).cast("string")


@pytest.mark.parametrize(("text", "want"), [("Rs 27,28,01,726   ~ 27 Crore+", 272801726), ("Nil", 0), ("", 0), ("Rs ,", 0), ("Rs 12.50", 1250), (None, 0)])
def test_parse_inr(give, text, want):
    assert give(money.parse_inr(L(text).cast("string"))) == want


def test_numbers(give, null):
    assert give(money.parse_cases(L("**3** of 4"))) == 3 and give(money.parse_cases(L("none"))) == 0
    assert give(money.candidate_id(L("/c.php?candidate_id=274"))) == 274 and give(money.candidate_id(L("x"))) is None
    assert give(money.indian_int(L("1,00,89,655.9"))) == 10089655 and give(money.indian_int(L("1.2.3"))) is None and give(money.indian_int(L("x"))) is None
    assert give(money.spaced_number(L(" 4979 105 ,"))) == "4979105"
    assert give(money.safe_inr(L(10**13))) == 10**13 and give(money.safe_inr(L(10**13 + 1))) is None and give(money.safe_inr(L(-1))) is None
    assert give(money.pick_value(F.array(L("Rs 1,000 Rs. 5,000"), L("9,999"), L("99999999999999")))) == 9999
    assert give(money.pick_value(F.array(L("plot 12"), L("")))) == 0
    assert give(money.crore_label(L(123456789))) == "12.35"


def test_names(give, null):
    assert give(names.slugify(L("José  D'Souza #7"))) == "jose-d-souza-7"
    assert give(names.display_name(L("  "), L(5), L(9))) == "Candidate #5" and give(names.display_name(null, L(None).cast("int"), L(9))) == "Politician #9"
    assert give(names.seat_key(L("Dina  Nagar (SC)"))) == "DINA NAGAR" and give(names.seat_key(L("A & B"), ampersand=True)) == "A AND B"
    assert give(names.person_key(L("a.b-c  d"))) == "A B C D" and give(names.person_key(null)) == ""
    assert give(names.name_from_file(L("in/SAMPLE_ONE__X__1001.pdf"))) == "SAMPLE ONE X" and give(names.name_from_file(L("scan-7.pdf"))) == ""
    assert give(names.candidate_key(L("SAMPLE_ONE__1001.pdf"))) == "SAMPLE_ONE" and give(names.affidavit_id(L("SAMPLE_ONE__1001.pdf"))) == "1001" and give(names.candidate_key(L("scan-7.pdf"))) == "scan-7"
    assert give(names.qc_name_from_file(L("005_SAMPLE_ONE__16.json"))) == "SAMPLE ONE"
    slug, number = names.source_url_parts(L("https://x/El2022/candidate.php?candidate_id=7"))
    assert give(slug) == "El2022" and give(number) == 7
    assert give(names.title_name(L("Sample One(Alpha(AP)):Seat"))) == "Sample One" and give(names.clean_name(L("SAMPLE ONE (Winner)"))) == "SAMPLE ONE"
    assert give(names.is_chrome(L("Punjab 2022"))) and give(names.is_chrome(L("Elections home"))) and not give(names.is_chrome(L("Sample One")))


def test_cases(give, null):
    assert give(C.case_type(L("IPC 420, 302"))) == "Murder" and give(C.case_type(L(" "))) == "" and give(C.case_type(L("x"))) == "Other criminal"
    assert give(C.all_case_types(L("302, 120B"))) == ["Murder", "Criminal conspiracy"] and give(C.all_case_types(null)) == []
    assert give(C.case_type(L("section 3241"))) == "Causing hurt"
    for ipc, text, want in [("", "-- No Cases --", False), ("420", "nil", True), ("No case", "NA", False), ("", "Cheating", True), (None, None, False)]:
        assert give(C.is_real_case(L(ipc).cast("string"), L(text).cast("string"))) is want
    assert give(C.clean_description(L("FIR No 0101/2016, , Cheating at Police Station Subhanpur; , Distt. Kapurthala,"))) == "Cheating at"
    assert give(C.party_color(L("aap"))) == "#019cdf" and give(C.party_color(null)) == "#7f8c8d"
    assert give(C.asset_icon(L("Bank deposits"))) == "savings" and give(C.asset_icon(L("??"))) == "category"
    assert [give(C.severity(L(v).cast("double"))) for v in (None, 0.9, 1, 2, 4, 6)] == ["none", "<1", "<2", "<4", "<6", ">=6"]
    assert [give(C.risk(L(v))) for v in (29.9, 30, 60)] == ["critical", "suspicious", "standard"]


def test_description_cleanup_is_stable(give):
    for text in ("a, ; , b ,, c;", ",;:- x -", "FIR 12/2018 theft, P.S. Khanna, Distt. X"):
        once = C.clean_description(L(text))
        assert give(C.clean_description(once)) == give(once)


@pytest.mark.parametrize(("last", "want"), [("0", "Q"), ("O", "Q"), ("5", "S"), ("1", "I"), ("8", "B"), ("L", "L"), ("3", "3"), ("Q", "Q")])
def test_pan_repair(give, last, want):
    fixed = D.repair_pan(L(f"id AAAAA0000{last}."))
    assert give(fixed) == f"id AAAAA0000{want}." and give(D.repair_pan(fixed)) == f"id AAAAA0000{want}."


def test_rows_follow_the_first_y_not_the_gap(give):
    pieces = [(0, 5, "a"), (10, 1, "b"), (15, 9, "c"), (20, 0, "d"), (30, 0, "e")]
    array = F.array(*[F.struct(L(y).alias("y"), L(x).alias("x"), L(t).alias("text")) for y, x, t in pieces])
    assert give(D.joined_rows(array)) == "b | a | c\nd | e"
    assert give(D.page_text(L("x" * 149), L("seen"))) == "seen" and give(D.page_text(L("x" * 150), L("seen"))) == "x" * 150


def test_stamp(give):
    cover = "Certificate No. : IN-ZZ10000000000001x\nCertificate Issued Date : 3-Jan-2025 05:23 PM\nPurchased by : SAMPLE ONE\nStamp Duty Amount(Rs.) : 10\n"
    s = give(D.stamp(L(cover)))
    assert (s["cert_number"], s["issue_date"], s["purchaser"], s["stamp_duty_rs"], s["first_party"]) == ("IN-ZZ10000000000001X", "3-Jan-2025 05:23 PM", "SAMPLE ONE", 10, "")
    assert give(D.stamp_time(L("13-Jan-2025 05:23 PM"))) == "2025-01-13T17:23:00" and give(D.stamp_time(L("soon"))) == ""


def test_form_pages(give):
    pages = F.array(L("Description of Document: Affidavit PART A"), L("PARTA\nset up by ALPHA PARTY (x)\nLSAMPLE ONE ** son/daughterAvife of SOME FATHER\nA\nAged 4§ years"), L("part - b ABSTRACT\nTotal number of pending criminal cases 97 (SEVEN)\nTotal number of cases in which IL convicted\nMoveable: Rs Total 4979 105/- | 12345"), L("Rs. 9999/- | Rs. 10000/-\n(vi) Total of Surrent market value"))
    a = give(D.part_a(D.part_a_page(pages)))
    assert (a["name"], a["party"], a["age"]) == ("SAMPLE ONE", "ALPHA PARTY", 45)
    b = give(D.part_b(D.part_b_page(pages)))
    assert (b["pending"], b["convictions"], b["movable_self"], b["movable_spouse"]) == (7, 0, 4979105, 12345)
    m = give(D.market_values(pages))
    assert (m["own"], m["spouse"]) == (None, 10000)


def test_market_row_is_the_first_with_a_label_under_it(give):
    label = "(vi) Total of current market value"
    pages = F.array(L(None).cast("string"), L(f"11111 / 22222\nno label\n{label}"), L(f"{label}\n33333 / 44444"), L(f"5 / 6\n{label}\n55 555 / 1\n{label}\n5555 5 / 6666\n{label}\n77777 / 88888\n{label}"), L(f"99999 / 99999\n{label}"))
    m = give(D.market_values(pages))
    assert (m["own"], m["spouse"]) == (55555, None)
    none = give(D.market_values(F.array(L(label), L("12345 / 12345\nTotal of\ncurrent market"))))
    assert (none["own"], none["spouse"]) == (None, None)
    b = give(D.part_b(L("Moveable: none\nTotal number of cases in which 4 convicted")))
    assert (b["pending"], b["convictions"], b["movable_self"], b["immovable_spouse"]) == (None, 4, None, None)


def test_spaced_numbers_lose_the_marks_at_their_ends_alone(give):
    for raw, want in ((" .5", "5"), (" 1 , 2. ", "1,2"), ("5 . ,\n", "5"), ("1. 2", "1.2"), (", ,", ""), (None, ""), ("5.\u2028", "5.\u2028")):
        assert give(money.spaced_number(L(raw).cast("string"))) == want
    assert give(money.indian_int(L("1,23.9"))) == 123 and give(money.indian_int(L("x"))) is None and give(money.indian_int(L("1.2.3"))) is None


@pytest.mark.parametrize(("db", "read", "dbc", "readc", "want"), [
    (None, 100, 0, 0, "NO_DB_ROW"), (100, None, 0, 0, "PARSE_FAIL"), (None, None, None, None, "NO_DB_ROW"), (0, 0, 0, 0, "MATCH"), (0, 5, 0, 0, "FLAG"), (1000, 1050, 2, 2, "MATCH"), (1000, 1050, 2, 3, "CLOSE"),
    (1000, 1100, 2, 2, "CLOSE"), (1000, 1101, 2, 2, "FLAG"), (1000, 1000, 2, 4, "FLAG"), (1000, 1000, None, 9, "MATCH")])
def test_reconciliation(give, db, read, dbc, readc, want):
    assert give(D.recon_status(*[L(v).cast("long") for v in (db, read, dbc, readc)])) == want


def test_sources(give, spark):
    assert give(files.with_page(L("https://x/?page=2&a=1"), L(7))) == "https://x/?page=7&a=1" and give(files.with_page(L("https://x/"), L(3))) == "https://x/?page=3"
    assert registry.state_name(" HIMACHAL ") == "Himachal Pradesh" and registry.state_name("?") == "Punjab" and registry.year_or_none("20x") is None
    assert registry.cycles(spark).count() > 80
    rows = spark.createDataFrame([(1, 0, "u1", "9"), (1, 1, "u1", "8"), (1, 2, "u2", "9"), (1, 3, "u3", "")], "page int, pos int, profile_url string, affidavit_id string")
    assert {r["profile_url"] for r in files.crawl_dedupe(rows).collect()} == {"u1", "u3"}
