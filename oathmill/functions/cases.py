"""Case types, placeholders and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns in order of precedence, with labels. Alternatives bind loosely on purpose: "3241" is a hurt case.
CASE_RULES = (
    (r"\b302\b", "Murder"),
    (r"\b307\b", "Attempt to murder"),
    (r"\b304\b", "Culpable homicide"),
    (r"\b323|324|325\b", "Causing hurt"),
    (r"\b354\b", "Outraging modesty"),
    (r"\b376\b", "Sexual assault"),
    (r"\b498A?\b", "Domestic cruelty"),
    (r"\b506\b", "Criminal intimidation"),
    (r"\b504\b", "Insult / breach of peace"),
    (r"\b378|379|380\b", "Theft"),
    (r"\b420\b", "Cheating"),
    (r"\b406|407|408|409\b", "Criminal breach of trust"),
    (r"\b403|404\b", "Misappropriation"),
    (r"\b467|468|471\b", "Forgery"),
    (r"\b454|457\b", "House-breaking"),
    (r"\b143|144|147|148|149\b", "Rioting / unlawful assembly"),
    (r"\b188\b", "Disobedience to public servant"),
    (r"\b341|342\b", "Wrongful restraint"),
    (r"\b153A|153B\b", "Promoting enmity"),
    (r"\b124A\b", "Sedition"),
    (r"\b120B\b", "Criminal conspiracy"),
    (r"\b34\b", "Common intention"),
    (r"\b109\b", "Abetment"),
    (r"\b171[A-Z]?\b", "Election bribery / expenses"),
    (r"\bRPA|Representation of People", "Election Code violation"),
    (r"PC\s*Act|Prevention of Corruption", "Corruption"),
    (r"\bArms Act\b", "Arms Act violation"),
    (r"\bNDPS\b", "Narcotics / NDPS"),
    (r"\bSC[/\s]?ST\b", "SC/ST Act"),
)
OTHER = "Other criminal"


def all_case_types(ipc: Column) -> Column:
    """Every label that fits, in rule order; the default label if none does; empty for empty text."""
    text = F.trim(F.coalesce(ipc, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), label) for p, label in CASE_RULES]))
    # bound by a lambda, so that the rules run once
    labels = F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) == 0, F.array(F.lit(OTHER))).otherwise(F.array_distinct(h))), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(labels)


def case_type(ipc: Column) -> Column:
    text = F.trim(F.coalesce(ipc, F.lit("")))
    out = F.when(text == "", F.lit(""))
    for pattern, label in CASE_RULES:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(label))
    return out.otherwise(OTHER)


def is_real_case(ipc: Column, description: Column) -> Column:
    """False for rows that only say that there is no case."""
    compact = F.lower(F.regexp_replace(F.trim(F.coalesce(description, F.lit(""))), r"[\s\-—–]+", ""))
    placeholder = (compact == "") | F.contains(compact, F.lit("nocase")) | compact.isin("nil", "na", "none")
    sections = F.trim(F.coalesce(ipc, F.lit("")))
    real = (sections != "") & ~F.contains(F.substring(F.lower(sections), 1, 8), F.lit("no"))
    return ~placeholder | real


#: What is taken out of a case description.
_DROPPED = (
    r"(?i)-+\s*no\s*cases?\s*-+",
    r"(?i)\bFIR\s*(?:No\.?|Number)?\s*[\d/\-]+",
    r"\b\d{2,5}/\d{2,4}\b",
    r"(?i)\bPolice\s*Station[^,.;]*",
    r"(?i)\bP\.?\s*S\.?\s+[A-Za-z]+(?:\s+[A-Za-z]+)?",
    r"(?i)\bDis(?:t(?:t|rict))?\.?\s+[A-Za-z]+(?:\s+[A-Za-z]+)?",
)


def clean_description(text: Column) -> Column:
    """Without file numbers, stations and districts; runs of commas become one, none at the ends."""
    out = F.coalesce(text, F.lit(""))
    for pattern in _DROPPED:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"\s*[,;](?:\s*[,;])+\s*", ", ")
    out = F.regexp_replace(out, r"^[\s,;:\-]*[,;:\-]\s*", "")
    out = F.regexp_replace(out, r"\s*[,;:\-][\s,;:\-]*$", "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def sections(ipc: Column) -> Column:
    return F.transform(F.split(ipc, ","), lambda s: F.trim(s))


def severity(avg_cases: Column) -> Column:
    """Map bucket of average cases per seat; null has its own."""
    return F.when(avg_cases.isNull(), "none").when(avg_cases < 1, "<1").when(avg_cases < 2, "<2").when(avg_cases < 4, "<4").when(avg_cases < 6, "<6").otherwise(">=6")


def risk(score: Column) -> Column:
    return F.when(score < 30, "critical").when(score < 60, "suspicious").otherwise("standard")


#: Party colours.
PARTY_COLORS = {"AAP": "#019cdf", "INC": "#19aaed", "BJP": "#ff9933", "SAD": "#1a3399", "BSP": "#22336d", "SAD(B)": "#1a3399", "CPI": "#c0392b", "CPM": "#c0392b", "IND": "#7f8c8d", "NOTA": "#34495e"}


def party_color(short_name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PARTY_COLORS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(short_name)), F.lit("#7f8c8d"))


#: Icon by the first keyword that a subcategory holds.
ICONS = (
    ("cash", "payments"),
    ("bank|deposit", "savings"),
    ("land", "terrain"),
    ("building|house", "home"),
    ("vehicle|car", "directions_car"),
    ("jewel|gold", "diamond"),
    ("invest|bond|share", "trending_up"),
)


def asset_icon(subcategory: Column) -> Column:
    low, out = F.lower(subcategory), None
    for words, icon in ICONS:
        out = F.when(low.rlike(words), icon) if out is None else out.when(low.rlike(words), icon)
    return out.otherwise("category")
