"""Names, slugs and keys as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Latin letters that do not decompose, and Cyrillic, lower case, with their plain letters.
LETTERS = {
    "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ੰ": "n", "ੱ": "h",
}
#: The plain letters of an Indic block, from its first code point on ("-": none). The blocks share one order.
INDIC = (
    "- n n h - a aa i ii u uu r l en e e ai on o o au k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n nnn p ph b bh m y r rr l l lll v sh ss s h - - - - "
    "aa i ii u uu r rr en e e ai on o o au - - - - - - - - - - q khh ghh z dddh rh f yy rr ll l ll - - 0 1 2 3 4 5 6 7 8 9").split()
INDIC_BLOCKS = (0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00)


def _plain_letters() -> dict[str, str]:
    """Every letter that has plain ones: by decomposition (composed and ligature letters), then the tables."""
    out = {chr(c): "" for c in range(0x300, 0x370)}  # marks
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        apart = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        if apart.isascii() and apart.isalpha():
            out[chr(c)] = apart
    out |= LETTERS
    for block in INDIC_BLOCKS:
        out |= {chr(block + i): "" if x == "-" else x for i, x in enumerate(INDIC)}
    return out


def transliterate(text: Column) -> Column:
    """Lower case with plain letters for accented, joined, Cyrillic and Indic ones; all else as it is. ASCII text takes no part in it.

    One ``translate`` gives each letter its plain one, drops marks, and puts a private character for several; these are
    then spelled out from a list."""
    table = _plain_letters()
    several = sorted({v for v in table.values() if len(v) > 1})
    code = {v: chr(0xE000 + i) for i, v in enumerate(several)}
    kept = sorted(k for k, v in table.items() if v)
    dropped = sorted(k for k, v in table.items() if not v)
    low = F.translate(F.lower(text), "".join(kept + dropped), "".join(code.get(table[k], table[k]) for k in kept))
    spelled = F.split(F.lit(" ".join(several)), " ")
    inside = lambda c: (c >= F.lit(chr(0xE000))) & (c < F.lit(chr(0xE000 + len(several))))
    apart = F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda c: F.when(inside(c), F.get(spelled, F.ascii(c) - 0xE000)).otherwise(c))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(apart, "")).otherwise(F.lower(text))


def slugify(text: Column) -> Column:
    """ASCII letters and digits, lower case, joined by hyphens. Letters of other scripts are transliterated first; commas within numbers go."""
    plain = F.regexp_replace(transliterate(text), r"(?<=\d),(?=\d)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def display_name(name: Column, candidate_id: Column, politician_id: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Candidate #"), candidate_id.cast("string")), F.concat(F.lit("Politician #"), politician_id.cast("string")))


def slug_or_id(slug: Column, politician_id: Column) -> Column:
    return F.coalesce(F.nullif(slug, F.lit("")), politician_id.cast("string"))


def seat_key(name: Column, reserved: bool = True, spaces: bool = True, ampersand: bool = False) -> Column:
    """Upper-case seat name; the variants drop reservation tags, collapse spaces, spell out ampersands."""
    key = F.regexp_replace(name, r"\((SC|ST)\)", "") if reserved else name
    key = F.upper(key)
    if ampersand:
        key = F.replace(key, F.lit("&"), F.lit("AND"))
    return F.trim(F.regexp_replace(key, r"\s+", " ") if spaces else key)


def person_key(name: Column) -> Column:
    """Upper case, letters and digits only, single spaces; null counts as empty."""
    key = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def candidate_key(path: Column) -> Column:
    """What stands before the last double underscore of a file's stem; the whole stem without one."""
    return F.regexp_replace(file_stem(path), "__((?!__).)*$", "")


def affidavit_id(path: Column) -> Column:
    return F.regexp_extract(file_stem(path), "^.*__(.*)$", 1)


def name_from_file(path: Column) -> Column:
    """The candidate's name in a file name, as a person key; empty without a double underscore."""
    stem = file_stem(path)
    return F.when(F.contains(stem, F.lit("__")), person_key(F.regexp_replace(F.regexp_extract(stem, "^(.*)__.*$", 1), "_+", " "))).otherwise("")


def qc_name_from_file(path: Column) -> Column:
    """As above, without a leading sequence number and with underscores as spaces."""
    head = F.regexp_extract(file_stem(path), "^(.*)__.*$", 1)
    return F.replace(F.regexp_replace(head, r"^\d+_", ""), F.lit("_"), F.lit(" "))


def numbered_slug(base: Column, nth: Column) -> Column:
    """base, base-2, base-3, ... by the position among equal bases."""
    return F.when(nth <= 1, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string")))


def source_url_parts(url: Column) -> tuple[Column, Column]:
    """(election slug, candidate id) of a candidate page's address; nulls where it is none."""
    pattern = r"/([^/]+)/candidate\.php\?candidate_id=(\d+)"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(url, pattern, 2), F.lit("")).try_cast("int")


#: Beginnings of page chrome that is no name.
CHROME = ("home", "donate", "share on", "myneta", "crime-o-meter", "assets & liabilities", "educational details", "details of criminal cases", "elections")


def is_chrome(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for c in CHROME:
        hit = hit | F.startswith(low, F.lit(c))
    return F.coalesce(text == "", F.lit(True)) | hit | text.rlike(r"\b(19|20)\d{2}\b")


def clean_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\s*\((Winner|Loser|Runner.?up)\)\s*$", ""), r"\s+", " "))


def title_name(title: Column) -> Column:
    """A page title up to its first bracket or colon."""
    return clean_name(F.regexp_extract(title, r"^([^()\[\]:]+)", 1))
