"""One query per corpus operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, lexical_search, license_scan, main_text, mixing, phrases, quality_model, quality_rules
from . import sentencepiece_codec, simhash, substring_dedup, url_filter, vector_codes
from .shared import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the decoded ids are the text again (a space mark in it stands for a space), with digests of both."""
    docs = documents(spark, sf_dir)
    return sentencepiece_codec.digests(spark, docs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, documents(spark, sf_dir)).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(spark, documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, documents(spark, sf_dir)).drop("spans")


CONTROL = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L conv_id, t turn, r role, '{CONTROL}' text FROM VALUES (0L, 'user'), (1L, 'assistant') v(t, r)")
    out = chat_format.read_back(chat_format.format_conversations(table.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(spark, documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sentencepiece, op2_quality_rules, op3_fingerprints, op4_license_scan, op5_chat_formatting, op6_substring_dedup, op7_simhash,
        op8_mixing, op9_main_text, op10_quality_model, op11_url_filter, op12_vector_codes, op13_lexical_search)}


_WORD = r"[^\x20\x09-\x0D]+"
_COUNT = "length(regexp_replace(t, '[^{}]', '', 'g'))"
_RATIO = "1000 * {} // greatest(1, {})"
_G = quality_rules.GRAIN


def _sketch(by: str) -> str:
    """n, middle and spread of one grouping: the lowest buckets with enough rows at or under them, and their tops."""
    keys = f"{by}, " if by else ""
    rank = f"PARTITION BY {keys}m"
    top = lambda b: f"CASE WHEN {b} < {2 * _G} THEN {b} ELSE (({b} - (({b} - {_G}) // {_G}) * {_G} + 1) << CAST(({b} - {_G}) // {_G} AS INTEGER)) - 1 END"
    return f"""(SELECT {keys}m, n, {top('hi')} AS mid, greatest(1, {top('hi')} - {top('lo')}) AS spread FROM (
      SELECT {keys}m, n, min(b) FILTER (WHERE rn * 100 >= 50 * n) AS hi, min(b) FILTER (WHERE rn * 100 >= 25 * n) AS lo
      FROM (SELECT *, row_number() OVER ({rank} ORDER BY b) AS rn, count(*) OVER ({rank}) AS n FROM long) GROUP BY {keys}m, n))"""


def _shrunk(a: str, b: str, x: str) -> str:
    return f"({a}.n * {a}.{x} + {quality_rules.SHRINK} * {b}.{x}) // ({a}.n + {quality_rules.SHRINK})"


#: The rules in SQL: counts, ratios, sketches as ranks of bucketed values, fences, verdicts.
_RULES = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 7)) AS g(i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win), unnest(generate_series(0, 7)) AS g(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_COUNT.format('#*$%&|<>')} AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, {_RATIO.format(_COUNT.format('!-/:-@' + chr(92) + '[-`{-~'), 'word_chars')} AS marks, {_RATIO.format('word_chars', 'n_words')} AS word_length, {_RATIO.format(_COUNT.format('A-Z'), _COUNT.format('A-Za-z'))} AS capitals FROM m),
one AS (SELECT doc_id, lang, source, unnest([{', '.join(f"{{'m': '{k}', 'v': {k}}}" for k in quality_rules.RATIOS)}]) AS r FROM v),
long AS (
  SELECT doc_id, lang, source, r.m AS m, r.v AS v,
    CASE WHEN r.v < {2 * _G} THEN r.v ELSE (length(to_base(r.v, 2)) - {_G.bit_length()}) * {_G} + (r.v >> CAST(length(to_base(r.v, 2)) - {_G.bit_length()} AS INTEGER)) END AS b FROM one),
every AS {_sketch('')},
lan AS (SELECT a.lang, a.m, {_shrunk('a', 'b', 'mid')} AS mid, {_shrunk('a', 'b', 'spread')} AS spread FROM {_sketch('lang')} a JOIN every b ON a.m = b.m),
own AS (
  SELECT a.lang, a.source, a.m, {_shrunk('a', 'b', 'mid')} AS mid, least({_shrunk('a', 'b', 'spread')}, 2 * b.spread) AS spread, b.mid + {quality_rules.FENCE} * b.spread AS wide
  FROM {_sketch('lang, source')} a JOIN lan b ON a.m = b.m AND a.lang IS NOT DISTINCT FROM b.lang),
judged AS (
  SELECT doc_id, bool_and(v <= CASE WHEN mid <= wide THEN mid + {quality_rules.FENCE} * spread ELSE wide END) AS within
  FROM long JOIN own ON own.m = long.m AND own.lang IS NOT DISTINCT FROM long.lang AND own.source IS NOT DISTINCT FROM long.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND within AS kept FROM v JOIN judged USING (doc_id)"""

ORACLES = {
    "op2_quality_rules": _RULES,
    "op5_chat_formatting": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t),
f AS (
  SELECT *, (n = 1 OR role <> before_role) AS opens,
    length(text) + length(regexp_replace(text, '[^\\[<\\\\]', '', 'g')) AS text_chars,
    length(role) + length(regexp_replace(role, '[^\\[<\\\\]', '', 'g')) AS role_chars FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(text_chars + CASE WHEN opens THEN 12 + role_chars + 10 + 10 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op6_substring_dedup": """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s
  FROM w, unnest(generate_series(1, len(words) - 12)) AS g(i) WHERE len(words) >= 13),
low AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN low USING (s) WHERE doc_id > first_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, unnest(generate_series(0, 12)) AS g(k)),
word AS (SELECT doc_id, i, words[i] AS word FROM w, unnest(generate_series(1, len(words))) AS g(i)),
kept AS (
  SELECT doc_id, count(*) AS n, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL) AS text
  FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}


_LINK = url_filter.LINK.replace("'", "''")
_HOST = "translate(coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_url_filter"] = f"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {', '.join(map(str, url_filter.RULES))}),
u AS (
  SELECT row_number() OVER () AS n, page_id, {_HOST.format('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (
  SELECT n, arg_max({{'r': rhost || rpath, 'v': rverdict}}, (length(rhost || rpath), rhost || rpath, rverdict)) AS b
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n),
j AS (SELECT u.*, b.r AS rule, b.v AS ruled FROM u LEFT JOIN best USING (n)),
seed AS (
  SELECT host, {url_filter.MASS} * count(*) FILTER (WHERE ruled = 'allow') // count(*) AS trust,
    {url_filter.MASS} * count(*) FILTER (WHERE ruled = 'block') // count(*) AS distrust FROM j WHERE host <> '' GROUP BY host),
link AS (
  SELECT DISTINCT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT {_HOST.format('url')} AS src, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS dst FROM pages)),
edge AS (SELECT true AS good, src AS a, dst AS b FROM link WHERE src <> '' AND src <> dst UNION ALL SELECT false, dst, src FROM link WHERE src <> '' AND src <> dst),
way AS (SELECT *, count(*) OVER (PARTITION BY good, a) AS parts FROM edge),
walk AS (
  SELECT 0 AS turn, host, good, mass FROM (SELECT host, true AS good, trust AS mass FROM seed UNION ALL SELECT host, false, distrust FROM seed) WHERE mass > 0
  UNION ALL
  SELECT turn + 1, b, w.good, CAST(sum(mass * {url_filter.DAMPING} // (parts * 100)) AS BIGINT) FROM walk w JOIN way ON w.host = a AND w.good = way.good
  WHERE turn < {url_filter.ROUNDS} AND mass * {url_filter.DAMPING} // (parts * 100) > 0 GROUP BY turn, b, w.good),
mass AS (
  SELECT host, CAST(sum(CASE WHEN good THEN mass * {100 - url_filter.DAMPING} // 100 ELSE 0 END) AS BIGINT) AS trust,
    CAST(sum(CASE WHEN good THEN 0 ELSE mass * {100 - url_filter.DAMPING} // 100 END) AS BIGINT) AS distrust FROM walk GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust * 100 > (trust + distrust) * {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN mass ON mass.host = j.host"""


def _lloyd(turn: int) -> str:
    """One assignment to the entries of ``book{turn}`` and, but for the last, the entries after it."""
    near = f"""near{turn} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN book{turn} b ON b.p = x.p) GROUP BY r, p)"""
    if turn == vector_codes.ROUNDS:
        return near
    return near + f""",
sum{turn} AS (SELECT p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT x.p, e, unnest(q) AS c, unnest(generate_series(1, len(q))) AS i FROM x JOIN near{turn} a ON a.r = x.r AND a.p = x.p) GROUP BY p, e, i),
mean{turn} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS q FROM sum{turn} GROUP BY p, e),
book{turn + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.q, b.q) AS q FROM book{turn} b LEFT JOIN mean{turn} m ON m.p = b.p AND m.e = b.e)"""


ORACLES["op12_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({vector_codes.GRAIN} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS q FROM kept, range({vector_codes.PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, q FROM x WHERE r <= {vector_codes.ENTRIES}),
{(', ' + chr(10)).join(_lloyd(i) for i in range(vector_codes.ROUNDS + 1))},
coded AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY r),
num AS (SELECT p, e, unnest(q) AS c, unnest(generate_series(1, len(q))) AS i FROM book{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM num) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{lexical_search.TERM}') AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS nn, CAST(coalesce(sum(n), 0) AS BIGINT) AS l FROM n),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, whole GROUP BY term, nn),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '{lexical_search.TERM}')) AS term FROM benchmark),
score AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN post USING (term) JOIN n USING (r), whole GROUP BY item_id, r, doc_id),
place AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM place WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
