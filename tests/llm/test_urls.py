from __future__ import annotations

import pytest

from compare import rows_of
from oathmill.llm import queries, url_filter

PAGES = "page_id long, url string, html string, host string, path string, rule string, ruled string, trust long"
RULES = [("good.org", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/ok/", "allow"), ("Good.org", "/x", "allow"), ("good.org", "/x", "block")]


def _link(*hosts):
    return "".join(f'<p><A class="c" HREF = "https://{h}/page?x=1">t</a><a href="/own">own</a>' for h in hosts)


def _graph():
    """Two seeds, chains behind and before them, a hub, nulls, repeats, empty and long pages."""
    rows = [("http://www.good.org/a", _link("near.net", "Near.net", "both.net")), ("http://near.net/", _link("far.net")), ("https://x.bad.com/b", _link("both.net")), ("http://bad.com/ok/1?x", ""),
            ("http://spam.net/1", _link("bad.com", "x.bad.com")), ("http://spam.net/2", _link("x.bad.com")), ("http://farm.net", _link("spam.net")), ("http://lone.net/#f", "<a href=//far.net>f</a>"),
            ("http://good.org/xy", None), (None, _link("bad.com")), ("no address", "<a href='http://bad.com'>"), ("://empty.net", ""), ("http://", ""), ("http://lone.net/#f", "<a href=//far.net>f</a>")]
    rows += [(f"http://hub.net/{i}", _link("far.net", f"leaf{i}.net")) for i in range(50)] + [("http://long.net/", "word " * 50_000 + _link("x.bad.com") + "<a " * 20_000)]
    return [(i if i else None, u, h) for i, (u, h) in enumerate(rows)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x", 1) for i, u, h in rows], PAGES)


@pytest.fixture(scope="module")
def judged(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(spark, _frame(spark, _graph()), rules).collect()


def _plain(rows, rules):
    """Rules by a loop; both walks by dictionaries."""
    out, counts, edges = [], {}, set()
    for page_id, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(h + p), (h + p), v) for h, p, v in ((h.lower(), p, v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        out.append([page_id, host, path, best[1], best[2]])
        if host:
            n = counts.setdefault(host, [0, 0, 0])
            for k, hit in enumerate((True, best[2] == "allow", best[2] == "block")):
                n[k] += hit
            for piece in (html or "").replace("HREF = ", "href=").split("href=")[1:]:
                to = piece.lstrip("\"'")
                if to.startswith(("//", "http://", "https://")):
                    named = to.split("//", 1)[1].split("/")[0].split('"')[0].split("'")[0].split(">")[0].lower()
                    if named != host:
                        edges.add((host, named))
    sums = {}
    for way in (0, 1):
        pairs = edges if way == 0 else {(b, a) for a, b in edges}
        near = {}
        for a, b in pairs:
            near.setdefault(a, []).append(b)
        moving = {h: n[1 + way] * url_filter.MASS // n[0] for h, n in counts.items()}
        for _ in range(url_filter.ROUNDS + 1):
            after = {}
            for h, mass in moving.items():
                sums.setdefault(h, [0, 0])[way] += mass * (100 - url_filter.DAMPING) // 100
                for b in near.get(h, ()):
                    after[b] = after.get(b, 0) + mass * url_filter.DAMPING // (100 * len(near[h]))
            moving = after
    for r in out:
        trust, distrust = sums.get(r[1], (0, 0))
        r[4] = r[4] or ("block" if distrust * 100 > (trust + distrust) * url_filter.THRESHOLD else "allow")
        r += [trust, distrust]
    return out


def test_verdicts_equal_a_plain_walk(judged):
    assert sorted(map(str, map(list, judged))) == sorted(map(str, _plain(_graph(), RULES)))


def test_trust_walks_forward_and_distrust_backward(judged):
    of = {r["host"]: r for r in judged}
    assert of["near.net"]["trust"] > 0 and of["near.net"]["distrust"] == 0 and of["near.net"]["verdict"] == "allow"
    assert of["spam.net"]["distrust"] > of["farm.net"]["distrust"] > 0 and of["farm.net"]["verdict"] == of["long.net"]["verdict"] == "block"
    assert of["lone.net"]["trust"] == of["lone.net"]["distrust"] == 0 and of["lone.net"]["verdict"] == "allow"
    assert of[""]["rule"] is None and of[""]["path"] == "" and of[""]["verdict"] == "allow"


def test_longest_rule_wins_and_block_wins_a_tie(judged):
    of = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in judged}
    assert of["bad.com", "/ok/1"] == ("bad.com/ok/", "allow") and of["x.bad.com", "/b"] == ("bad.com/", "block")
    assert of["good.org", "/xy"] == ("good.org/x", "block") and of["www.good.org", "/a"] == ("good.org/", "allow")


def test_empty_table(spark):
    assert url_filter.judge(spark, _frame(spark, [])).count() == 0


def test_links_meet_the_sql(spark, tmp_path):
    """The query's own rules and SQL on pages that do link."""
    import duckdb

    rows = [(i, u and u.replace("good.org", "a.com/fr").replace("bad.com", "b.com/de"), h and h.replace("bad.com", "b.com").replace("near.net", "a.com")) for i, u, h in _graph()]
    _frame(spark, rows).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.queries()["op11_url_filter"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op11_url_filter"]).fetchdf()
    assert (got["distrust"] > 0).sum() > 3 and rows_of(got) == rows_of(want)
