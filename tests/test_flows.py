"""The commit log, landed streams, the crawl's dedupe and the home page."""

from __future__ import annotations

import json
import random
import re
import threading

import pytest

from oathmill.plans import home, model
from oathmill.plans.commits import Conflict, Log
from oathmill.sources import files
from oathmill.streaming import landing


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def found(log, table="t", at=None):
    return sorted(r["x"] for r in log.read(table, "x int", at).collect())


def test_of_two_writers_one_wins_and_leaves_nothing_of_the_other(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    start, out = log.snapshot(), []
    gate = threading.Barrier(2)

    def write(value):
        frame = ints(spark, value)
        gate.wait()
        try:
            out.append(("won", value, log.commit(start, {"t": frame, "other": frame}).version))
        except Conflict:
            out.append(("lost", value, None))

    threads = [threading.Thread(target=write, args=(v,)) for v in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(o[0] for o in out) == ["lost", "won"]
    winner = next(o[1] for o in out if o[0] == "won")
    assert found(log) == found(log, "other") == [winner] and log.versions() == [1]
    assert len(list((tmp_path / "t").iterdir())) == 1 and not [p for p in (tmp_path / "_log").iterdir() if not p.name.endswith(".json") and not p.name.endswith(".crc")]


def test_racing_updates_all_count_and_readers_see_whole_versions(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.commit(log.snapshot(), {"t": ints(spark, 0), "u": ints(spark, 0)})
    before = log.snapshot()

    def add(value):
        log.update(lambda at: ({n: log.read(n, "x int", at).unionByName(ints(spark, value)) for n in "tu"}, {f"by{value}": value}))

    threads = [threading.Thread(target=add, args=(v,)) for v in (1, 2, 3)]
    [t.start() for t in threads]
    for _ in range(5):
        at = log.snapshot()
        assert found(log, "t", at) == found(log, "u", at)
    [t.join() for t in threads]
    assert found(log) == [0, 1, 2, 3] and log.snapshot().marks == {"by1": 1, "by2": 2, "by3": 3}
    assert found(log, "t", before) == [0] and log.versions() == [1, 2, 3, 4]
    assert log.vacuum() == 6 and found(log) == [0, 1, 2, 3] and log.versions() == [4]


def test_a_lost_commit_leaves_the_old_version(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.commit(log.snapshot(), {"t": ints(spark, 1)})
    with pytest.raises(Exception, match="divide|DIVIDE"):
        log.commit(log.snapshot(), {"t": ints(spark, 0).selectExpr("CAST(1 div x AS INT) AS x")})
    assert found(log) == [1] and log.read("none", "x int").count() == 0
    assert log.update(lambda at: None).version == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, log = tmp_path / "in", Log(spark, str(tmp_path / "log"))
    folder.mkdir()
    key, schema = ["k"], "k int, seq int, v string"
    (folder / "a.json").write_text('{"k": 1, "seq": 5, "v": "new"}\n{"k": 2, "seq": 1, "v": "b"}\n')
    go = lambda done: landing.land_upsert(spark, str(folder), schema, log, "t", key, ["seq"], str(tmp_path / done))
    go("done")
    (folder / "b.json").write_text('{"k": 1, "seq": 2, "v": "late"}\n{"k": 3, "seq": 1, "v": "c"}\n')
    go("done")
    rows = sorted(tuple(r) for r in log.read("t", schema).collect())
    assert rows == [(1, 5, "new"), (2, 1, "b"), (3, 1, "c")]
    version = log.snapshot().version
    # the driver dies after the commit and before the stream's own: its commit file is missing, so the batch comes again
    commits = sorted((p for p in (tmp_path / "done" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    go("done")
    assert log.snapshot().version == version and sorted(tuple(r) for r in log.read("t", schema).collect()) == rows
    go("another")  # a lost checkpoint: all files again, one row per key all the same
    assert sorted(tuple(r) for r in log.read("t", schema).collect()) == rows


def test_streamed_manifest_equals_the_batch(spark, tmp_path):
    folder, log, rng = tmp_path / "in", Log(spark, str(tmp_path / "log")), random.Random(4)
    folder.mkdir()
    for name in ("m1", "m0", "m3"):  # m0 comes late: its lines are older than m1's
        lines = [json.dumps({"profile_url": f"u{rng.randrange(6)}", "affidavit_id": f"{name}-{i}", "download_succeeded": rng.random() < 0.5}) for i in range(12)]
        (folder / f"{name}.jsonl").write_text("\n\n".join([*lines, "{}", "not json", lines[0]]) + "\n")
        landing.follow_manifest(spark, str(folder), log, "m", str(tmp_path / "done"))
        pick = lambda rows: sorted((r["profile_url"], r["affidavit_id"], r["download_succeeded"]) for r in rows.collect())
        assert pick(log.read("m", landing.STATE)) == pick(files.manifest(spark, str(folder)))
    todo = spark.createDataFrame([(f"u{i}",) for i in range(8)], "profile_url string")
    assert {"u6", "u7"} <= {r["profile_url"] for r in files.pending(todo, log.read("m", landing.STATE)).collect()}


def test_last_line_of_a_long_file_counts(spark, tmp_path):
    """A file that tasks read in parts, and many lines of each address: the last one by its place in the file stays."""
    folder, log = tmp_path / "in", Log(spark, str(tmp_path / "log"))
    folder.mkdir()
    for name, first in (("m1", 4000), ("m0", 0)):
        (folder / f"{name}.jsonl").write_text("".join(json.dumps({"profile_url": f"u{i * i % 7}", "affidavit_id": str(first + i)}) + "\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        landing.follow_manifest(spark, str(folder), log, "m", str(tmp_path / "done"), files=1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = log.read("m", landing.STATE).collect()
    assert {r["profile_url"]: int(r["affidavit_id"]) for r in kept} == {f"u{i * i % 7}": 4000 + i for i in range(4000)} and len(kept) == 4
    assert len({(r["file"], r[-2], r[-1]) for r in kept}) == 4  # each is known by a place of its own


def test_files_of_many_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "places.json").write_text(json.dumps({"Goa": {"lat": 1.5, "lng": 2.5}}, indent=1))
    assert [tuple(r) for r in files.centroids(spark, str(tmp_path / "places.json")).collect()] == [("Goa", 1.5, 2.5)]
    (tmp_path / "seats.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"seat": "Panaji"}}]}, indent=1))
    assert [tuple(r) for r in files.geojson_names(spark, str(tmp_path / "seats.geojson"), "seat").collect()] == [("Panaji",)]


def _crawled(rows):
    urls, ids, out = set(), set(), []
    for page, pos, url, number in sorted(rows, key=lambda r: r[:2]):
        if (url or "") in urls or (number and number in ids):
            continue
        urls.add(url or "")
        if number:
            ids.add(number)
        out.append((page, pos))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_crawl_dedupe_equals_the_crawl(spark, seed):
    rng = random.Random(seed)
    wide = rng.choice((3, 12, 40))
    rows = [(i // 10, i % 10, f"u{rng.randrange(wide)}" if rng.random() < 0.95 else None, rng.choice(("", None, *(f"a{rng.randrange(wide)}" for _ in range(4))))) for i in range(120)]
    got = files.crawl_dedupe(spark.createDataFrame(rows, "page int, pos int, profile_url string, affidavit_id string"))
    assert sorted((r["page"], r["pos"]) for r in got.collect()) == _crawled(rows)


def test_crawl_dedupe_follows_chains_and_keeps_blank_ids_apart(spark):
    """Each row shares its address with the one before and its id with the one after: every second one stays."""
    chain = [(0, i, f"u{(i + 1) // 2}", f"a{i // 2}", f"x{i}") for i in range(12)] + [(1, i, f"v{i}", "", "x") for i in range(5)]
    got = files.crawl_dedupe(spark.createDataFrame(chain, "page int, pos int, profile_url string, affidavit_id string, name string"))
    assert sorted((r["page"], r["pos"]) for r in got.collect()) == _crawled([c[:4] for c in chain]) and got.columns[-1] == "name"
    assert files.crawl_dedupe(spark.createDataFrame([], "page int, pos int, profile_url string, affidavit_id string")).count() == 0


def test_home_page_reads_each_table_once(spark, sf, tmp_path):
    rows = home.home(model.from_driver(spark, sf), state="NATION_7")
    rows.write.parquet(str(tmp_path / "out"))
    executed = rows._jdf.queryExecution()
    rows.collect()
    plan = executed.executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet .*?(\w+)\.parquet", final)
    assert len(scans) == len(set(scans)) == 5, scans


def test_home_page_of_nothing(spark):
    fact = spark.createDataFrame([], "appearance_id long, politician_id long, name string, slug string, state string, zone string, house string, year int, constituency string, party string, won boolean, assets long, cases long")
    got = {r["section"]: r for r in home.home(fact).collect()}
    assert set(got) == {"unique_constituencies", "facts"} and got["facts"]["label"] == "Load some elections first."
