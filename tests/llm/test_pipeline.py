from __future__ import annotations

import corpus_pipeline
from compare import rows_of
from oathmill.llm import mixing, quality_rules, stages
from oathmill.llm.shared import documents
from test_near_copies import survivors

COLUMNS = list(stages.COLUMNS)


def test_every_stage_acts_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs, seen = documents(spark, sf), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality_rules"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in quality_rules.judge(spark, before).where("kept").collect()}
    before, after = seen["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == survivors([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = seen["substring_dedup"]
    assert sum(r["n_chars"] for r in after.collect()) < sum(r["n_chars"] for r in before.collect()) and all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["source_mix"]
    assert after.count() == sum(r["copies"] for r in mixing.mix(spark, before).collect())
    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("n_tokens > 0").count() == after.count()


def test_odd_documents_pass_with_clashing_names(spark, make_docs, odd_rows, sf):
    """Extra columns, named as the operators name theirs, change nothing; empty tables stay empty."""
    full = make_docs(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, sf)
        assert rows_of(out.toPandas()) == rows_of(stage(spark, full.select(*COLUMNS), sf).toPandas())
        assert not set(out.columns) & {"key", "th", "spans", "fp", "row", "bucket", "kept"}
        assert stage(spark, full.limit(0), sf).count() == 0


def test_run_is_the_stages_in_a_row(spark, sf, tmp_path):
    docs = documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert len(corpus_pipeline.STAGES) == 5 and rows_of(corpus_pipeline.run(spark, sf).toPandas()) == rows_of(docs.toPandas())


def test_rows_not_ids_are_judged_kept_and_mixed(spark, make_docs):
    """Null and repeated doc_ids: each row by its own text, and the mix as mix() decides it."""
    text = lambda seed: " ".join(f"{seed}word{i * 7919 % 1009}" for i in range(60))
    rows = [(None, text("a"), "en", "s"), (None, text("b"), "en", "s"), (1, text("c"), "en", "s"), (1, "too short", "en", "s"), (2, text("c"), "en", "s"), (2, text("d"), "en", "s"), (3, text("e"), "en", "s"), (3, text("e"), "en", "s"), (None, text("f"), None, None), (4, text("f"), "en", "s")]
    docs = make_docs(rows).select(*COLUMNS)
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    judged = stages.apply_quality_rules(spark, docs, "")
    assert seen(judged) == sorted(((d, t) for d, t, *_ in rows if t != "too short"), key=str)
    single = stages.drop_near_duplicates(spark, judged, "")
    assert seen(single) == sorted([(None, text("a")), (None, text("b")), (1, text("c")), (2, text("d")), (3, text("e")), (4, text("f"))], key=str)
    many = make_docs([(i % 3 or None, text(f"m{i}x"), "en", "ab"[i % 2]) for i in range(24)] + [(9, text("n"), "en", "b")] * 8).select(*COLUMNS)
    decided, out = mixing.mix(spark, many).collect(), stages.mix_sources(spark, many, "").collect()
    for source in "ab":
        assert sum(r["source"] == source for r in out) == sum(r["copies"] for r in decided if r["source"] == source)
