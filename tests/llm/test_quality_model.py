from __future__ import annotations

import zlib

import numpy as np

from oathmill.llm import quality_model as Q
from oathmill.llm.shared import documents


def test_pairwise_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = Q.train(x, y)
    assert (2, 5) in model.pairs
    assert (((model.score(x) >= 0.5) == y).mean()) > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(Q.FEATURES)))
    model = Q.train(x, (x[:, 0] > 0.4).astype(float))
    total = model.base
    for f in range(x.shape[1]):
        total += model.tables[f][sum(x[3, f] >= c for c in model.edges[f])]
    for (f, g), t in zip(model.pairs, model.pair_tables, strict=True):
        total += t[sum(x[3, f] >= c for c in model.coarse[f]), sum(x[3, g] >= c for c in model.coarse[g])]
    assert model.score(x)[3] == np.float64(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.score_documents(spark, documents(spark, folder), labels).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert (np.array([r["predicted"] for r in rows]) == y).mean() > 0.95 and auc > 0.97


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.remainder(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda labels: sorted(tuple(r) for r in Q.score_documents(spark, documents(spark, sf), labels).collect())
    assert key(labels) == key(turned)


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.score_documents(spark, make_docs(odd_rows), labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.score_documents(spark, make_docs([]), labels).count() == 0
    assert {r["score"] for r in Q.score_documents(spark, make_docs(odd_rows), labels.limit(0)).collect()} == {0.5}
