"""The risk estimator against its plain form, held-out accuracy, and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as tx

DATA = "/root/testdata/sf0.1"


def plain_risk(pos, unl, prior):
    loss = lambda z, y: np.mean(np.log1p(np.exp(-z if y else z)))
    return prior * loss(pos, 1), loss(unl, 0) - prior * loss(pos, 0)


def test_risk_and_its_step():
    rng = np.random.Generator(np.random.PCG64(1))
    for below in (False, True):
        pos, unl, prior = rng.normal(3 if below else 0, 1, 7), rng.normal(-7 if below else 1, 1, 11), 0.3
        one, bracket = plain_risk(pos, unl, prior)
        value, step = tx.nn_risk(pos, unl, prior)
        assert (bracket < 0) == below
        assert value == pytest.approx(one + max(0.0, bracket))
        slopes = []
        for k in range(18):
            up = np.concatenate([pos, unl])
            up[k] += 1e-6
            a, b = plain_risk(up[:7], up[7:], prior)
            slopes.append(((-b + bracket) if below else (a + b - one - bracket)) / 1e-6)
        assert step == pytest.approx(np.array(slopes), abs=1e-5)


def test_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = tx.op7_toxicity(spark, DATA).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    caught = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert len(caught) > 80 and np.mean(caught) >= 0.9
    assert np.mean(clean) < 0.02


def test_edges(spark):
    bad = spark.createDataFrame([(k, f"you awful person {k} x") for k in range(30)] + [(99, "you awful person"), (99, "you awful person")], "doc_id long, text string")
    rest = spark.createDataFrame([(100 + k, f"a calm sentence about stone {k} y") for k in range(200)] + [(None, "no id"), (None, None), (500, "")], "doc_id long, text string")
    model = tx.train(bad, rest, 0.1)
    docs = spark.createDataFrame([(1, "awful awfully", "own"), (2, None, "own"), (3, "", "own"), (None, "calm", "own"), (4, "calm " * 100_000 + "awful", "own"), (5, "calm", "own")], "doc_id long, text string, score string").withColumn("toxic", F.lit(9))
    found = {(r.doc_id, r.text and r.text[:4]): r.score for r in tx.score(docs, model).collect()}
    assert len(found) == 6 and found[1, "awfu"] > found[2, None] + 0.2
    assert found[2, None] == found[3, ""] == found[None, "calm"] == found[5, "calm"] < found[4, "calm"]
    assert tx.score(docs.limit(0), model).count() == 0
    for a, b in ((bad.limit(0), rest), (bad, rest.limit(0))):
        assert {r.score for r in tx.score(docs, tx.train(a, b, 0.1)).collect()} == {0.0}
