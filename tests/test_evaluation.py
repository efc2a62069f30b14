"""Documents that hold passages, against a plain comparison."""

import pytest

from quirefold.operators import evaluation

HEAD = "a passage that begins like others do, "
PASSAGES = [(1, HEAD + "one"), (2, HEAD + "two"), (3, HEAD), (4, "é日本 😀 end"), (5, "x"), (5, "x"), (6, ""), (None, "end"), (7, "not there"), (8, "aa aa")]
DOCS = [(1, f"so: {HEAD}one, {HEAD}two."), (2, HEAD[1:]), (3, None), (4, ""), (5, "y é日本 😀 end x"), (None, "the end"), (6, "aa aa aa"), (6, "aa aa")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_holders(spark, block):
    docs = spark.createDataFrame(DOCS, "document_id long, text string")
    passages = spark.createDataFrame(PASSAGES, "query_id long, q string")
    found = evaluation.holders(docs, passages, block)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(q, d) for q, p in PASSAGES for d, t in DOCS if t is not None and p in t], key=key)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and evaluation.holders(docs, passages.limit(0)).isEmpty()
