"""What the operators leave in the driver's memory."""

import contextlib
import re
import tracemalloc

import numpy as np

from kinslice.llm import common, packing, toxicity


def test_evidence_makes_no_copy_of_all_features():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 18, 20_000)).astype(np.int32) for _ in range(200)]
    labels = (np.arange(200) % 4 == 0).astype(np.float32)
    tracemalloc.start()
    ratio, odds = toxicity.evidence(rows, labels, 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows) + 8 * (8 << 18)
    one, all_ = (np.bincount(np.concatenate(x), minlength=1 << 18) for x in ([r for r, y in zip(rows, labels, strict=True) if y], rows))
    assert np.array_equal(odds, np.log((one + 0.5) / (50 + 1)) - np.log((all_ - one + 0.5) / (150 + 1))) and len(ratio) == 1 << 18


def test_fit_is_the_mean_of_late_epochs():
    rows = [np.array([k % 2, 5], np.int32) for k in range(60)]
    labels = np.array([k % 2 for k in range(60)], np.float32)
    one = toxicity.fit(rows, labels, bits=4, epochs=1)
    assert one.weights.dtype == one.factors.dtype == np.float32 and isinstance(one.bias, float)
    m = toxicity.fit(rows, labels, bits=4, epochs=4)
    assert m.weights[1] > 0 > m.weights[0] and m.weights.dtype == np.float32


def test_give_back(spark, monkeypatch):
    monkeypatch.setattr(common, "suppress", lambda *kinds: contextlib.nullcontext())  # this JVM and system can
    common.give_back(spark)
    calls = []
    monkeypatch.setattr(common, "give_back", calls.append)
    assert common.cut(spark.range(3)).count() == 3 and calls == [spark]


def test_packing_joins_by_one_number(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('word ', 3 + CAST(id AS INT)) AS text").repartition(20)
    out = packing.pack(docs, fan_in=4, size=64)
    joins = re.findall(r"Join \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert joins and not any(re.search(r"^p?node#\w+, p?bin#", x) for x in joins)
    by = {}
    for s, at, n in out.select("sequence_id", "offset", "length").collect():
        by.setdefault(s, []).append((at, n))
    for places in by.values():
        at = 0
        for start, n in sorted(places):
            assert start == at
            at += n
        assert at <= 64
