"""Retrieval metrics and rates against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.evaluation import evaluate_retrieval, relevance_rows
from quern.operators.retrieval import rag_rates


def plain(v, cases, ks):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    out = {}
    for case, q, listed, graded in cases:
        order = np.lexsort((np.arange(len(v)), -np.round(unit @ (q / np.linalg.norm(q)), 12))).tolist()
        relevant, grades = set(listed or []), dict(graded or {})
        relevant = relevant or set(grades)
        first = next((n for n, i in enumerate(order, 1) if i in relevant), None)
        row = {"n": len(relevant), "rr": 1 / first if first else 0.0, "top_ids": order[: max(ks)]}
        for k in ks:
            gains = [grades.get(i, 1.0 if i in relevant else 0.0) for i in order[:k]]
            ideal = sorted(grades.values() or [1.0] * len(relevant), reverse=True)[:k]
            total = lambda gs: sum(g / math.log2(n + 1) for n, g in enumerate(gs, 1))
            hits = len(set(order[:k]) & relevant)
            row |= {f"hits_{k}": hits, f"recall_{k}": hits / len(relevant) if relevant else 0.0, f"precision_{k}": hits / k, f"ndcg_{k}": total(gains) / total(ideal) if total(ideal) else 0.0}
        out[case] = row
    return out


def test_retrieval_metrics_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(240, 8))
    make = lambda ids: {int(i): float(rng.integers(0, 4)) for i in ids}
    cases = [
        (1, v[0], list(range(0, 240, 3)), None), (2, v[1], None, make(range(1, 240, 2))), (3, v[2], [5, 9, 9, 200], make([5, 7, 11])), (4, v[3], None, None),
        (5, v[4], [], make([int(np.argmin(v @ v[4]))])), (6, v[5], [int(np.argmin(v @ v[5]))], None), (7, v[6], [999], {}), (8, v[7], None, {3: 0.0, 4: 0.0}),
    ]
    df = spark.createDataFrame([(c, q.tolist(), r, g) for c, q, r, g in cases], "case_id long, embedding array<double>, relevant_ids array<long>, relevance map<long,double>")
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<double>").repartition(3)
    ks = (1, 3, 10)
    got = {r.case_id: r.asDict() for r in evaluate_retrieval(df.select("case_id", "embedding"), relevance_rows(df), index, ks).collect()}
    for case, row in plain(v, cases, ks).items():
        for name, value in row.items():
            assert got[case][name] == pytest.approx(value, abs=1e-9), (case, name)
    narrow = spark.createDataFrame([(1, [1.0, 2.0])], "case_id long, embedding array<double>")
    with pytest.raises(ValueError, match="8 values"):
        evaluate_retrieval(narrow, relevance_rows(df), index, ks)
    assert evaluate_retrieval(narrow.limit(0), relevance_rows(df), index, ks).count() == 0


def test_rates_of_grouping_sets(spark):
    rows = [(k, c, None if i else "empty", i % 2 == 0, i, "src" if i else None, i == 3, i == 1) for k in (1, 3) for c in ("a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, "top_k int, categoria string, error string, abstained boolean, n_chunks int, fuente_esperada string, out_of_corpus boolean, source_hit boolean")
    out = {(r.top_k, r.categoria): r for r in rag_rates(df).collect()}
    assert len(out) == 7 and {r.level for r in out.values()} == {0, 1, 3}
    r = out[(1, "a")]
    # two rows expect a source and are in the corpus, one has it; one row is out of it and doesn't abstain
    assert (r.n, r.errors, r.abstained, r.mean_chunks, r.source_hit_rate, r.right_abstention_rate) == (4, 1, 2, 1.5, 0.5, 0.0)
    assert out[(None, None)].n == 16 and out[(3, None)].n == 8
    assert rag_rates(df.where(~F.col("out_of_corpus"))).where("level = 3").first().right_abstention_rate is None


def test_shared_relevance_equals_relevance_in_rows(spark):
    """Groups that cases share, their own rows left out, give what a row for each case and member gives, and only the members are written."""
    from quern.operators import evaluation as E

    rng = np.random.default_rng(6)
    v, labels = rng.normal(size=(90, 6)), rng.integers(0, 7, 90)
    labels[0], labels[3] = 8, 8
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<double>")
    group = lambda i, graded: int(2 * labels[i] + graded)
    gain = lambda i, graded: float(1 + i % 3) if graded else None
    asked = list(range(0, 90, 3))
    members = [(group(i, g), i, not g, gain(i, g)) for i in range(90) for g in (False, True)]
    rows = [(c, i, c % 2 == 1, gain(i, c % 2 == 0)) for c in asked for i in range(90) if labels[i] == labels[c] and i != c]
    shared = E.SharedRelevance(spark.createDataFrame([(c, group(c, c % 2 == 0), c) for c in asked], "case_id long, group long, own long"), spark.createDataFrame(members, "group long, id long, listed boolean, gain double"))
    cases = index.where(F.col("pos") % 3 == 0).withColumnRenamed("pos", "case_id")
    written = []
    with pytest.MonkeyPatch.context() as m:
        keep = E.materialize
        m.setattr(E, "materialize", lambda df, name: written.append((name, out := keep(df, name))) or out)
        got = sorted(map(tuple, evaluate_retrieval(cases, shared, index, (1, 4)).collect()))
    want = sorted(map(tuple, evaluate_retrieval(cases, spark.createDataFrame(rows, "case_id long, id long, listed boolean, gain double"), index, (1, 4)).collect()))
    assert len(got) == 30 and [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[-1] == b[-1] and a[2:-1] == pytest.approx(b[2:-1], abs=1e-12)
    assert max(df.count() for _, df in written) <= len(members)
