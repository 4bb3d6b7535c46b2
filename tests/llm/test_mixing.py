import math

import pytest
from hypothesis import given, settings, strategies as st

from packetflow.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, n_tokens bigint, copies int"
WEIGHTS = "source string, target_share double, max_repeats int"


def mix(spark, docs, weights, **more):
    d = spark.createDataFrame([(i, t, s, 0, 0) for i, (t, s) in enumerate(docs)], DOCS)
    taken, report = M.mixture(d, spark.createDataFrame(weights, WEIGHTS), **more)
    return {r.doc_id: r for r in taken.collect()}, {r.source: r for r in report.collect()}


def test_mixture(spark):
    text = "the title of the vehicle was sent to the owner by mail "
    docs = [(text * (1 + i % 5), ("A a", "a-A ", "b")[i % 3]) for i in range(900)] + [(text, None), (text, "other"), ("", "b"), (None, "b")]
    taken, report = mix(spark, docs, [("a_a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)])
    assert len(taken) == len(docs) and taken[900].copies == taken[901].copies == 0
    total = sum(r.n_tokens * r.copies for r in taken.values())
    assert abs(report["a_a"].reached_share - 1 / 3) < 0.01 and abs(report["b"].reached_share - 2 / 3) < 0.01 and report["none"].reached_share == 0
    assert report["none"].capped and not report["a_a"].capped and report["a_a"].mixed_tokens + report["b"].mixed_tokens == total
    again, _ = mix(spark, docs, [("a_a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)])
    assert {i: r.copies for i, r in taken.items()} == {i: r.copies for i, r in again.items()}


def test_all_capped_and_empty(spark):
    taken, report = mix(spark, [("one two three", "a")], [("a", 1.0, 2)], total=1e6)
    assert taken[0].copies == 2 and report["a"].capped
    taken, report = mix(spark, [], [("a", 1.0, 2)])
    assert not taken and report["a"].reached_share == 0 and report["a"].mixed_tokens == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.integers(0, 5), st.integers(0, 1000)), min_size=1), st.floats(1, 5000))
def test_water_fill(sources, total):
    share, most, tokens = ({s: v[i] for s, v in sources.items()} for i in range(3))
    give = M.water_fill(tokens, share, most, total)
    cap = {s: tokens[s] * most[s] for s in sources}
    assert all(-1e-9 <= give[s] <= cap[s] + 1e-6 for s in sources)
    assert math.fsum(give.values()) == pytest.approx(min(total, math.fsum(cap.values())), abs=1e-6)
    free = [give[s] / share[s] for s in sources if give[s] < cap[s] - 1e-6]
    assert all(x == pytest.approx(free[0]) for x in free)
    assert all(give[s] / share[s] <= free[0] + 1e-6 for s in sources) if free else True
