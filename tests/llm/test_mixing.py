"""Rates and copies against a plain inversion of the Poisson distribution."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from tideline.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, copy string"


def plain_copies(seed: int, key: str, rate: float) -> int:
    at = int(hashlib.md5(f"{seed}|copies|{key}".encode()).hexdigest()[:13], 16) / 2**52
    copies, term = 0, math.exp(-rate)
    below = term
    while below <= at:
        copies += 1
        term *= rate / copies
        below += term
    return copies


def docs(spark, n=600):
    rows = [(i, "t" * (i % 7 + 1), "big" if i % 3 else f"s{i % 5}", "x") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rates(spark):
    df = spark.createDataFrame([(1, "aaaa", "a", ""), (2, "bb", "b", ""), (3, None, "c", ""), (4, "nn", None, "")], SCHEMA)
    got = {r.source: r.rate for r in mixing.source_rates(df, alpha=0.0).collect()}
    assert got == pytest.approx({"a": 8 / 3 / 4, "b": 8 / 3 / 2, "c": 1.0, None: 8 / 3 / 2})
    wanted = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("other", 5.0), ("b", -1.0)], "source string, weight double")
    got = {r.source: r.rate for r in mixing.source_rates(df, wanted, total=80).collect()}
    assert got == pytest.approx({"a": 20.0, "b": 0.0, "c": 1.0, None: 0.0})
    assert mixing.source_rates(df.limit(0)).collect() == []


@pytest.mark.parametrize("rate", [0.0, 0.2, 1.0, 3.7, 40.0, 900.0])
def test_copies(spark, rate, limits):
    df = docs(spark, 80)
    rates = df.select("source").distinct().selectExpr("source", f"double({rate}) as rate")
    got = Counter(r.doc_id for r in mixing.replicate(df, rates, seed=5).collect())
    want = {i: plain_copies(5, str(i), rate) for i in range(80)} if rate < 700 else None
    if want is None:  # plain inversion underflows
        assert all(700 < n < 1100 for n in got.values()) and len(got) == 80
    else:
        assert dict(got) == {i: n for i, n in want.items() if n}


def exact_copies(seed: int, key: str, rate: int) -> int:
    """By fractions of the greatest term, summed exactly enough from the mean outwards."""
    at = int(hashlib.md5(f"{seed}|copies|{key}".encode()).hexdigest()[:13], 16) / 2**52
    reach = int(14 * math.sqrt(rate)) + 40
    low = max(0, rate - reach)
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in (rate,)]
    terms = {rate: math.exp(logs[0])}
    for k in range(rate + 1, rate + reach):
        terms[k] = terms[k - 1] * rate / k
    for k in range(rate, low, -1):
        terms[k - 1] = terms[k] * k / rate
    total, copies = 0.0, low
    for k in sorted(terms):
        total += terms[k]
        if total > at:
            return k
    return copies


@pytest.mark.parametrize("rate", [900, 100_000, 9_900_000])
def test_high_rates(spark, rate):
    """In time that grows with the spread, not with the rate; only the numbers of copies are built here."""
    df = docs(spark, 3 if rate > 1000 else 60)
    rates = df.select("source").distinct().selectExpr("source", f"double({rate}) as rate")
    got = {r.doc_id: r.n for r in mixing.replicate(df, rates, seed=5).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    # Terms at high rates carry the rounding of logarithms, which may move a draw by one.
    assert all(abs(got[i] - exact_copies(5, str(i), rate)) <= (1 if rate > 1000 else 0) for i in got) and len(got) == df.count()


@pytest.mark.parametrize("rate", [3e9, 1e7, float("nan"), float("inf")])
def test_rates_beyond_the_limit(spark, rate):
    df = docs(spark, 3)
    rates = spark.createDataFrame([("big", rate), ("s0", -1.0)], "source string, rate double")
    with pytest.raises(ValueError, match="max_copies"):
        mixing.replicate(df, rates)


def test_distributions_of_odd_rates(spark):
    rates = spark.createDataFrame([("zero", 0.0), ("below", -2.0), (None, None), ("low", 1e-9), ("some", 60.0)], "source string, rate double")
    got = {r._source: r for r in mixing._distributions(rates).collect()}
    assert got["zero"]._cdf == got["below"]._cdf == got[None]._cdf == [1.0]
    assert got["low"]._cdf[0] == pytest.approx(1 - 1e-9, rel=1e-15) and got["some"]._cdf[-1] == pytest.approx(1, abs=1e-13)


def test_order_weights_nulls_and_repeats(spark):
    rows = [(None, "a", None, "q"), (None, "a", None, "q"), (1, None, "s", "q"), (1, None, "s", "q"), (2, "", "s", "q"), (3, "long " * 5000, "s", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    rates = spark.createDataFrame([("s", 30.0), (None, 30.0)], "source string, rate double")
    got = Counter((r.doc_id, r.text) for r in mixing.replicate(df, rates, 1).collect())
    assert got[(None, "a")] == 2 * plain_copies(1, "text:a", 30.0)
    assert got[(1, None)] == 2 * plain_copies(1, "1", 30.0)
    mixed = mixing.mix(docs(spark), seed=3)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    keys = [r.mix_key for r in mixed.collect()]
    assert keys == sorted(keys)
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.source] += len(r.text)
    held = Counter()
    for r in docs(spark).collect():
        held[r.source] += len(r.text)
    weights = {s: n**0.5 for s, n in held.items()}
    for s in held:
        assert sizes[s] == pytest.approx(weights[s] / sum(weights.values()) * sum(held.values()), rel=0.35)
    assert mixing.mix(df.limit(0)).collect() == []
