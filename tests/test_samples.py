"""Draws and sign tests of larger samples, for the queries answer_rate, depth_pairs, curve_residuals, flip_distances, planned_pairs,
recall_line (draws), arm_tests, median_interval and paired_summary (sign tests)."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import stats as S


def test_draws_are_not_broadcast(spark, capsys):
    """Spark must know that the draws are many: 200 times 90,000 rows went through the driver."""
    rows = spark.range(90_000).select(F.col("id").alias("idx"), F.lit(1.0).alias("value"))
    for df in (B.with_draws(rows, 90_000), S.boot_means(rows, [], 90_000)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_draws_of_no_rows(spark):
    assert S.draws(spark, 0).count() == 0
    assert S.draws(spark, 7, 3).agg(F.sum("weight"), F.min("idx"), F.max("rep")).first() == (21, 0, 2)


@pytest.mark.parametrize("n", [1, 2, 5, 31, 1074, 4416, 9000, 100_001])
def test_sign_test_beyond_the_range_of_a_double(spark, n):
    ks = sorted({0, 1, n // 2, max(0, n // 2 - round(n**0.5)), n // 2 - n // 10, n})
    row = spark.range(1).select(*[S.sign_test_p(F.lit(k).cast("bigint"), F.lit(n).cast("bigint")).alias(f"p{i}") for i, k in enumerate(ks)]).first()
    for got, k in zip(row, ks, strict=True):
        least = min(k, n - k)
        term, total = Fraction(comb(n, least)), 0
        if n <= 10_000:
            total, term = 0, 1
            for i in range(least + 1):
                total += term
                term = term * (n - i) // (i + 1)
            want = min(1.0, float(Fraction(2 * total, 2**n)))
            assert got == pytest.approx(want, rel=1e-10, abs=1e-300)
        elif least > n // 2 - 1000:
            assert 0 < got <= 1
