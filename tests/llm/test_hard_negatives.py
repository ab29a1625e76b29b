"""Hard negatives against all pairs, and the interval of the codes against exact products."""

import numpy as np
import plain
import pytest

from dossierflow.llm import hard_negatives, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, score string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, made):
    return spark.createDataFrame([(*r, 1, "x") for r in made], SCHEMA)


def every(n):
    return F.col("vec_id") % n == 0


@pytest.mark.parametrize("dims", [1, 5, 64, 65, 200])
def test_interval_holds(dims):
    draw = np.random.default_rng(dims)
    a, b = (np.floor(256 * draw.normal(size=(n, dims)) * draw.exponential(size=(n, 1))) for n in (30, 200))
    a[0], b[0], b[1], b[2] = 0, 0, a[1], -a[1]
    wide = hard_negatives.padded(dims)
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - dims)))
    least, most = hard_negatives.bounds(hard_negatives.asked(pad(a)), hard_negatives.coded(pad(b)))
    exact = a @ b.T
    assert (least <= exact).all() and (exact <= most).all()
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    assert ((most - least)[size > 0] / size[size > 0]).mean() < 0.4


def test_given_table(spark, sf):
    found = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows(queries.op13_hard_negatives(spark, sf)) == plain.hard_negatives(found, lambda k: k % 50 == 0)


@pytest.mark.parametrize("dims, labels, scale", [(3, 2, 1.0), (3, 1, 1.0), (70, 3, 1.0), (4, 3, 1000.0), (2, 4, 1.2e5)])
def test_ties_and_sizes(spark, monkeypatch, dims, labels, scale):
    """Small whole vectors tie often; large ones leave 16 bits, then the whole numbers that doubles hold.  Cells of a few rows."""
    monkeypatch.setattr(hard_negatives, "ROW_BYTES", 20000)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 4000)
    draw = np.random.default_rng(dims)
    made = [(i, [float(x) for x in np.round(draw.normal(size=dims), 1 if dims < 9 else 6) * scale], int(draw.integers(labels))) for i in range(400)]
    got = rows(hard_negatives.mined(table(spark, made).repartition(5), every(9)))
    assert got == plain.hard_negatives(made, lambda k: k % 9 == 0)


def test_odd_rows(spark):
    near = [(i, [1.0, 0.1 * i, 0.0], i % 2) for i in range(12)]
    odd = [
        (None, [1.0, 0.0, 0.0], 1), (20, None, 1), (21, [1.0, None], 1), (22, [float("nan"), 0.0], 0), (23, [float("inf")], 0), (24, [1.0, 0.0], None),
        (25, [], 1), (26, [0.0, 0.0, 0.0], 0), (27, [1.0], 1), (28, [0.5, 0.5, 0.5, 0.5], 0), (3, [0.2, 0.9], 1), (4, [0.2, 0.9], 0), (-5, [0.9, 0.3], -3),
    ]
    made = near + odd + near[:4] * 3
    assert rows(hard_negatives.mined(table(spark, made), every(2))) == plain.hard_negatives(made, lambda k: k % 2 == 0)
    assert rows(hard_negatives.mined(table(spark, made).limit(0), every(2))) == []
    assert rows(hard_negatives.mined(table(spark, odd[:6]), every(1))) == []
    assert rows(hard_negatives.mined(table(spark, near), F.lit(None).cast("boolean"))) == []


def test_huge_components(spark):
    made = [(i, [1e308 * (-1) ** (i // 3), 1e-300, -1e308], i % 2) for i in range(8)]
    got = hard_negatives.mined(table(spark, made), every(4)).collect()
    assert all(abs(r.positive_score) <= hard_negatives.SCORE_LIMIT for r in got)


def test_a_vector_that_is_a_third_of_all_rows(spark):
    draw = np.random.default_rng(3)
    made = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [float(x) for x in draw.normal(size=3)], 0 if i % 3 == 0 else i % 4) for i in range(600)]
    assert rows(hard_negatives.mined(table(spark, made), every(50))) == plain.hard_negatives(made, lambda k: k % 50 == 0)
