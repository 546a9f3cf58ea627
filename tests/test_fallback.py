"""What messages without history fall back on: made per author, looked up once for all fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.functions.scaling import scale_row
from agorascope.functions.tags import scale_rows
from agorascope.operators.context import message_contexts
from agorascope.operators.profile import (
    context_profile, fit_totals, message_profiles, with_fallback_left_out, with_tags,
)
from test_units import fixture


@pytest.mark.parametrize("mode", ["sequential", "standard"])
def test_matrices_are_scaled_as_rows(spark, mode):
    rng = random.Random(1)
    rows = [[rng.choice([0.0, 1.0, 2.0, 5.0, 0.5, None]) for _ in range(6)] for _ in range(300)]
    rows += [[float(rng.randrange(1, 9)) for _ in range(6)] for _ in range(100)] + [[1.0] * 6, [None] * 6, [0.0] * 6]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    want = {r.i: r.s for r in df.select("i", scale_row(F.col("v"), 6, mode).alias("s")).collect()}
    got = scale_rows(np.array([[np.nan if v is None else v for v in r] for r in rows]), mode)
    for i, row in enumerate(got.tolist()):
        assert [None if v != v else v for v in row] == want[i], rows[i]


def test_left_out_tags_are_looked_up_once_for_all_fits(spark):
    design, _ = fixture(spark)
    c = design.corpus
    totals = fit_totals(c.messages, design.folds, 3, c)
    new = message_contexts(c, ["tree"]).where("n = 1").drop("history")
    found = with_fallback_left_out(new, totals, design.folds, c, [0, 1, 2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan  # no row is scaled by itself
    assert found.count() == 3 * new.count()
    assert {r.fit for r in found.select("fit").distinct().collect()} == {0, 1, 2}


def test_fallback_values_are_made_per_author(spark):
    design, _ = fixture(spark)
    c = design.corpus
    _, new = with_tags(message_contexts(c, ["tree"]), design.forum, c, [0, 1, 2])
    assert {"diversity", "tag_total", "scaled_tags"} <= set(new.columns)
    # the same profiles as from the tags of each row
    got = context_profile(new, len(c.tags)).select("fit", "message_id", "tags", "diversity", "avg_tag_msg")
    plain = context_profile(new.drop("diversity", "tag_total", "scaled_tags"), len(c.tags)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.count() > 0


def test_profiles_are_finished_before_they_are_repeated(spark):
    design, _ = fixture(spark)
    seen = []

    def finish(part):
        seen.append(part.columns)
        return part.withColumn("done", F.lit(1))

    out = message_profiles(design.corpus, ["tree"], design.folds, 3, finish=finish)
    assert "fit" not in seen[0] and "fit" in seen[1]
    want = message_profiles(design.corpus, ["tree"], design.folds, 3)
    assert sorted(map(repr, out.drop("done").select(*want.columns).collect())) == sorted(map(repr, want.collect()))
