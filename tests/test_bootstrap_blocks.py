"""Repetitions of the bootstrap are summed side by side: the same draws whatever their number, and no race in one task."""

from lapstream.operators import evaluation as E


def test_blocks_of_repetitions(spark):
    df = spark.range(600).selectExpr("concat('2024 :: ', id % 13) as race", "cast(id % 3 = 0 as int) as target_y", "(id * 37 % 100) / 100.0D as raw_proba", "(id * 53 % 90) / 100.0D as other")
    few, more = ({r["rep"]: r["delta"] for r in E.ap_bootstrap(df, "other", n).collect()} for n in (7, 25))
    assert sorted(more) == list(range(25)) and few == {k: more[k] for k in range(7)}
    plan = E.ap_bootstrap(df, "other", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(race" not in plan
