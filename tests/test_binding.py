"""Plans of the table binding."""

from gablestat.plans.binding import assessments


def test_years_reach_the_scan(spark):
    plan = assessments(spark, "/root/testdata/sf0.001", ["pid", "total_value"], [1996, 1997])._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in pushed and "LessThan(l_shipdate,1997-01-01T00:00)" in pushed
