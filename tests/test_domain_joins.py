"""tables that grow with the domains or sites are not sent to the driver."""

from cytolake.operators import models, significance


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_domains_are_merges(spark):
    model = models.Hmm((0.5, 0.5), ((0.9, 0.1), (0.1, 0.9)), (((1.0, 5.0),), ((5.0, 1.0),)), (0, 1))
    regions = spark.createDataFrame([("a", 10, 40, 3.0, "x")], "chrom string, start long, end long, score double, name string")
    sites = spark.createDataFrame([("a", p, 10, 1 if 12 <= p < 38 else 9) for p in range(0, 60, 2)], "chrom string, pos long, n_reads long, n_meth long")
    moved = models.sharpened(regions, sites, 10, model)
    scored = models.boundary_scores(regions, sites, 10, model)
    rows = spark.createDataFrame([("a", 1, 5, [1.0], [2.0]), ("a", 1, 7, [0.0], [3.0])], "chrom string, segment long, pos long, meth array<double>, reads array<double>")
    p = significance.empirical_p(regions, regions)
    assert [tuple(x)[:3] for x in moved.collect()] == [("a", 12, 36)]
    assert scored.count() == 1 and p.count() == 1
    for df in (moved, scored, p):
        assert "Join" in _plan(df)
    assert "BroadcastHashJoin" not in _plan(moved) and "BroadcastHashJoin" not in _plan(scored)
    assert any("SortMergeJoin" in line and "score" in line for line in _plan(p).splitlines())
    assert any("SortMergeJoin [k" in line for line in _plan(models.shuffled(rows)).splitlines())
