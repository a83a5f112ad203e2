"""no table that grows with the documents goes to the driver."""

from cytolake.llm import simhash
from cytolake.llm.shared import written


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args)

    monkeypatch.setattr(simhash, "written", seen)
    rows = [(k, f"word{k % 50} and some other words {'again ' * (k % 3)}") for k in range(200)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 200
    assert sum("Generate" in p for p in plans) >= 2
    assert all("Generate" not in p or "BroadcastExchange" not in p for p in plans)
