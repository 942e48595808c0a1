from cambium.operators import names
from cambium.streaming import names as stream

REQUEST = "doc_id string, symbol_id string, new_state string, new_name string, origin string, actor string, at long"


def test_requests_fold_into_the_log(spark, tmp_path):
    log, source = f"{tmp_path}/log", f"{tmp_path}/requests"

    def arrive(*rows):
        spark.createDataFrame([("d", s, state, name, "review", "me", at) for s, state, name, at in rows], REQUEST).coalesce(1).write.mode("append").parquet(source)
        q = stream.start(spark, spark.readStream.schema(REQUEST).parquet(source), log, f"{tmp_path}/state")
        q.awaitTermination(120)
        assert q.exception() is None

    arrive(("s1", "suggested", "total", 1), ("s1", "approved", None, 2), ("s2", "suggested", "count", 3))
    arrive(("s2", "rejected", None, 4), ("s1", "approved", None, 5))
    events = stream.read_log(spark, log)
    assert {(r.symbol_id, r.state, r.name) for r in names.current(events).collect()} == {("s1", "approved", "total"), ("s2", "rejected", None)}
    assert events.count() == 4 and names.violations(events).count() == 0
    again = spark.createDataFrame([("d", "s2", "rejected", None, "review", "me", 4)], REQUEST)
    stream.fold(spark, again, log, 1)  # the batch runs again
    assert stream.read_log(spark, log).count() == 4
