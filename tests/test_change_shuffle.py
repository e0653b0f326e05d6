"""What applying a log of changes shuffles, and creates that follow a delete."""

from __future__ import annotations

from ledgerflow.operators import changes as chg

CHANGES = "name string, seq bigint, op string, status string, total int"


def shuffled_rows(df) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if "QueryStage" in name:
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_changes_are_summed_before_they_are_shuffled(spark):
    base = spark.range(40).selectExpr("concat('K', id) AS name", "'new' AS status", "CAST(id AS int) AS total")
    log = spark.range(0, 8000, 1, 2).selectExpr("concat('K', id % 20) AS name", "id AS seq", "'update' AS op",
                                                "if(id % 3 = 0, 'open', null) AS status", "CAST(id AS int) AS total")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = chg.apply_changes(base, log, "name")
        assert shuffled_rows(out) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = {r.name: (r.status, r.total) for r in out.collect()}
    assert len(got) == 40 and got["K3"] == ("open", 7983) and got["K30"] == ("new", 30)


def test_creates_before_and_after_a_delete(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "old", 2), ("c", "old", 3)], "name string, status string, total int")
    log = spark.createDataFrame([
        ("a", 1, "create", "refused", 9), ("a", 2, "delete", None, None), ("a", 3, "create", "x", None), ("a", 4, "create", "y", 8),
        ("a", 5, "update", None, 7),  # alive by 3; 4 is refused
        ("n", 1, "create", "x", 1), ("n", 2, "update", "y", 2), ("n", 3, "delete", None, None), ("n", 4, "create", None, 5),
        ("b", 1, "create", "refused", 9), ("b", 2, "update", None, 4),
        ("c", 1, "create", "refused", 9), ("c", 2, "delete", None, None), ("c", 3, "update", "z", 1),
        ("m", 1, "create", "x", 1), ("m", 2, "create", "y", 2), ("m", None, "update", "z", 3), (None, 1, "create", "x", 1),
    ], CHANGES)
    got = sorted(tuple(r) for r in chg.apply_changes(base, log, "name").collect())
    assert got == [("a", "x", 7), ("b", "old", 4), ("m", "x", 1), ("n", None, 5)]


def test_keys_that_repeat_in_the_table(spark):
    base = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3), ("b", "q", 4), ("c", "p", 5), ("c", "q", 6),
                                  ("d", "p", 7), ("d", "q", 8), ("e", "p", 9), (None, "p", 10), (None, "q", 11)],
                                 "name string, status string, total int")
    log = spark.createDataFrame([("a", 1, "update", None, 20), ("c", 1, "delete", None, None), (None, 1, "update", "x", 1),
                                 ("d", 1, "delete", None, None), ("d", 2, "create", "n", 30), ("e", 1, "write", "z", None)], CHANGES)
    got = sorted(tuple(r) for r in chg.apply_changes(base, log, "name").fillna("-", ["name"]).collect())
    assert got == sorted([("a", "p", 20)] * 2 + [("a", "q", 20)] * 2 + [("b", "p", 3), ("b", "q", 4)] + [("d", "n", 30)] * 4
                         + [("e", "z", 9), ("-", "p", 10), ("-", "q", 11)])
