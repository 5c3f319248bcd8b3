from __future__ import annotations

import random

from pyspark.sql import functions as F

from veilframe.operators import conversations as C

MESSAGES = {
    "Please verify HIPAA Safe Harbor compliance for the dataset.": "audit",
    "Why did the pipeline fail? Check for errors.": "failure",
    "Inspect latency benchmarks and performance": "latency",
    "audit the failed traces": "audit",
    "list the SPANS": "trace",
    "which tables are there": "schema",
    "average cost by patient": "statistics",
    "hello": "recent",
    "": "recent",
}


def test_intents(spark):
    rows = [(i, 0, "user", text) for i, text in enumerate(MESSAGES)]
    tagged = C.tag_intents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.intent for r in tagged.orderBy("conv_id").collect()] == list(MESSAGES.values())


def test_latest_user_message(spark):
    rows = [
        (1, 0, "user", "First"),
        (1, 2, "user", "Why did it CRASH"),
        (1, 3, "assistant", "no idea"),
        (2, 0, "system", "You are"),
        (3, 0, "user", None),
        (3, 1, "assistant", "?"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.message, r.intent) for r in C.tag_intents(df).collect()}
    assert got == {1: ("why did it crash", "failure"), 2: ("", "recent"), 3: ("", "recent")}


def test_tag_texts(spark):
    df = spark.createDataFrame([("An ERROR",), (None,)], "t string")
    assert [r.intent for r in C.tag_texts(df, "t").collect()] == ["failure", "recent"]
    assert C.tag_texts(df, "t", [], "x").select(F.max("intent")).first()[0] == "x"


def test_latest_message_equals_brute_force(spark):
    """Ties, repeated rows, null turns and ids; numbers alone are aggregated."""
    rng = random.Random(7)
    rows = []
    for conv_id in [*range(60), None]:
        for _ in range(rng.randrange(7)):
            turn = rng.choice([None, 0, 1, 2, 2**63 - 1, -(2**63), -5])
            rows.append((conv_id, turn, rng.choice(["user", "user", "assistant", None]), rng.choice([None, "", "A", "b", "Zz"])))
    rows += [(3, 9, "user", "Twice")] * 4
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    latest = C.latest_user_message(df)
    found = latest.collect()
    got = {r.conv_id: r.message for r in found}
    assert len(got) == len(found) and set(got) == {r[0] for r in rows}
    for conv_id, message in got.items():
        said = [(r[1] is not None, r[1] or 0, (r[3] or "").lower()) for r in rows if r[0] == conv_id and r[2] == "user"]
        last = [m for known, turn, m in said if (known, turn) == max((k, t) for k, t, _ in said)]
        assert message in last if said else message == ""
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_ties_are_settled_alike_in_any_order(spark):
    rows = [(1, 5, "user", t) for t in ("one", "two", "three", "four")]
    schema = "conv_id long, turn long, role string, text string"
    found = {C.latest_user_message(spark.createDataFrame(r, schema)).first().message for r in (rows, rows[::-1])}
    assert len(found) == 1
