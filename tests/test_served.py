"""Confidences, responses, streams and caches: what they refuse, and brute force where there is no SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import canon
from evalspark.operators import catalogs, escalation, latency, pairs, sampling, steps, turns


def confidence(spark, kind, called, spans, lps, tops):
    schema = "kind string, called array<string>, spans array<struct<name:string,start:int,end:int>>, lps array<double>, tops array<struct<id:int,lp:double>>"
    df = spark.createDataFrame([(kind, called, spans, lps, tops)], schema)
    starts = F.transform("lps", lambda x, i: i * 4)
    found = escalation.step_confidence(F.col("kind"), F.col("called"), F.col("spans"), F.col("lps"), starts, F.transform(starts, lambda s: s + 4), F.col("tops"), 7)
    return df.select(found.alias("c")).first().c


def test_step_confidence(spark):
    tops = [(7, -0.5), (8, -1.0)]
    sure = confidence(spark, "tool_call", ["f", "g"], [("f", 4, 8), ("g", 9, 12)], [-9.0, -0.2, -0.4, -9.0], tops)
    assert sure.kind == "tool_call" and sure.name_tokens == 2 and not sure.bounded
    assert abs(sure.name_confidence - 2.718281828**-0.4) < 1e-6 and abs(sure.step_confidence - 2.718281828**-0.5) < 1e-6
    reply = confidence(spark, "reply", [], [], [-1.0], [(8, -2.0)])
    assert reply.kind == "reply" and reply.bounded and abs(reply.step_confidence - (1 - 2.718281828**-2)) < 1e-6
    for case in ((None, [], [], [-1.0], tops), ("tool_call", ["f"], [("g", 0, 1)], [-1.0], tops), ("tool_call", ["f"], [("f", 40, 41)], [-1.0], tops), ("tool_call", ["f"], [], [-1.0], tops)):
        got = confidence(spark, *case)
        assert got.kind == "unparsed" and got.step_confidence is None and got.p_call is None and not got.bounded
    assert confidence(spark, "tool_call", ["f"], [("f", 0, 1)], [-1.0], None).step_confidence is None


def body(tokens, values, n=1):
    choice = {"text": "t", "logprobs": {"tokens": tokens, "token_logprobs": values, "top_logprobs": [{"token_id:4": -0.5}]}}
    return json.dumps({"choices": [choice] * n})


def test_responses(spark):
    read = lambda text: spark.createDataFrame([(text,)], "b string").select(escalation.response_scores(F.col("b")).alias("r")).first().r
    good = read(body(["token_id:3", "token_id:-1"], [-1.0, -2.0]))
    assert good.token_ids == [3, -1] and good.token_logprobs == [-1.0, -2.0] and [tuple(x) for x in good.first] == [(4, -0.5)]
    assert read(json.dumps({"choices": [{"text": "x"}]})).token_ids == []
    for bad in (body(["token_id:3"], [-1.0], n=2), json.dumps({}), body(["token_id:3"], [-1.0, -2.0]), body(["three"], [-1.0])):
        with pytest.raises(Exception, match="one completion|unequal|no token_id"):
            read(bad)
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1, 2], [{1: 0.5}])], "i array<int>, t array<map<int,double>>").select(escalation.emitted_logprobs(F.col("i"), F.col("t"))).collect()


def test_streams_need_a_usage(spark):
    rows = spark.createDataFrame([("a", 1, "", None), ("a", 2, "x", None), ("a", 3, "", 8), ("b", 1, "", 0)], "r string, at int, t string, u int")
    assert {tuple(x) for x in latency.streamed(rows, "r", "at", "t", "u").collect()} == {("a", 2, 3, 8, 3), ("b", None, 1, 0, 1)}
    with pytest.raises(Exception, match="no usage in the stream of a"):
        latency.streamed(rows.where("r = 'a' and at < 3"), "r", "at", "t", "u").collect()


def served(prompts, size):
    """The pool as a loop over single tokens."""
    held, used, out = [[] for _ in range(size)], [0] * size, []
    for clock, prompt in enumerate(prompts, 1):
        shared = []
        for slot in held:
            n = 0
            while n < min(len(slot), len(prompt)) and slot[n] == prompt[n]:
                n += 1
            shared.append(n)
        most = max(shared)
        if most:
            best = min((i for i in range(size) if shared[i] == most), key=lambda i: used[i])
        else:
            best = min(range(size), key=lambda i: (len(held[i]) > 0, used[i]))
        out.append((best, most, max(0, min(most, len(prompt) - 1))))
        held[best], used[best] = prompt, clock
    return out


def test_slots_equal_the_loop(spark):
    r = random.Random(3)
    prompts = [[r.randint(0, 1) for _ in range(r.randint(0, 5))] for _ in range(60)]
    df = spark.createDataFrame([("p", i, p) for i, p in enumerate(prompts)] + [("q", 0, None)], "pool string, at int, ids array<int>").repartition(3)
    got = sorted((x.at, x.slot, x.shared, x.reused) for x in steps.slot_choices(df, "pool", "at", "ids", 3).where("pool = 'p'").collect())
    assert [g[1:] for g in got] == served(prompts, 3)
    with pytest.raises(ValueError):
        steps.slot_choices(df, "pool", "at", "ids", 0)


def test_what_is_refused(spark):
    keys = spark.createDataFrame([(i, i) for i in (1, 2, 2)], "k int, o int")
    with pytest.raises(Exception, match="each k once"):
        steps.pending_first(keys, keys, "k", "o", 2)
    with pytest.raises(Exception, match="need 3 keys, there are 2"):
        sampling.deal(keys, "k", [1, 2]).collect()
    for bad in ("name", "=x", "name="):
        with pytest.raises(Exception, match="NAME=VALUE"):
            spark.createDataFrame([([bad],)], "i array<string>").select(steps.options(F.col("i"))).collect()
    with pytest.raises(Exception, match="no turn for role judge"):
        spark.createDataFrame([("judge",)], "r string").select(turns.turn_text(F.col("r"), F.lit("x"))).collect()
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, o int, ids string")
    with pytest.raises(Exception, match="no ids in a"):
        steps.latest_by_step(rows, "k", "o", needed="ids").collect()
    with pytest.raises(ValueError):
        catalogs.tools_text([], "yaml")


def test_passes_have_orders_of_their_own(spark):
    items = spark.createDataFrame([(i,) for i in range(7)], "k int")
    rows = sampling.epoch_order(spark.range(0, 17).withColumnRenamed("id", "slot"), "slot", items, "k", seed=2).orderBy("slot").collect()
    assert [(r.slot, r.epoch, r.place) for r in rows] == [(i, i // 7, i % 7) for i in range(17)]
    assert {r.k for r in rows[:7]} == {r.k for r in rows[7:14]} == set(range(7)) and [r.k for r in rows[:7]] != [r.k for r in rows[7:14]]
    assert sampling.epoch_order(spark.range(0), "id", items, "k").count() == 0


def test_same_outcome_and_ordering(spark):
    call = lambda n, a: (n, f"{n}\t{a}")
    cases = [
        ([call("get_a", 1), call("find_b", 2)], [call("find_b", 2), call("get_a", 1)], True), ([call("get_a", 1)], [call("get_a", 1), call("get_a", 1)], True), ([call("stop", 1)], [call("stop", 1), call("get_a", 1)], False),
        ([call("stop", 1), call("move", 1)], [call("move", 1), call("stop", 1)], False), ([], [], False), (None, [call("get_a", 1)], False),
    ]
    kind = "array<struct<name:string,key:string>>"
    df = spark.createDataFrame(cases, f"a {kind}, b {kind}, want boolean")
    assert all(r.got == r.want for r in df.select("want", pairs.same_outcome(F.col("a"), F.col("b")).alias("got")).collect())


def test_schema_of_calls(spark):
    check = canon.calls_check({"f": {"properties": {"a": {"type": "integer"}}, "required": ["a"]}})
    rows = [([("f", '{"a": 1}')], True), ([("f", '"{\\"a\\": 1}"')], True), ([("f", '{"a": 1}'), ("f", "{}")], False), ([("g", "{}")], False), ([("f", "[1]")], False), ([], True), (None, None)]
    df = spark.createDataFrame(rows, "c array<struct<name:string,arguments:string>>, want boolean")
    assert all(r.got == r.want for r in df.select("want", check(F.col("c")).alias("got")).collect())


def test_schema_rows_and_texts():
    tool = {"name": "f", "description": "Do\n it.", "parameters": {"properties": {"a": {"type": "array", "items": {"properties": {"b": {"type": ["string", "null"], "description": "x"}}}}, "c": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}, "required": ["c"]}}
    assert [path for path, *_ in catalogs.schema_rows(tool["parameters"])] == ["a", "a[].b", "c"]
    assert catalogs.tool_text(tool).splitlines() == ["f(a?: array[any], c: integer | null)", "  Do it.", "  - a[].b: x"]
    assert catalogs.system_text(" p ", [tool], "json").startswith("p\n\n# Tools")
