"""Conversations by hand."""

from pyspark.sql import functions as F

from evalspark.operators import datacard, invariants, turns

MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,error:string,turn_idx:int,raw_data:string,usage:struct<completion_tokens:int>>>"
SCHEMA = f"episode_id bigint, task_id string, rep int, temperature double, reward double, pos string, messages {MESSAGES}"


def m(role, content=None, calls=None, error=None, raw=None, tokens=None):
    return (role, content, [c and ("i", *c) for c in calls] if calls is not None else None, error, None, raw, (tokens,) if tokens is not None else None)


TALK = [
    m("assistant", "Hi! How can I help you?"), m("user", "hello"), m("assistant", " reply ", []), m("user", "look"),
    m("assistant", "x", [("find_a", '{"m": 1}'), ("get_b", "{}")]), m("tool", "one"), m("tool", "two", error="True"), m("user", "###STOP###"),
]


def episodes(spark, *talks):
    return spark.createDataFrame([(i, str(i), 0, 0.0, 1.0, "clash", t) for i, t in enumerate(talks)], SCHEMA)


def test_decisions_and_prefixes(spark):
    found = [tuple(r) for r in turns.decisions(episodes(spark, TALK)).orderBy("pos").select("pos", "kind", "names", "n_before", "calls_before").collect()]
    assert found == [(2, "reply", [], 2, 0), (4, "tool_call", ["find_a", "get_b"], 4, 0)]
    made = [("find_a", '{"m": 1}'), ("get_b", "{}")]
    assert [[tuple(c) for c in r.later] for r in turns.later_calls(episodes(spark, TALK)).orderBy("pos").collect()] == [made, []]
    assert [[tuple(c) for c in r.prior] for r in turns.prior_calls(episodes(spark, [*TALK, m("assistant", "ok")])).orderBy("pos").collect()] == [[], [], made]


def test_null_parts(spark):
    df = episodes(spark, None, [], [None, m("assistant", None, [None]), m(None, None), m("tool", None)])
    assert turns.decisions(df).select("pos", "kind").collect() == [(1, None)]
    assert turns.merged_turns(df).count() == 3 and turns.transcripts(df).count() == 1
    assert [r[0] for r in df.select(turns.degenerate(F.col("messages"))).collect()] == [False] * 3
    stats = turns.episode_stats(df, ["a"], ["a"]).orderBy("episode_id").collect()
    assert [s.student_turns for s in stats] == [0, 0, 1]
    empty = df.limit(0)
    for f in (turns.decisions, turns.merged_turns, turns.transcripts, turns.segments, turns.matched_results, datacard.decision_counts, datacard.tool_results):
        f(empty).collect()


def test_results_answer_the_oldest_call(spark):
    found = turns.matched_results(episodes(spark, [*TALK, m("tool", "none waits")])).orderBy("ordinal").collect()
    assert [(r.call_name, r.is_error, r.in_order) for r in found] == [("find_a", False, True), ("get_b", True, True), (None, False, None)]


def test_serialized_conversation(spark):
    merged = turns.merged_turns(episodes(spark, TALK)).orderBy("turn").collect()
    assert [t.role for t in merged] == ["assistant", "user", "assistant", "user", "assistant", "user", "user"]
    assert merged[5].text == "<tool_response>\none\n</tool_response>\n<tool_response>\ntwo\n</tool_response>" and merged[5].n_messages == 2
    assert merged[4].text == '<tool_call>\n{"name": "find_a", "arguments": {"m": 1}}\n</tool_call>\n<tool_call>\n{"name": "get_b", "arguments": {}}\n</tool_call>'
    whole = "".join(f"<|im_start|>{t.role}\n{t.text}<|im_end|>\n" for t in merged)
    segments = turns.segments(episodes(spark, TALK)).orderBy("start").collect()
    assert segments[-1].end == len(whole) and [whole[s.start : s.end] for s in segments if s.train] == ["reply<|im_end|>", merged[4].text + "<|im_end|>"]
    assert all(a.end == b.start for a, b in zip(segments, segments[1:], strict=False))
    assert turns.transcripts(episodes(spark, TALK)).first().chars == len(whole) + len("<|im_start|>assistant\n")


def test_tokens_that_straddle(spark):
    spans = spark.createDataFrame([(1, True, 5, 9), (1, False, 0, 5)], "episode_id int, train boolean, start int, end int")
    tokens = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (1, 5, 9), (1, 8, 10)], "episode_id int, start int, end int")
    assert sorted(r.start for r in turns.straddling(tokens, spans).collect()) == [4, 8]


def test_diagnostics(spark):
    raw = "{'escalated': True, 'parse_error': None}"
    talk = [m("assistant", "Hi"), m("user", "u" * 20_001), m("assistant", None, [("a", "{}"), ("b", "{}"), ("zz", "{}")], raw=raw), m("assistant", "x", raw="{'parse_error': 'bad', 'context_overflow': True}")]
    row = turns.episode_stats(episodes(spark, talk), ["a", "b"], ["a"]).first()
    assert (row.student_turns, row.escalated_turns, row.tool_calls, row.parse_errors, row.context_overflows, row.distractor_calls, row.hallucinated_calls, row.degenerate_user_turn) == (2, 1, 3, 1, 1, 1, 1, True)
    hit = turns.hit_token_limit(F.col("raw_data"), F.col("completion_tokens"), 10)
    rows = turns.messages(episodes(spark, [m("assistant", raw="'finish_reason': 'length'"), m("assistant", tokens=10), m("assistant", tokens=9)]))
    assert [r[0] for r in rows.orderBy("pos").select(hit).collect()] == [True, True, False]


def test_greeting_and_card(spark):
    df = episodes(spark, TALK, TALK[1:])
    assert [r.episode_id for r in invariants.wrong_greeting(turns.messages(df), "Hi! How can I help you?").collect()] == [1]
    native = spark.createDataFrame([("find_a",), ("never",)], "name string")
    assert {r.name: (r.n, r.is_native) for r in datacard.tool_use(df, native).collect()} == {"find_a": (2, True), "never": (0, True), "get_b": (2, False)}
    tasks = spark.createDataFrame([(" 0",), ("1",), ("3",), (None,), ("x",)], "task_id string")
    assert [r.task for r in datacard.without_success(tasks, df).collect()] == [3]
    assert [tuple(r) for r in datacard.episodes_per_task(df).collect()] == [(1, 2)]
