"""Structural indexing against plain json.loads on hand-made and generated texts."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.operators import nested

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(-1, 1) | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=12,
)


def plain_keys(text):
    try:
        value = json.loads(text, parse_constant=lambda w: 1 / 0) if text else None
        if isinstance(value, str):
            value = json.loads(value, parse_constant=lambda w: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return set()
    return set(value) if isinstance(value, dict) else set()


@settings(max_examples=300, deadline=None)
@given(st.lists(JSON, max_size=5), st.booleans(), st.booleans())
def test_first_level_keys_equal_a_parser(values, spaced, ascii_):
    texts = [json.dumps(v, indent=2 if spaced else None, ensure_ascii=ascii_) for v in values]
    texts += [json.dumps(t) for t in texts[:2]]
    assert [set(k) for k in nested.first_level_keys(texts)] == [plain_keys(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4))
def test_every_node_is_linked_to_its_parent(values):
    nodes = nested.structure([json.dumps(v).encode() for v in values])

    def rebuilt(node):
        if nodes.first()[node] not in (ord("{"), ord("[")):
            return json.loads(nodes.text(node))
        inner = sorted(nested._children(nodes, node), key=lambda c: nodes.position[c])
        assert [nodes.position[c] for c in inner] == list(range(len(inner)))
        return {nodes.key(c): rebuilt(c) for c in inner} if nodes.first()[node] == ord("{") else [rebuilt(c) for c in inner]

    assert [rebuilt(i) for i in range(len(values))] == values


def test_texts_that_are_no_objects():
    texts = [None, "", "null", "[]", '"none"', '{"a": 1', "{}", '{"a": NaN}', ' {"a\\n": {"b": "}"}, "c": null} ', '"{\\"x\\": 1}"', '{"a":1,"a":2}']
    assert nested.first_level_keys(texts) == [[], [], [], [], [], [], [], [], ["a\n", "c"], ["x"], ["a"]]


def test_reports_in_all_layouts():
    label = {"step_agreement_by_episode": {"mean": 0.5}}
    bodies = [
        ("forced", {"labels": {"a": label, "b": None, "c": {"step_agreement_by_episode": None}}}),
        ("forced", {"labels": [{"label": "d", **label}, {"label": None}, None]}),
        ("forced", {"labels": json.dumps({"e/1": label})}),
        ("forced", {"labels": None}),
        ("compare", [{"rates": {"r": {"delta": 1}, "s": None}}, None, {"rates": [{"name": "t"}]}]),
        ("compare", {"comparisons": [{"rates": json.dumps({"u": {}})}], "created": "v2"}),
        ("compare", {"base": "x", "new": "y", "rates": {"v": {}}}),
        ("compare", {"comparisons": []}),
        (None, {"labels": {"z": label}}),
        ("compare", "cut"),
    ]
    texts = [json.dumps(b) for _, b in bodies[:-1]] + ['[{"rates": ']
    assert set(nested.report_children([k for k, _ in bodies], texts)) == {
        (0, "label", "a"), (0, "interval", "a/step_agreement_by_episode"), (0, "label", "c"),
        (1, "label", "d"), (1, "interval", "d/step_agreement_by_episode"),
        (2, "label", "e/1"), (2, "interval", "e/1/step_agreement_by_episode"),
        (4, "comparison", "0"), (4, "comparison", "2"), (4, "rate", "0/r"), (4, "rate", "2/t"),
        (5, "comparison", "0"), (5, "rate", "0/u"), (6, "comparison", "0"), (6, "rate", "0/v"),
    }


def test_tables_with_nulls_clashing_columns_and_no_rows(spark):
    schema = "episode_id bigint, root_id int, path string, messages array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
    call = ("c", "f", '{"k": null, "l": 2}')
    rows = [(1, 7, "x", [("user", "hi", None), None, ("assistant", None, [None, call, ("d", "g", "{bad")])]), (2, 7, "x", None), (3, None, None, [])]
    episodes = spark.createDataFrame(rows, schema)
    reports = spark.createDataFrame([(9, "forced", None), (10, "compare", "[{}]")], "report_id bigint, report_kind string, body string")
    found = {tuple(r) for r in nested.linked_children(episodes, reports).collect()}
    assert found == {
        ("episodes", 1, "message", "0"), ("episodes", 1, "message", "2"), ("episodes", 1, "tool_call", "2/1"), ("episodes", 1, "tool_call", "2/2"),
        ("episodes", 1, "argument", "2/1/k"), ("episodes", 1, "argument", "2/1/l"), ("report_files", 10, "comparison", "0"),
    }
    assert nested.linked_children(episodes.limit(0), reports.limit(0)).count() == 0
