"""The ordered pass against a brute-force comparison, and the rules one by one."""

import datetime as dt
import json
import random

from evalspark.operators import schema_drift as sd

SCHEMA = "file_id bigint, file_name string, written_at timestamp, body string, part int, change string"


def frame(spark, rows):
    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, n, None if t is None else at + dt.timedelta(seconds=t), b, 0, "x") for i, n, t, b in rows], SCHEMA)


def flat(o, above=""):
    out = {}
    for k, v in o.items():
        out[above + k] = v
        if isinstance(v, dict):
            out |= flat(v, above + k + ".")
    return out


def brute(rows):
    found, last = set(), {}
    for i, name, _, body in sorted(rows, key=lambda r: (r[1] or "", -1 if r[2] is None else r[2], r[0])):
        try:
            new = json.loads(body or "")
        except ValueError:
            continue
        if not isinstance(new, dict):
            continue
        new = flat(new)
        if name in last and name is not None:
            old = last[name]
            come = sorted(new.keys() - old.keys())
            for p in sorted(old.keys() - new.keys()):
                same = [q for q in come if old[p] is not None and sd.frozen(new[q]) == sd.frozen(old[p])]
                found.add((i, same[0], "renamed") if same else (i, p, "removed"))
                if same:
                    come.remove(same[0])
            found |= {(i, p, "added") for p in come}
            found |= {(i, p, "retyped") for p in old.keys() & new.keys() if None not in (old[p], new[p]) and sd.kind_of(old[p]) != sd.kind_of(new[p])}
        last[name] = new
    return found


def some_files(n, seed=3):
    r, rows = random.Random(seed), []
    values = [None, True, 1, 1.0, "1", [1], {"x": 1}, {"y": {"z": None}}]
    for i in range(n):
        body = {k: r.choice(values) for k in r.sample("abcdef", r.randint(0, 5))}
        text = r.choice([json.dumps(body)] * 8 + [None, "[]", '{"a": '])
        rows.append((i, "hot" if i % 3 == 0 else r.choice(["p", "q", None]), r.choice([None, *range(40)]), text))
    return rows


def test_equals_brute_force_over_many_parts(spark):
    rows = some_files(400)
    found = sd.schema_changes(frame(spark, rows).repartition(5)).collect()
    assert len(found) == len({tuple(x) for x in found})
    assert {tuple(x) for x in found} == brute(rows)


def test_no_rows_and_unreadable_only(spark):
    assert sd.schema_changes(frame(spark, [])).count() == 0
    assert sd.schema_changes(frame(spark, [(1, "a", 0, None), (2, "a", 1, "{"), (3, "a", 2, "")])).count() == 0


def changes(old, new):
    one, two = sd.paths_of(old), sd.paths_of(new)
    return sorted(step[:2] for step in sd.Layouts().changes((sd.Layouts.fingerprint(one), one), (sd.Layouts.fingerprint(two), two)))


def test_rules():
    assert changes({"a": 1}, {"a": "1"}) == [("a", "retyped")]
    assert changes({"a": None}, {"a": "1"}) == []
    assert changes({"a": 1, "n": None}, {"c": 1, "b": 1.0, "m": None}) == [("b", "renamed"), ("c", "added"), ("m", "added"), ("n", "removed")]
    assert changes({"a": True}, {"b": 1}) == [("a", "removed"), ("b", "added")]
    assert changes({"v": {"x": 2}}, {"w": {"x": 2}}) == [("w", "renamed"), ("w.x", "renamed")]


def test_consistent_table(spark):
    body = {"libs": {"vLLM": "0.1"}, "sampling_params": {"n": "4", "temp": [0.5]}, "seed": 7, "backend": {"value": "mlx", "rev": "r1"}, "with_logprobs": "true", "odd": [1], "max_len": "many"}
    rows = [(1, "a", 0, json.dumps(body)), (2, "a", 1, None), (3, "a", 2, "[]"), (4, "b", None, "{}")]
    out = {r.file_id: r for r in sd.consistent_table(frame(spark, rows)).collect()}
    row = out[1]
    assert (row.versions_vllm, row.sampling_samples, row.sampling_temperature, row.sampling_seed, row.backend, row.logprobs) == ("0.1", 4, 0.5, 7, "mlx", True)
    assert json.loads(row.other) == {"backend": {"rev": "r1"}, "odd": [1], "max_model_len": "many"}
    assert "v2:rename:libs->versions" in row.steps and "v6:kept aside:max_model_len" in row.steps
    assert not out[2].readable and not out[3].readable and out[4].sampling_samples == 1
    assert {r.n_files for r in sd.layouts_in_use(frame(spark, rows)).collect()} == {1}


def test_files_of_a_layout_take_one_chain():
    routes = sd.Routes()
    for i, body in enumerate([{"seed": 1, "sampling": {"n": 2}}, {"seed": 5, "sampling": {"n": None}}, {"seed": 9, "sampling": {"n": 4}}]):
        layout = sd.Layouts.fingerprint(sd.paths_of(body))
        row, taken, left = routes.migrate(layout, body)
        full_row, full_taken, full_left, _ = sd.migrate(body, sd.MIGRATIONS)
        assert (row, taken, left) == (full_row, full_taken, full_left), i
    assert len(routes.chains) == 2 and all(len(chain) < len(sd.MIGRATIONS) for chain in routes.chains.values())


def test_registry_and_unknown_renames(spark):
    rows = [(1, "a", 0, json.dumps({"libs": {"vllm": "1"}, "odd": 5})), (2, "a", 1, json.dumps({"versions": {"vllm": "1"}, "even": 5})), (3, "b", 0, json.dumps({"versions": {"vllm": "2"}, "sampling": {"samples": 3}}))]
    found = {r.version: r.chain for r in sd.layout_registry(frame(spark, rows)).collect()}
    assert found[1] == ["v2:rename:libs->versions", "v6:default:sampling.samples"] and found[6] == []
    assert [tuple(r) for r in sd.unknown_renames(frame(spark, rows)).collect()] == [("odd", "even", 1)]
    steps = {(r.change, r.partner, r.field_path): r.n_files for r in sd.migration_steps(frame(spark, rows)).collect()}
    assert steps[("renamed", "odd", "even")] == 1 and steps[("renamed", "libs", "versions")] == 1
