"""Readers, sinks and streams over small files."""

import hashlib
import json

import pytest

from evalspark.sources import readers, sinks
from evalspark.streaming import runlog

FIELDS = "task_id string, seed int, config_fingerprint string"


def line(task, seed=0, fp="f"):
    return json.dumps({"task_id": task, "seed": seed, "config_fingerprint": fp, "extra": 1}, ensure_ascii=False)


def test_jsonl_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{line('x y')}\n\n{line('b')}\n" + '{"task_id": "cut')
    (tmp_path / "b.jsonl").write_text(f"{line('c')}\n")
    (tmp_path / "c.jsonl").write_text("")
    rows = readers.jsonl(spark, str(tmp_path / "*.jsonl"), FIELDS).orderBy("file", "line").collect()
    assert [(r.task_id, r.line) for r in rows] == [("x y", 1), ("b", 3), ("c", 1)]
    assert readers.jsonl(spark, str(tmp_path / "none-*.jsonl"), FIELDS).count() == 0


def test_jsonl_refuses_a_bad_line_inside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{line('x')}\n{{bad\n{line('b')}\n")
    with pytest.raises(Exception, match="a.jsonl:2 is no JSON record"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), FIELDS).collect()
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), FIELDS).collect()


def test_trajectories(spark, tmp_path):
    sims = [{"task_id": "1", "reward_info": {"reward": 1.0}, "messages": [{"role": "user", "content": "x"}]}, {"task_id": "1", "reward_info": None, "messages": []}]
    (tmp_path / "t.json").write_text(json.dumps({"simulations": sims}, indent=1))
    rows = readers.trajectories(spark, str(tmp_path / "t.json")).collect()
    assert [(r.task_id, r.reward, len(r.messages)) for r in rows] == [("1", 1.0, 1)]
    (tmp_path / "t.json").write_text(json.dumps({"simulations": [sims[0], sims[0]]}))
    with pytest.raises(Exception, match="one scored simulation"):
        readers.trajectories(spark, str(tmp_path / "t.json"))


def test_cells_forced_functions_and_counts(spark, tmp_path):
    (tmp_path / "free-q-esc0.70-c80.jsonl").write_text(line("a") + "\n" + line("b") + "\n")
    (tmp_path / "other.jsonl").write_text(line("z") + "\n")
    rows = readers.free_cells(spark, str(tmp_path / "*.jsonl")).collect()
    assert [(r.task_id, r.file_label, r.file_threshold, r.file_catalog) for r in rows] == [("a", "q", 0.7, 80), ("b", "q", 0.7, 80)]
    (tmp_path / "forced-c16.jsonl").write_text(line("f") + "\n")
    (tmp_path / "forced-c16.smoke.jsonl").write_text(line("s") + "\n")
    assert [r.task_id for r in readers.forced_results(spark, str(tmp_path), FIELDS).collect()] == ["f"]
    assert {r.file.rsplit("/")[-1]: r.n for r in readers.line_counts(spark, str(tmp_path / "free-*.jsonl")).collect()} == {"free-q-esc0.70-c80.jsonl": 2}
    docs = tmp_path / "docs"
    (docs / "multi_turn_func_doc").mkdir(parents=True)
    (docs / "b.json").write_text(json.dumps({"function": [{"name": "f.x", "v": 1}, {"name": "g"}]}) + "\n\n" + json.dumps({"name": "g", "v": 2}) + "\n")
    (docs / "multi_turn_func_doc" / "a.json").write_text(json.dumps({"name": "f.x", "v": 3}) + "\n" + json.dumps({"name": "h"}) + "\n")
    found = {r.name: json.loads(r.doc) for r in readers.functions(spark, str(docs)).collect()}
    assert found == {"f_x": {"name": "f.x", "v": 1}, "g": {"name": "g"}, "h": {"name": "h"}}


def test_pins_and_configs(spark, tmp_path):
    text = json.dumps({"size": 1, "tools": [{"name": "a"}]})
    (tmp_path / "c.json").write_text(text)
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert readers.catalog(spark, str(tmp_path / "c.json"), sha, 1) == [{"name": "a"}]
    with pytest.raises(ValueError):
        readers.catalog(spark, str(tmp_path / "c.json"), sha, 2)
    with pytest.raises(ValueError):
        readers.pinned(spark, str(tmp_path / "c.json"), "0" * 64)
    for name, body in {"base": {"a": {"x": 1, "y": [1, 2]}, "b": 1}, "mid": {"b": 2}, "top": {"extends": ["base.json", "mid.json"], "a": {"y": [3]}}, "circle": {"extends": "circle.json"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert readers.config(tmp_path / "top.json") == {"a": {"x": 1, "y": [3]}, "b": 2}
    with pytest.raises(ValueError):
        readers.config(tmp_path / "circle.json")


def test_label_sheet_round_trip(spark, tmp_path):
    rows = [("s:0:1", "b", None, "t", 'line\n"quoted", é', "c" * 5), ("s:0:2", "b", "h", "t", "x" * 2000, None)]
    sinks.write_label_sheet(spark.createDataFrame(rows, readers.LABEL_SHEET), str(tmp_path / "sheet"))
    back = {r.step_id: r.completion for r in readers.label_sheet(spark, str(tmp_path / "sheet")).collect()}
    assert back == {"s:0:1": 'line\n"quoted", é', "s:0:2": "x" * 1500}


def test_sinks(spark, tmp_path):
    payload = spark.createDataFrame([("1", 0, 1.0), ("2", 0, 0.0)], "task_id string, seed int, reward double")
    sinks.append_log(payload, str(tmp_path / "log"), {"config_fingerprint": "f"}, per_file=1)
    sinks.append_log(payload, str(tmp_path / "log"), {"config_fingerprint": "g"})
    assert readers.strict_jsonl(spark, str(tmp_path / "log"), readers.RUN_LOG).where("ts > 1e9").count() == 4
    with pytest.raises(ValueError):
        sinks.append_log(payload.withColumnRenamed("reward", "ts"), str(tmp_path / "log"), {})
    from pyspark.sql import functions as F

    one = sinks.write_with_manifest(payload, str(tmp_path / "w"), ["task_id"], [F.countDistinct("task_id").alias("n_tasks")], parts=1)
    two = sinks.write_with_manifest(payload.repartition(3), str(tmp_path / "w2"), ["task_id"], parts=1)
    content = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert one["n"] == 2 and one["n_tasks"] == 2 and one["hash"] == two["hash"] == hashlib.sha256(content).hexdigest()
    # Order and repeated lines count.
    twice = sinks.write_with_manifest(payload.unionByName(payload), str(tmp_path / "w3"), ["task_id"], parts=2)
    turned = sinks.write_with_manifest(payload.withColumn("reward", -F.col("reward")), str(tmp_path / "w4"), ["reward"], parts=1)
    assert twice["n"] == 4 and len({twice["hash"], turned["hash"], one["hash"]}) == 3
    sinks.write_summary(payload, str(tmp_path / "s.json"))
    assert len(json.loads((tmp_path / "s.json").read_text())) == 2
    with pytest.raises(ValueError):
        sinks.write_summary(payload, str(tmp_path / "s.json"), most=1)
    table = sinks.markdown(spark.createDataFrame([("a", "c16", 0.5), ("b", "c40", 0.25)], "l string, c string, r double"), "l", "c", "r", ["c16", "c40"])
    assert table.splitlines()[2] == "| a | 50.0 % | n/a |"


def test_stream_resumes_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for name, rows in (("a", [("1", 0), ("2", 0), ("1", 0)]), ("b", [("2", 0), ("3", 1)]), ("c", [])):
        (tmp_path / "in" / f"{name}.json").write_text("".join(line(*r) + "\n" for r in rows))
        runlog.resume(spark, source, target, checkpoint)
    runlog.resume(spark, source, target, checkpoint)
    assert sorted((r.task_id, r.seed) for r in spark.read.parquet(target).collect()) == [("1", 0), ("2", 0), ("3", 1)]


def test_windows_and_progress(spark):
    df = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate([0, 30, 59.999999, 60, 61, 200])], "u string, i int, t double").selectExpr("u", "i", "timestamp_micros(cast(round(t * 1e6) as bigint)) as at")
    assert [r.n_window for r in runlog.in_last_minute(df, ["u"], "at").orderBy("i").collect()] == [1, 2, 3, 3, 4, 1]
    for block in (60, 61, 100):
        assert [r.n_window for r in runlog.in_last_minute(df, ["u"], "at", block=block).orderBy("i").collect()] == [1, 2, 3, 3, 4, 1]
    assert runlog.window_counts(df, "at").count() == 3
    assert [(r.n, r.over) for r in runlog.daily(df, ["u"], "at", 4).collect()] == [(6, 2)]
    log = spark.createDataFrame([(0, "a", 0), (0, "a", 0), (0, "b", 1), (1, "a", 0), (2, "a", 0)], "cell int, task_id string, seed int")
    done = runlog.progress(log, ["cell"], 1)
    assert {r.cell: r.done for r in done.collect()} == {0: 1, 1: 1, 2: 1}
    assert sorted(r.cell for r in runlog.incomplete_first(done.selectExpr("cell", "case when cell = 0 then 2 else done end as done"), "cell", 2).collect()) == [0, 1]


def test_a_log_is_read_by_many_tasks(spark, tmp_path):
    """A file that is cut into ranges of bytes keeps its line numbers, its bad last line is dropped, one before it is named."""
    lines = [line(f"t{i}" * (i % 40)) if i % 7 else "" for i in range(900)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"task_id": "cut')
    (tmp_path / "b.jsonl").write_text(line("b") + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.jsonl(spark, str(tmp_path / "*.jsonl"), FIELDS)
        got = sorted((r.line, r.task_id) for r in df.where("file like '%a.jsonl'").collect())
        assert got == [(i + 1, f"t{i}" * (i % 40)) for i in range(900) if i % 7] and df.count() == len(got) + 1
        (tmp_path / "a.jsonl").write_text("\n".join(lines[:700] + ["{bad"] + lines[700:]))
        with pytest.raises(Exception, match="a.jsonl:701 is no JSON record"):
            readers.jsonl(spark, str(tmp_path / "*.jsonl"), FIELDS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.line_counts(spark, str(tmp_path / "b.jsonl"), expected=1).count() == 1
    with pytest.raises(Exception, match="5 lines"):
        readers.line_counts(spark, str(tmp_path / "b.jsonl"), expected=5)
