"""Components against union-find, and splits that hold their shares."""

import random

import pytest

splits = pytest.importorskip("evalspark.llm.splits")

TASKS = "task_id string, user_id string, derived_from string, group_no int"


def brute(tasks, more):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def number(t):
        return int(t.strip()) if t and t.strip().isdigit() else None

    rows = [(number(t), (u or "").strip().lower(), number(d)) for t, u, d, _ in tasks]
    rows = [r for r in rows if r[0] is not None]
    for t in [r[0] for r in rows] + [number(m) for m in more]:
        if t is not None:
            parent.setdefault(t, t)
    known, by_user, links = {r[0] for r in rows}, {}, []
    for t, u, d in rows:
        if u not in splits.NO_USER:
            links.append((t, by_user.setdefault(u, t)))
        if d in known:
            links.append((t, d))
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {(t, find(t)) for t in parent}


def frames(spark, tasks, episodes, steps):
    return (
        spark.createDataFrame(tasks, TASKS),
        spark.createDataFrame([(t, "x") for t in episodes], "task_id string, task_no string"),
        spark.createDataFrame([(s, 1) for s in steps], "step_id string, n_steps int"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_union_find(spark, seed):
    r = random.Random(seed)
    tasks = []
    for _ in range(150):
        user = "HUB " if r.random() < 0.33 else r.choice([None, " ", "N/A", "?", f"u{r.randint(0, 99)}"])
        tasks.append((r.choice([f" {r.randint(0, 300)}", str(r.randint(0, 300)), None, "x"]), user, r.choice([None, str(r.randint(0, 400)), "007"]), 0))
    tasks += [(str(1000 + i), None, str(1001 + i), 0) for i in range(40)]  # a long chain
    episodes, steps = ["5", " 6", None, "2000"], ["7:0:1", " 8:0:1", "bad", None, "3000:1:1"]
    found = [(x.task_no, x.group_no) for x in splits.groups(*frames(spark, tasks, episodes, steps)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(tasks, [*episodes, *[(s or "x").split(":")[0] for s in steps]])


def test_no_rows(spark):
    assert splits.groups(*frames(spark, [], [], [])).count() == 0


def test_groups_stay_whole_and_shares_hold(spark):
    tasks = [(str(i), f"u{i // 3}", None, 0) for i in range(3000)]
    episodes = [str(i) for i in range(3000) for _ in range(i % 3)]
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.1), ("test", 0.2)], "split_name string, share double")
    grouped = splits.groups(*frames(spark, tasks, episodes, [f"{i}:0:0" for i in range(0, 3000, 2)]))
    rows = splits.assign(grouped, targets).collect()
    assert len(rows) == 3000
    where = {}
    for row in rows:
        assert where.setdefault(row.group_no, row.split_name) == row.split_name
    for row in splits.split_report(splits.assign(grouped, targets), targets).collect():
        assert abs(row.actual_share - row.target_share) < 0.01
