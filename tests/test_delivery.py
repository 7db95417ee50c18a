"""The identifier index against a window over all rows."""

import random

from evalspark.operators import delivery

SCHEMA = "delivery_id bigint, config_fingerprint string, task_id string, seed int, ts double, key string, id int, payload string"


def log(spark, n=600, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        part = ("Ab " if hot else r.choice(["ab", "CD\t", "", None]), r.choice(["007", "7 "]) if hot else r.choice(["7", "0", "00", " ", None]), 1 if hot else r.choice([1, 2, None]), 5.0004 if hot else r.choice([5.0, 5.00041, float("nan"), float("inf"), None]))
        rows.append((i * 7 % 1000, *part, "x", 0, None))
    r.shuffle(rows)
    return rows


def brute(rows):
    seen, drop = {}, set()
    for d, fp, task, seed, ts, *_ in sorted(rows):
        if fp is None or task is None or seed is None or ts is None or ts != ts or ts == float("inf") or not fp.strip() or not task.strip():
            continue
        key = (fp.strip().lower(), task.strip().lstrip("0"), seed, round(ts * 1000))
        if key in seen:
            drop.add(d)
        seen.setdefault(key, d)
    return drop


def test_equals_brute_force(spark):
    rows = log(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 6):
        found = [r.delivery_id for r in delivery.repeated_deliveries(df, batches).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert delivery.once(df).count() == len(rows) - len(brute(rows))


def test_no_rows(spark):
    assert delivery.repeated_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_in_any_order_keep_the_smallest(spark):
    from evalspark.shared import new_path

    rows = log(spark, 300, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).select("delivery_id", delivery.message_key().alias("key"))
    index = delivery.DeliveryIndex(spark, new_path(spark, "test-index"), per_prefix=0.25, merge_every=3)
    for low in (750, 0, 500, 250):
        index.ingest(df.where(f"delivery_id between {low} and {low + 249}"))
    kept = {r.delivery_id for r in index.kept().collect()}
    whole = {r.delivery_id for r in df.where("key is not null").collect()}
    assert whole - kept == brute(rows)
    assert index.prefixes > 16


def test_an_index_is_opened_again(spark, tmp_path):
    """The second part comes in a session of its own, which knows the root only."""
    rows = log(spark, 500, seed=9)
    parts = [[r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2 == 1]]
    root = f"file://{tmp_path}/index"
    first = {r.delivery_id for r in delivery.repeated_deliveries(spark.createDataFrame(parts[0], SCHEMA), 2, root).collect()}
    other = spark.newSession()
    second = delivery.repeated_deliveries(other.createDataFrame(parts[1], SCHEMA), 2, root)
    dropped = first | {r.delivery_id for r in second.collect()}
    # A message whose smaller delivery came later is replaced in the index: its earlier row was already handed on.
    late = {d for d in brute(rows) - dropped}
    keys = {r.delivery_id: r.key for r in spark.createDataFrame(rows, SCHEMA).select("delivery_id", delivery.message_key().alias("key")).collect()}
    assert dropped <= brute(rows) and all(d % 2 == 0 for d in late)
    assert {keys[d] for d in late} <= {keys[r[0]] for r in parts[1]}
    index = delivery.DeliveryIndex(other, root)
    assert index.size == len({k for k in keys.values() if k is not None})


def test_prefixes_are_the_same_everywhere(spark):
    import numpy as np

    df = spark.createDataFrame(log(spark, 50), SCHEMA).select(delivery.message_key().alias("key")).where("key is not null").select("key", delivery.prefix_of(delivery.F.col("key"), 64).alias("p"))
    got = df.collect()
    assert list(delivery._prefixes(np.array([bytes(r.key) for r in got], "S16"), 64)) == [r.p for r in got]
