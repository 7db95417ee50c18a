"""Exactly-once messages out of at-least-once deliveries: an index of sorted identifier runs.

Every message identifier is hashed to 16 bytes. The index keeps, for each hash prefix, immutable runs of sorted
identifiers with the delivery that was kept. A batch is first reduced to one row an identifier (a map-side
aggregate, so an identifier that fills a third of the batch costs one row a task), then each prefix is looked
up by binary search in its runs; what is new, or arrives with a smaller delivery id than the kept one, becomes
the batch's own run. After every `merge_every` runs they are merged into one. A prefix holds about
`per_prefix` identifiers, as prefixes are doubled when they have grown, so the work of one task doesn't grow with the table.

Deliveries to drop are those whose id is in no run after the last merge: an anti-join on the unique delivery
id, which no hot identifier can skew.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import folded, number_text
from evalspark.shared import drop_path, new_path, read_text, write_text, written

RUN_SCHEMA = "prefix int, keys binary, ids binary"
_EMPTY = np.empty(0, "S16")


def milliseconds(seconds: Column) -> Column:
    """Epoch seconds as whole milliseconds; null where the clock holds no number."""
    fits = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e15)
    return F.when(fits, F.round(seconds * 1000).cast("bigint"))


def message_key(fingerprint: str = "config_fingerprint", task: str = "task_id", seed: str = "seed", ts: str = "ts") -> Column:
    """16 bytes that are equal exactly if all four parts are; null if a part is missing or blank."""
    print_, number = folded(F.col(fingerprint)), number_text(F.col(task))
    text = F.concat_ws("|", F.length(print_), print_, F.length(number), number, F.col(seed), milliseconds(F.col(ts)))
    whole = print_.isNotNull() & (print_ != "") & number.isNotNull() & F.col(seed).isNotNull() & milliseconds(F.col(ts)).isNotNull()
    return F.when(whole, F.unhex(F.md5(text.cast("binary"))))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of 16 bytes as one array, straight from Arrow's buffer."""
    if not len(column):
        return _EMPTY
    chunk = column.combine_chunks().cast(pa.binary()) if isinstance(column, pa.ChunkedArray) else column
    chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk
    return np.frombuffer(chunk.buffers()[2], "S16")[: len(chunk)] if chunk.offset == 0 else np.array(chunk.to_pylist(), "S16")


def _runs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(k, "S16"), np.frombuffer(i, "<i8")) for k, i in zip(table["keys"].to_pylist(), table["ids"].to_pylist(), strict=True)]


def _row(prefix: int, keys: np.ndarray, ids: np.ndarray) -> pa.Table:
    some = [0] if len(keys) else []
    return pa.table({
        "prefix": pa.array([prefix for _ in some], pa.int32()),
        "keys": pa.array([keys.tobytes() for _ in some], pa.binary()),
        "ids": pa.array([ids.astype("<i8").tobytes() for _ in some], pa.binary()),
    })


def search(keys: np.ndarray, ids: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted identifiers of a batch that no run has, or that every run has with a larger delivery id."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    for run, kept in runs:
        at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
        fresh &= ~((run[at] == keys) & (kept[at] <= ids))
    return keys[fresh], ids[fresh]


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of all; an identifier in several keeps its smallest delivery id."""
    if not runs:
        return _EMPTY, np.empty(0, "<i8")
    keys, ids = np.concatenate([k for k, _ in runs]), np.concatenate([i for _, i in runs])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], ids[first]


class DeliveryIndex:
    """Runs of seen identifiers below `root`, in the folder all executors share. Batches may come in any order of delivery ids.

    The index outlives its session: a manifest names the runs that count, the number of prefixes and how many
    identifiers there are, and is written anew after each change, so an index that is opened again goes on where
    the last complete one stopped; runs that no manifest names are leftovers. Once a prefix holds more than
    `per_prefix` identifiers on average, the next merge doubles the prefixes.
    """

    def __init__(self, spark: SparkSession, root: str, per_prefix: int = 250_000, merge_every: int = 4):
        self.spark, self.root, self.per_prefix, self.merge_every = spark, root.rstrip("/"), per_prefix, merge_every
        self.prefixes, self.runs, self.made, self.size = 16, [], 0, 0
        text = read_text(spark, f"{self.root}/manifest.json")
        if text is not None:
            kept = json.loads(text)
            self.prefixes, self.runs, self.made, self.size = kept["prefixes"], kept["runs"], kept["made"], kept["size"]

    def _save(self) -> None:
        write_text(self.spark, f"{self.root}/manifest.json", json.dumps({"prefixes": self.prefixes, "runs": self.runs, "made": self.made, "size": self.size}))

    def prefix(self, key: Column) -> Column:
        return prefix_of(key, self.prefixes)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*(f"{self.root}/{run}" for run in self.runs))

    def _write(self, df: DataFrame) -> tuple[str, int]:
        """(name, identifiers) of a new run."""
        name, seen = f"run-{self.made:06d}", Observation()
        self.made += 1
        df.observe(seen, F.coalesce(F.sum(F.length("keys") / 16), F.lit(0)).cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return name, seen.get["n"] or 0

    def ingest(self, batch: DataFrame) -> None:
        """Take a batch of (key, delivery_id); rows without a key are nobody's copy and are left aside."""
        local = batch.where("key is not null").groupBy("key").agg(F.min("delivery_id").alias("id")).withColumn("prefix", self.prefix(F.col("key")))

        def novel(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return _row(0, _EMPTY, _EMPTY)
            keys, ids = search(_keys(left["key"]), left["id"].to_numpy(), _runs(right))
            return _row(left["prefix"][0].as_py(), keys, ids)

        grouped = local.groupBy("prefix")
        if self.runs:
            found = grouped.cogroup(self._read().groupBy("prefix")).applyInArrow(novel, RUN_SCHEMA)
        else:
            nothing = pa.table({"prefix": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
            found = grouped.applyInArrow(lambda left: novel(left, nothing), RUN_SCHEMA)
        name, n = self._write(found)
        self.runs.append(name)
        self.size += n
        if len(self.runs) >= self.merge_every:
            self.compact()
        self._save()

    def compact(self) -> None:
        """Merge all runs into one, over more prefixes if they have grown, and remove the old ones."""
        finer = 1
        while self.size > self.per_prefix * self.prefixes * finer:
            finer *= 2
        if len(self.runs) < 2 and finer == 1:
            return
        prefixes = self.prefixes * finer

        def merged(table: pa.Table) -> pa.Table:
            keys, ids = merge(_runs(table))
            number = _prefixes(keys, prefixes)
            return pa.concat_tables([_row(int(p), keys[number == p], ids[number == p]) for p in np.unique(number)] or [_row(0, _EMPTY, _EMPTY)])

        old, (name, self.size) = self.runs, self._write(self._read().groupBy("prefix").applyInArrow(merged, RUN_SCHEMA))
        self.runs, self.prefixes = [name], prefixes
        self._save()
        for path in old:
            drop_path(self.spark, f"{self.root}/{path}")

    def kept(self) -> DataFrame:
        """(delivery_id) of the one delivery kept of each identifier seen so far."""
        self.compact()
        if not self.runs:
            return self.spark.createDataFrame([], "delivery_id bigint")

        def ids(batches):
            for batch in batches:
                for blob in batch.column("ids").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, "<i8"))], ["delivery_id"])

        return self._read().select("ids").mapInArrow(ids, "delivery_id bigint")


def prefix_of(key: Column, prefixes: int) -> Column:
    """The prefix of a key: the remainder of its first four bytes, as a whole number."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint"), F.lit(prefixes)).cast("int")


def _prefixes(keys: np.ndarray, prefixes: int) -> np.ndarray:
    """`prefix_of` for many keys."""
    return keys.view(np.uint8).reshape(-1, 16)[:, :4].copy().view(">u4").ravel().astype(np.int64) % prefixes


def index_log(log: DataFrame, batches: int = 4, root: str | None = None, batch: str = "batch_file") -> tuple[DataFrame, DataFrame]:
    """Run a whole log through an index in `batches` parts of whole batch files; give (keyed rows, kept ids).

    The log is scanned once: (delivery_id, key) is written by part, files of a part together, and each part is
    ingested from there. With `root` the index there is opened and goes on, else a new one is made.
    """
    spark = log.sparkSession
    part = F.pmod(F.xxhash64(batch), F.lit(batches)).cast("int") if batch in log.columns else F.pmod(F.col("delivery_id"), F.lit(batches)).cast("int")
    # Rows without a key are left out when they are read: filtered before, the key would be worked out twice.
    keyed = written(log.select("delivery_id", message_key().alias("key"), part.alias("part")), "delivery-keys", by="part").where("key is not null")
    index = DeliveryIndex(spark, root or new_path(spark, "delivery-index"))
    for number in range(batches):
        index.ingest(keyed.where(F.col("part") == number).select("delivery_id", "key"))
    return keyed.select("delivery_id", "key"), index.kept()


def repeated_deliveries(log: DataFrame, batches: int = 4, root: str | None = None) -> DataFrame:
    """(delivery_id) of each delivery to drop.

    A row that lacks a part of its identifier is a message of its own and never dropped; an empty log gives no
    rows; of other columns only the batch file is read. With `root` messages count that earlier logs brought to the
    index there.
    """
    keyed, kept = index_log(log, batches, root)
    return keyed.select("delivery_id").join(kept, "delivery_id", "left_anti")


def once(log: DataFrame, batches: int = 4) -> DataFrame:
    """The rows of the log without the repeated deliveries, all columns kept."""
    return log.join(repeated_deliveries(log, batches), "delivery_id", "left_anti")
