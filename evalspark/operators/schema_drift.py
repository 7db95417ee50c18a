"""Files whose JSON layout moves with time: one consistent table, and every change between two versions.

Both results come from one ordered pass. The files are range-partitioned and sorted by (name, time, id), so a
name that holds a third of all files is spread over many tasks, and each task compares a file with the one
before it as they stream by. Each task also hands out its first and last readable file; these few rows (two a
task) are compared across the borders afterwards.

A layout is known by its fingerprint (its paths with their types). The step from one fingerprint to another is
worked out once a task and then reused; only renames look at values. The consistent table sends each file
through the chain of steps in MIGRATIONS.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.shared import written

CHANGES = "file_id bigint, field_path string, change string"
_PASS = "border boolean, part int, pos bigint, file_id bigint, file_name string, body string, field_path string, change string, partner string, before string, layout string"
STEPS = CHANGES + ", partner string, before string, layout string"


def _refuse(word: str):
    raise ValueError(word)


def read_object(body: str | None) -> dict | None:
    """The JSON object a body holds, else None: null, cut off, another kind of value, NaN or Infinity."""
    if not body:
        return None
    try:
        value = json.loads(body, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array" if isinstance(value, list) else "number"


def paths_of(value: dict, above: str = "") -> dict[str, object]:
    """Every key with its parents' keys; objects count and are entered, arrays aren't entered."""
    found: dict[str, object] = {}
    for key, inner in value.items():
        found[above + key] = inner
        if isinstance(inner, dict):
            found.update(paths_of(inner, f"{above}{key}."))
    return found


def frozen(value: object) -> tuple:
    """A hashable form that is equal exactly if type and content are; 1 and 1.0 are one number, true is none."""
    kind = kind_of(value)
    if kind == "object":
        return kind, frozenset((k, frozen(v)) for k, v in value.items())
    return (kind, tuple(frozen(v) for v in value)) if kind == "array" else (kind, value)


class Layouts:
    """Fingerprints of layouts, and the steps between them, as far as one task has met them."""

    def __init__(self) -> None:
        self.steps: dict[tuple[str, str], tuple[list[str], list[str], list[str]]] = {}

    @staticmethod
    def fingerprint(fields: dict[str, object]) -> str:
        text = "\n".join(sorted(f"{path}\t{kind_of(value)}" for path, value in fields.items()))
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]

    def step(self, old_print: str, new_print: str, old: dict[str, object], new: dict[str, object]) -> tuple[list[str], list[str], list[str]]:
        """Paths gone, paths come, paths retyped (null is of any type)."""
        if (known := self.steps.get((old_print, new_print))) is None:
            retyped = [p for p in old.keys() & new.keys() if old[p] is not None and new[p] is not None and kind_of(old[p]) != kind_of(new[p])]
            known = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys()), sorted(retyped)
            if len(self.steps) < 10_000:
                self.steps[old_print, new_print] = known
        return known

    def changes(self, old: tuple[str, dict], new: tuple[str, dict]) -> list[tuple[str, str, str | None]]:
        """(path, change, partner) from one file to the next; partner is the former path of a renamed one.

        A gone path and a come path that hold the same non-null value are one rename. Gone paths are taken in
        alphabetical order and each takes the alphabetically first partner that is still free.
        """
        if old[0] == new[0]:
            return []
        gone, come, retyped = self.step(old[0], new[0], old[1], new[1])
        free: dict[tuple, list[str]] = {}
        for path in reversed(come) if gone else ():
            if new[1][path] is not None:
                free.setdefault(frozen(new[1][path]), []).append(path)
        found, taken = [(path, "retyped", None) for path in retyped], set()
        for path in gone:
            partners = free.get(frozen(old[1][path])) if free and old[1][path] is not None else None
            if partners:
                taken.add(partner := partners.pop())
                found.append((partner, "renamed", path))
            else:
                found.append((path, "removed", None))
        return found + [(path, "added", None) for path in come if path not in taken]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_STEP_FIELDS = [("field_path", pa.string()), ("change", pa.string()), ("partner", pa.string()), ("before", pa.string()), ("layout", pa.string())]
_PASS_ARROW = pa.schema([("border", pa.bool_()), ("part", pa.int32()), ("pos", pa.int64()), ("file_id", pa.int64()), ("file_name", pa.string()), ("body", pa.string()), *_STEP_FIELDS])
_STEPS_ARROW = pa.schema([("file_id", pa.int64()), *_STEP_FIELDS])


def _compare_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, layouts, before, last, seen = TaskContext.get().partitionId(), Layouts(), None, None, 0
    nothing = (None,) * len(_STEP_FIELDS)
    for batch in batches:
        out = []
        for file_id, name, body in zip(*(batch.column(c).to_pylist() for c in ("file_id", "file_name", "body")), strict=True):
            if (value := read_object(body)) is None:
                continue
            fields = paths_of(value)
            now = (layouts.fingerprint(fields), fields)
            if before is None:
                out.append((True, part, 0, file_id, name, body, *nothing))
            elif name is not None and name == last[1]:
                out += [(False, None, None, file_id, None, None, *step, before[0], now[0]) for step in layouts.changes(before, now)]
            before, last, seen = now, (file_id, name, body), seen + 1
        yield _rows(out, _PASS_ARROW)
    if last is not None:
        yield _rows([(True, part, seen, *last, *nothing)], _PASS_ARROW)


def _compare_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts, before = Layouts(), None
    for batch in batches:
        out = []
        for part, file_id, name, body in zip(*(batch.column(c).to_pylist() for c in ("part", "file_id", "file_name", "body")), strict=True):
            fields = paths_of(read_object(body))
            now = (part, name, (layouts.fingerprint(fields), fields))
            if before is not None and before[0] != part and name is not None and name == before[1]:
                out += [(file_id, *step, before[2][0], now[2][0]) for step in layouts.changes(before[2], now[2])]
            before = now
        yield _rows(out, _STEPS_ARROW)


def recorded_steps(files: DataFrame) -> DataFrame:
    """(file_id, field_path, change, partner, before, layout): each step a file took from the layout before it to its own.

    The step between two layouts is kept by their fingerprints; see `schema_changes` for what counts.
    """
    order = ["file_name", "written_at", "file_id"]
    files = files.select(*order, "body").where("body is not null")
    sorted_ = files.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = written(sorted_.mapInArrow(_compare_stream, _PASS), "schema-changes", by="border")
    fields = ["file_id", "field_path", "change", "partner", "before", "layout"]
    # Border rows lie in files of their own, two rows a task of the pass; no other row is read here.
    borders = passed.where("border").select("part", "pos", "file_id", "file_name", "body")
    across = borders.coalesce(1).sortWithinPartitions("part", "pos").mapInArrow(_compare_borders, STEPS)
    return passed.where("not border").select(*fields).unionByName(across)


def migration_steps(files: DataFrame) -> DataFrame:
    """(before, layout, change, field_path, partner, n_files): the steps between layouts, and how many files took each."""
    return recorded_steps(files).groupBy("before", "layout", "change", "field_path", "partner").agg(F.count("*").alias("n_files"))


def newest_path(path: str) -> str:
    """Where the migrations move a path; a path they don't know stays."""
    for _, rule, old, new in MIGRATIONS:
        if rule == "rename" and (path == old or path.startswith(f"{old}.")):
            path = new + path[len(old) :]
    return path


def unknown_renames(files: DataFrame) -> DataFrame:
    """(partner, field_path, n_files) of the renames between files that the migrations don't lead to one path: rules to write."""
    pairs = recorded_steps(files).where("change = 'renamed'").groupBy("partner", "field_path").agg(F.count("*").alias("n_files"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [newest_path(a) != newest_path(b) for a, b in zip(batch.column("partner").to_pylist(), batch.column("field_path").to_pylist(), strict=True)]
            yield batch.filter(pa.array(apart, pa.bool_()))

    return pairs.mapInArrow(check, "partner string, field_path string, n_files bigint")


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, field_path, change) of each readable file against the readable one before it of the same name.

    `files` has file_id, file_name, written_at and body; other columns aren't read. Order is written_at (null
    first), then file_id. Unreadable, null and empty bodies are passed over; a file without a name has none
    before it; the first file of a name has no changes; an empty table gives no rows.
    """
    return recorded_steps(files).select("file_id", "field_path", "change")


# The steps from each known version to the next one, oldest first. A layout, known by its fingerprint,
# needs a chain of them, which is found with the first file of the layout and which all its files go through.
MIGRATIONS = [
    ("v2", "rename", "libs", "versions"),
    ("v2", "rename", "sampling_params", "sampling"),
    ("v2", "rename", "engine", "backend"),
    ("v2", "rename", "model", "base_model"),
    ("v2", "rename", "lora", "adapter"),
    ("v3", "rename", "prompt_file", "prompts_file"),
    ("v3", "rename", "prompts_hash", "prompts_sha256"),
    ("v3", "rename", "configFingerprint", "config_fingerprint"),
    ("v3", "rename", "with_logprobs", "logprobs"),
    ("v3", "rename", "context_len", "max_model_len"),
    ("v3", "rename", "max_len", "max_model_len"),
    ("v4", "rename", "versions.vLLM", "versions.vllm"),
    ("v4", "rename", "versions.mlx-lm", "versions.mlx_lm"),
    ("v4", "rename", "sampling.maxTokens", "sampling.max_tokens"),
    ("v4", "rename", "sampling.max_new_tokens", "sampling.max_tokens"),
    ("v4", "rename", "sampling.temp", "sampling.temperature"),
    ("v4", "rename", "sampling.n", "sampling.samples"),
    ("v4", "rename", "sampling.num_samples", "sampling.samples"),
    ("v4", "rename", "sampling.rng_seed", "sampling.seed"),
    ("v5", "rename", "seed", "sampling.seed"),
    ("v6", "default", "sampling.samples", 1),
]
COLUMNS = {
    "base_model": "string", "adapter": "string", "backend": "string", "config_fingerprint": "string",
    "versions.vllm": "string", "versions.mlx": "string", "versions.mlx_lm": "string", "versions.torch": "string", "versions.transformers": "string", "versions.driver": "string",
    "sampling.temperature": "double", "sampling.top_p": "double", "sampling.penalty": "double", "sampling.samples": "bigint", "sampling.max_tokens": "bigint", "sampling.seed": "bigint", "sampling.top_k": "bigint", "sampling.guided": "boolean",
    "max_model_len": "bigint", "logprobs": "boolean", "finished": "boolean", "prompts_file": "string", "prompts_sha256": "string", "seconds": "double", "lora_rank": "bigint", "host_class": "string", "note": "string",
}


def _take(value: dict, path: str) -> tuple[bool, object]:
    *above, key = path.split(".")
    for k in above:
        if not isinstance(value := value.get(k), dict):
            return False, None
    return (True, value.pop(key)) if key in value else (False, None)


def _put(value: dict, path: str, inner: object) -> None:
    *above, key = path.split(".")
    for k in above:
        if not isinstance(value.get(k), dict):
            value[k] = {}
        value = value[k]
    value[key] = inner


def _look(value: dict, path: str) -> object:
    for k in path.split("."):
        if not isinstance(value, dict) or k not in value:
            return None
        value = value[k]
    return value


def cast(value: object, kind: str) -> object:
    """The value as the column's type, or ValueError."""
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    if kind == "boolean":
        word = str(value).strip().lower()
        if word in ("true", "1", "1.0", "false", "0", "0.0"):
            return word in ("true", "1", "1.0")
        raise ValueError(word)
    if isinstance(value, (bool, dict, list)):
        raise ValueError(kind)
    number = float(value)
    if kind == "bigint" and (number != int(number) or abs(number) >= 2**63):
        raise ValueError(kind)
    return int(number) if kind == "bigint" else number


class Routes:
    """The chain of migrations of each layout a task has met, by fingerprint.

    Whether a rule applies depends on which paths there are and on which are null or objects, and that is what a
    fingerprint stands for, so one file of a layout tells for all.
    """

    def __init__(self) -> None:
        self.chains: dict[str, list[tuple]] = {}

    def migrate(self, layout: str, value: dict) -> tuple[dict[str, object], list[str], dict[str, object]]:
        """(a value for each column, the steps taken, what no column holds)."""
        chain = self.chains.get(layout)
        row, taken, left, needed = migrate(value, MIGRATIONS if chain is None else chain)
        if chain is None and len(self.chains) < 10_000:
            self.chains[layout] = needed
        return row, taken, left


def migrate(value: dict, rules: list[tuple]) -> tuple[dict[str, object], list[str], dict[str, object], list[tuple]]:
    """(a value for each column, the steps taken, what no column holds, the rules that applied)."""
    value, taken, needed = json.loads(json.dumps(value)), [], []
    for rule in rules:
        version, kind, path, to = rule
        if kind == "rename":
            there, inner = _take(value, path)
            held = _look(value, to) if there else None
            if there and held is None:
                _put(value, to, inner)
            elif there and isinstance(held, dict) and isinstance(inner, dict):
                held.update({k: v for k, v in inner.items() if k not in held})
            elif there:
                _put(value, path, inner)
                continue
            else:
                continue
            taken.append(f"{version}:rename:{path}->{to}")
        elif _look(value, path) is None:
            _put(value, path, to)
            taken.append(f"{version}:default:{path}")
        else:
            continue
        needed.append(rule)
    row: dict[str, object] = {}
    for path, kind in COLUMNS.items():
        there, inner = _take(value, path)
        if not there or inner is None:
            continue
        if isinstance(inner, dict) and "value" in inner:
            taken.append(f"v5:unwrap:{path}")
            if (rest := {k: v for k, v in inner.items() if k != "value"}):
                _put(value, path, rest)
            inner = inner["value"]
        if isinstance(inner, list) and len(inner) == 1:
            taken.append(f"v5:unlist:{path}")
            inner = inner[0]
        try:
            row[path] = cast(inner, kind) if inner is not None else None
            if row[path] is not None and kind_of(row[path]) != kind_of(inner):
                taken.append(f"v6:cast:{path}:{kind_of(inner)}->{kind}")
        except (ValueError, TypeError, OverflowError):
            _put(value, path, inner)
            taken.append(f"v6:kept aside:{path}")
    left = {k: v for k, v in value.items() if v not in ({}, None)}
    return row, taken, left, needed


_TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def column_name(path: str) -> str:
    return path.replace(".", "_")


TABLE = ", ".join(["file_id bigint", "file_name string", "written_at timestamp_ntz", "readable boolean", "layout string", *(f"{column_name(p)} {k}" for p, k in COLUMNS.items()), "steps array<string>", "other string"])


def consistent_table(files: DataFrame) -> DataFrame:
    """One row a file in the newest layout, with the layout's fingerprint, the steps taken and what was left over as JSON.

    A body that can't be read gives a row with readable = false and nulls. A value that doesn't fit its column's
    type stays in `other`.
    """
    at = files.schema["written_at"].dataType.simpleString()
    schema = TABLE.replace("written_at timestamp_ntz", f"written_at {at}")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = Routes()
        for batch in batches:
            rows, layouts, steps, other = [], [], [], []
            for body in batch.column("body").to_pylist():
                value = read_object(body)
                layout = Layouts.fingerprint(paths_of(value)) if value is not None else None
                row, taken, left = routes.migrate(layout, value) if value is not None else (None, None, None)
                rows.append(row)
                layouts.append(layout)
                steps.append(taken)
                other.append(json.dumps(left, sort_keys=True) if left else None)
            columns = [batch.column(c) for c in ("file_id", "file_name", "written_at")]
            columns += [pa.array([r is not None for r in rows]), pa.array(layouts, pa.string())]
            columns += [pa.array([r.get(p) if r else None for r in rows], _TYPES[k]) for p, k in COLUMNS.items()]
            columns += [pa.array(steps, pa.list_(pa.string())), pa.array(other, pa.string())]
            names = ["file_id", "file_name", "written_at", "readable", "layout", *map(column_name, COLUMNS), "steps", "other"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("file_id", "file_name", "written_at", "body").mapInArrow(convert, schema)


def layout_registry(files: DataFrame) -> DataFrame:
    """(layout, version, chain, n_files): each layout's fingerprint, the version its files are of, and the steps that lead to the newest.

    A layout is of the version before the first step it needs; one that needs none is of the newest. Casts and
    unwrapped values belong to single files and aren't part of a chain.
    """
    table = consistent_table(files).where("readable")
    chain = F.filter("steps", lambda s: s.contains(":rename:") | s.contains(":default:"))
    first = F.array_min(F.transform(chain, lambda s: F.substring_index(F.substring(s, 2, 9), ":", 1).cast("int")))
    newest = max(int(version[1:]) for version, *_ in MIGRATIONS)
    named = table.select("layout", chain.alias("chain"), F.coalesce(first - 1, F.lit(newest)).alias("version"))
    return named.groupBy("layout").agg(F.min("version").alias("version"), F.min("chain").alias("chain"), F.count("*").alias("n_files"))


def layouts_in_use(files: DataFrame) -> DataFrame:
    """(layout, n_files, first_written, last_written) of each layout fingerprint among the readable files."""
    table = consistent_table(files).where("readable").select("layout", "written_at")
    return table.groupBy("layout").agg(F.count("*").alias("n_files"), F.min("written_at").alias("first_written"), F.max("written_at").alias("last_written"))
