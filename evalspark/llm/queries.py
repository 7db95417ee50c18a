"""Queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import encode, mixing, overlap, residue, splits
from evalspark.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "eval_steps"), table(spark, sf_dir, "train_states"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted by split and source of the eval step."""
    return overlap.overlap_report(table(spark, sf_dir, "eval_steps"), table(spark, sf_dir, "train_states"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("task_no", "group_no")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(table(spark, sf_dir, "tasks"), table(spark, sf_dir, "episodes"), table(spark, sf_dir, "eval_steps"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every task."""
    return splits.assign(_groups(spark, sf_dir), table(spark, sf_dir, "split_targets")).select("task_no", "group_no", "split_name")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "split_targets")
    return splits.split_report(splits.assign(_groups(spark, sf_dir), targets), targets)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p6_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.round_trips(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    return residue.without_residue(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares, "p6_ids": p6_ids, "p6_round_trips": p6_round_trips, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_kept": p8_kept}

_NUMBER = "CASE WHEN regexp_full_match(trim({0}), '[0-9]{{1,18}}') THEN CAST(trim({0}) AS BIGINT) END"

_GROUPS = f"""
        WITH RECURSIVE t AS (
            SELECT {_NUMBER.format("task_id")} AS task, lower(trim(user_id)) AS usr, {_NUMBER.format("derived_from")} AS origin FROM tasks
        ), u AS (
            SELECT DISTINCT task, usr FROM t WHERE task IS NOT NULL AND usr NOT IN ('', '?', '-', 'n/a', 'none', 'null', 'unknown')
        ), e AS (
            SELECT x.task AS a, y.task AS b FROM u x JOIN u y ON x.usr = y.usr
            UNION SELECT task, origin FROM t WHERE origin IN (SELECT task FROM t)
            UNION SELECT origin, task FROM t WHERE origin IN (SELECT task FROM t)
        ), every AS (
            SELECT task AS v FROM t UNION SELECT {_NUMBER.format("task_id")} FROM episodes
            UNION SELECT {_NUMBER.format("split_part(step_id, ':', 1)")} FROM eval_steps
        ), reach AS (
            SELECT v, v AS w FROM every WHERE v IS NOT NULL
            UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.w = e.a
        )
        SELECT v AS task_no, min(w) AS group_no FROM reach GROUP BY v"""
_SPLITS = f"""
        SELECT task_no, x.group_no, split_name, n_episodes, n_steps FROM (
            SELECT k.*, coalesce(p.n, 0) AS n_episodes, coalesce(s.n, 0) AS n_steps FROM ({_GROUPS}) k
            LEFT JOIN (SELECT {_NUMBER.format("task_id")} AS t, count(*) AS n FROM episodes GROUP BY 1) p ON p.t = k.task_no
            LEFT JOIN (SELECT {_NUMBER.format("split_part(step_id, ':', 1)")} AS t, count(*) AS n FROM eval_steps GROUP BY 1) s ON s.t = k.task_no) x
        JOIN (
            SELECT group_no, (SELECT split_name FROM (SELECT split_name, sum(share) OVER (ORDER BY share DESC, split_name) / sum(share) OVER () AS upto FROM split_targets WHERE share > 0) WHERE upto > middle ORDER BY upto LIMIT 1) AS split_name FROM (
                SELECT group_no, (sum(weight) OVER (ORDER BY md5('0:' || group_no), group_no) - weight / 2::double) / sum(weight) OVER () AS middle FROM (
                    SELECT group_no, greatest(1, sum(coalesce(p.n, 0) + coalesce(s.n, 0))) AS weight FROM ({_GROUPS}) k
                    LEFT JOIN (SELECT {_NUMBER.format("task_id")} AS t, count(*) AS n FROM episodes GROUP BY 1) p ON p.t = k.task_no
                    LEFT JOIN (SELECT {_NUMBER.format("split_part(step_id, ':', 1)")} AS t, count(*) AS n FROM eval_steps GROUP BY 1) s ON s.t = k.task_no GROUP BY 1))) y ON x.group_no = y.group_no"""

# Prompts as words: markers cut, system turns left out; every occurrence of a word is counted, and of the pairs that share
# three quarters of the longer one's words the longest common subsequence decides.
_TURNED = "regexp_replace(prompt, '(?m)^[ \\t]*\\[(system|assistant|user|tool)\\][ \\t]*$', '<|im_start|>\\1' || chr(10), 'g')"
_SPOKEN = f"array_to_string(list_transform(list_filter(list_transform(string_split({_TURNED}, '<|im_start|>'), lambda x, i: {{'i': i, 'x': x}}), lambda t: t.i = 1 OR NOT regexp_matches(t.x, '^[ \\t]*(?i:system)\\b')), lambda t: CASE WHEN t.i = 1 THEN t.x ELSE regexp_replace(t.x, '^[ \\t]*\\w*[ \\t]*\\n?', '') END), ' ')"
_PAIRS = f"""
        WITH w AS (
            SELECT 'e' AS side, eval_id AS id, regexp_extract_all(lower(replace({_SPOKEN}, '<|im_end|>', ' ')), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_steps WHERE prompt IS NOT NULL
            UNION ALL SELECT 't', state_id, regexp_extract_all(lower(replace({_SPOKEN}, '<|im_end|>', ' ')), '[\\p{{L}}\\p{{N}}]+') FROM train_states WHERE prompt IS NOT NULL
        ), n AS (SELECT side, id, w, len(w) AS n FROM w WHERE len(w) > 0),
        o AS (SELECT side, id, n, x, row_number() OVER (PARTITION BY side, id, x) AS nth FROM (SELECT side, id, n, unnest(w) AS x FROM n)),
        c AS (SELECT a.id AS e, b.id AS t FROM o a JOIN o b ON a.side = 'e' AND b.side = 't' AND a.x = b.x AND a.nth = b.nth AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n GROUP BY 1, 2 HAVING count(*) >= 0.75 * greatest(max(a.n), max(b.n))),
        p AS (SELECT e, t, x.w AS a, y.w AS b, x.w = y.w AS same FROM c JOIN n x ON x.side = 'e' AND x.id = e JOIN n y ON y.side = 't' AND y.id = t),
        l AS (SELECT e, t, same, len(a) AS n, len(b) AS m, CASE WHEN same THEN len(a) ELSE list_reduce(a, lambda r, x: list_reduce(range(1, len(b) + 1), lambda s, j: list_append(s, greatest(s[-1], CASE WHEN b[j] = x THEN r[j] + 1 ELSE r[j + 1] END)), [0::bigint]), list_resize([0::bigint], len(b) + 1, 0::bigint))[-1] END AS l FROM p)
        SELECT e AS eval_id, t AS state_id, same FROM l WHERE l >= 0.75 * greatest(n, m)"""

ORACLES = {
    "p1_found": f"SELECT eval_id, state_id FROM ({_PAIRS})",
    "p1_report": f"""
        WITH k AS (SELECT eval_id, count(*) AS k, max(same::int) AS x FROM ({_PAIRS}) GROUP BY 1),
        s AS (SELECT eval_id, nullif(regexp_replace(lower(trim(split)), '[\\s-]+', '_', 'g'), '') AS split, nullif(regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g'), '') AS source FROM eval_steps)
        SELECT CASE WHEN split IN ('valid', 'val', 'dev') THEN 'validation' ELSE split END AS split, source, count(*) AS n_steps, count(k) AS n_overlapping, coalesce(sum(x), 0)::bigint AS n_exact, coalesce(sum(k), 0)::bigint AS n_pairs FROM s LEFT JOIN k USING (eval_id) GROUP BY 1, 2""",
    "p3_found": _GROUPS,
    "p3_splits": f"SELECT task_no, group_no, split_name FROM ({_SPLITS})",
    "p3_shares": f"""
        SELECT t.split_name, t.share AS target_share, coalesce(r, 0)::double / sum(coalesce(r, 0)) OVER () AS actual_share, coalesce(g, 0) AS n_groups, coalesce(k, 0) AS n_tasks, coalesce(e, 0)::bigint AS n_episodes, coalesce(s, 0)::bigint AS n_steps
        FROM split_targets t LEFT JOIN (SELECT split_name, sum(n_episodes + n_steps) AS r, count(DISTINCT group_no) AS g, count(*) AS k, sum(n_episodes) AS e, sum(n_steps) AS s FROM ({_SPLITS}) GROUP BY 1) c ON c.split_name = t.split_name""",
}
