"""The cosine join against all pairs."""

import random

import numpy as np
import pytest

overlap = pytest.importorskip("evalspark.llm.overlap")

SYSTEM = "<|im_start|>system\nSame rules.\n# Tools\n<|im_end|>\n"


def chat(text):
    return f"{SYSTEM}<|im_start|>user\n{text}<|im_end|>\n<|im_start|>assistant\n"


def brute(evals, trains):
    e = [(i, overlap.words(overlap.conversation(p))) for i, p, *_ in evals]
    t = [(i, overlap.words(overlap.conversation(p))) for i, p, *_ in trains]
    return {(i, j) for i, a in e for j, b in t if a and b and overlap.lcs(a, b) >= 0.75 * max(len(a), len(b))}


def frames(spark, evals, trains):
    left = spark.createDataFrame(evals, "eval_id bigint, prompt string, split string, source string, c1 int, words string")
    return left, spark.createDataFrame(trains, "state_id bigint, prompt string, term int, k string")


def some_texts(seed):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(r.choice(common) if r.random() < 0.4 else f"x{r.randint(0, 3000)}" for _ in range(r.choice([8, 30, 59, 61, 80, 200]))))
    out = list(texts)
    for text in texts[:40]:
        words = text.split()
        for share in (0.05, 0.1, 0.2, 0.3):
            copy, at = list(words), r.randrange(len(words))
            size = max(1, int(share * len(words)))
            copy[at : at + size] = [f"n{r.randint(0, 999)}" for _ in range(size)]
            out.append(" ".join(copy).upper() if r.random() < 0.3 else ", ".join(copy))
    hot = " ".join(f"h{i}" for i in range(70))
    out += [f"{hot} end{i}" for i in range(60)] + [hot] * 60
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = some_texts(seed)
    evals = [(i, None if i % 50 == 7 else "" if i % 50 == 9 else chat(t), "test", "a", 0, "") for i, t in enumerate(texts[: len(texts) // 2])]
    trains = [(1000 + i, chat(t), 0, "") for i, t in enumerate(texts[len(texts) // 2 :])]
    left, right = frames(spark, evals, trains)
    found = [tuple(x) for x in overlap.overlaps(left.repartition(3), right.repartition(5)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(evals, trains) and len(found) > 100


def test_scattered_changes_in_long_conversations(spark):
    evals, trains, r = [], [], random.Random(3)
    for i, (size, share) in enumerate([(100, 0.2), (100, 0.25), (240, 0.15), (240, 0.25), (900, 0.24), (900, 0.26)]):
        words = [f"t{i}x{j}" if j % 2 else f"c{r.randint(0, 50)}" for j in range(size)]
        at = {int(x / share) for x in range(round(size * share))}
        evals.append((i, chat(" ".join(words)), "test", "a", 0, ""))
        trains.append((100 + i, chat(" ".join(f"n{j}" if j in at else w for j, w in enumerate(words))), 0, ""))
        # Words left out in one place and put in at another.
        out = [w for j, w in enumerate(words) if j % 8]
        trains.append((200 + i, chat(" ".join(x for j, w in enumerate(out) for x in ((w, f"m{j}") if j % 7 == 3 else (w,)))), 0, ""))
    found = [tuple(x) for x in overlap.overlaps(*frames(spark, evals, trains)).collect()]
    assert sorted(found) == sorted(brute(evals, trains)) and {(i, 100 + i) for i in range(5)} <= set(found)


def test_blocks_of_any_size_give_the_same_pairs(spark, monkeypatch):
    texts = some_texts(5)
    evals = [(i, chat(t), "test", "a", 0, "") for i, t in enumerate(texts[::2])]
    trains = [(1000 + i, chat(t), 0, "") for i, t in enumerate(texts[1::2])]
    monkeypatch.setattr(overlap, "LEFT_WORDS", 1500)
    monkeypatch.setattr(overlap, "RIGHT_WORDS", 900)
    found = [tuple(x) for x in overlap.overlaps(*frames(spark, evals, trains)).collect()]
    assert sorted(found) == sorted(brute(evals, trains))


def test_conversation_leaves_markers_and_system_turns_out():
    plain = overlap.words(overlap.conversation(chat("Order #K12, ﬁne 5.5 straße now")))
    assert plain == ["order", "k12", "fine", "5", "5", "strasse", "now"]
    assert overlap.words(overlap.conversation("[system]\nRules\n[user]\nOrder K12\n\n[assistant]\nok")) == ["order", "k12", "ok"]
    assert overlap.conversation(None) == "" and overlap.words(overlap.conversation(SYSTEM)) == []


def test_lcs_and_runs():
    r = random.Random(4)
    for _ in range(100):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert overlap.lcs(a, b) == table[-1, -1]
    x = np.array([1, 2, 1, 2, 1, 2], np.uint64)
    assert len(set(overlap.runs(x, 2).tolist())) == 5 and len(overlap.runs(x, 7)) == 0


def test_no_rows_and_wordless(spark):
    left, right = frames(spark, [(1, "!!!", None, None, 0, ""), (2, None, "test", None, 0, "")], [(3, "...", 0, "")])
    assert overlap.overlaps(left, right).count() == 0
    assert overlap.overlaps(left.limit(0), right.limit(0)).count() == 0


def test_report_counts_without_writing_pairs(spark):
    text = " ".join(f"q{i}" for i in range(100))
    evals = [(1, chat(text), "Test ", "a", 0, ""), (2, chat(text + " more"), "valid", None, 0, ""), (3, chat("other words here"), "test", "A", 0, "")]
    trains = [(10 + i, chat(text), 0, "") for i in range(4)] + [(20, chat(text + " less"), 0, "")]
    rows = {(r.split, r.source): (r.n_steps, r.n_overlapping, r.n_exact, r.n_pairs) for r in overlap.overlap_report(*frames(spark, evals, trains)).collect()}
    assert rows == {("test", "a"): (2, 1, 1, 5), ("validation", None): (1, 1, 0, 5)}


def test_copies_meet_once(spark, monkeypatch):
    texts = some_texts(6)[:40]
    evals = [(100 * k + i, chat(t), "test", "a", 0, "") for k in range(6) for i, t in enumerate(texts[::2])]
    trains = [(10_000 + 100 * k + i, chat(t.upper()), 0, "") for k in range(7) for i, t in enumerate(texts)]
    met, near_pairs = [], overlap.near_pairs

    def counting(left, right):
        met.extend((side.count(), side.select("c1", "c2").distinct().count()) for side in (left, right))
        return near_pairs(left, right)

    monkeypatch.setattr(overlap, "near_pairs", counting)
    left, right = frames(spark, evals, trains)
    found = [tuple(x) for x in overlap.overlaps(left.repartition(5), right.repartition(6)).collect()]
    assert sorted(found) == sorted(brute(evals, trains)) and len(found) >= 6 * 7 * 20
    assert len(met) == 2 and all(rows == classes for rows, classes in met)
