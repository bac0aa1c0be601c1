import random
from collections import Counter

from affectframe.llm import lines

from .conftest import prose
from .test_lines import brute, going, ranked_texts, worded

def got(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.id: r.kept_text for r in lines.deduplicated(frame).collect()}


def test_long_lines_go_however_many_hold_them(spark):
    passage, two = prose(1, 60), [prose(2, 14), prose(3, 14)]
    short = "All rights reserved."
    rows = [(k, "\n".join([prose(100 + k, 9), passage, prose(200 + k, 9), *two, prose(300 + k, 9), short])) for k in range(15)]
    kept = got(spark, rows)
    assert kept[0] == rows[0][1]
    for k in range(1, 15):
        assert passage not in kept[k] and two[0] not in kept[k] and two[1] not in kept[k]
        assert kept[k] == "\n".join([prose(100 + k, 9), prose(200 + k, 9), prose(300 + k, 9), short])


def test_blank_lines_do_not_part_a_run(spark):
    block = [f"line {k}" for k in range(5)]
    rows = [(k, "\n".join([prose(400 + k, 9), *block, prose(500 + k, 9)])) for k in range(12)]
    rows += [(50, "\n\n".join([prose(600, 9), *block, prose(601, 9)]))]
    assert got(spark, rows)[50] == f"{prose(600, 9)}\n\n\n{prose(601, 9)}"


def test_no_shared_run_is_left_in_one_piece(spark):
    rng = random.Random(5)
    pool = [prose(k, 3) for k in range(25)] + [prose(700 + k, 25) for k in range(5)] + [""] * 4
    rows = []
    for k in range(90):
        own = [f"own {k} {n}" for n in range(2)]
        rows.append((k, "\n".join(rng.choice(pool + own) for _ in range(rng.randrange(1, 14)))))
    base = [rng.choice(pool) for _ in range(20)]
    for k in range(30):  # near copies
        edited = [x if rng.random() > 0.2 else rng.choice([f"edit {k}", "", rng.choice(pool)]) for x in base]
        rows.append((100 + k, "\n".join(edited)))
    result = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.kept_text, r.n_removed) for r in result), key=repr) == brute(rows)
    # Whatever went stands in an earlier text, in a run that goes; what stays has no such run in one piece.
    kept, (ranked, order) = {r.id: r.kept_text for r in result}, ranked_texts(rows)
    runs = {t: going(*worded(t)[:2], lines.LEAST_LINES) for t in ranked}
    held, removed = set(), 0
    for t in ranked:
        words, chars, places = worded(t)
        left = worded(kept[order[t][1]])[0]
        covered = {j for run in runs[t] & held for i in range(len(words)) if tuple(words[i:i + len(run)]) == run for j in range(i, i + len(run))}
        assert not (Counter(words) - Counter(left)) - Counter(words[j] for j in covered)
        removed += len(words) - len(left)
        held |= runs[t]
    assert removed > 300


def test_runs_whose_lines_have_different_owners(spark):
    block = [f"line {k}" for k in range(3)]
    rows = [(10 * n + k, f"{x}\n{prose(800 + 10 * n + k, 6)}") for n, x in enumerate(block) for k in range(12)]
    rows = [(i, f"{prose(900 + i, 6)}\n{t}") for i, t in rows]
    rows = list({t: (k, t) for k, (_, t) in enumerate(rows)}.values())
    rows += [(100, "\n".join([prose(990, 7), *block])), (101, "\n".join([*block, prose(991, 7)]))]
    kept = got(spark, rows)
    assert kept[100] == rows[-2][1] and kept[101] == prose(991, 7)


def test_moved_passages(spark):
    p, q = [prose(30 + k, 8) for k in range(5)], [prose(40 + k, 8) for k in range(3)]
    rows = [(1, "\n".join(q + p)), (2, "\n".join([*p, *q, "x"])), (3, "\n".join([*p, *q, "y"]))]
    assert got(spark, rows) == {1: rows[0][1], 2: "x", 3: "y"}


def test_passages_that_stand_twice(spark):
    passage = [prose(50 + k, 8) for k in range(4)]
    twice, short = [*passage, "between", *passage], ["a", "b"]
    rows = [(1, "\n".join(["one", *passage, "two"])), (2, "\n".join(["three", *twice, "four"]))]
    rows += [(3, "\n".join(["five", *twice, "six"])), (4, "\n".join(["seven", *passage, "eight"]))]
    rows += [(20 + k, "\n".join([f"own {k}", *passage, f"own too {k}", *passage, *short, f"end {k}"])) for k in range(12)]
    kept = got(spark, rows)
    assert kept[1] == rows[0][1]
    assert (kept[2], kept[3], kept[4]) == ("three\nbetween\nfour", "five\nsix", "seven\neight")
    assert kept[20] == "own 0\nown too 0\na\nb\nend 0"
    assert all(kept[20 + k] == f"own {k}\nown too {k}\nend {k}" for k in range(1, 12))
