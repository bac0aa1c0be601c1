import difflib
import hashlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from affectframe.llm import lines

from .conftest import prose

SPACES = " \t\n\x0b\x0c\r"


def ranked_texts(rows):
    """Different texts, earliest first, and the id that each is first at."""
    order = {}
    for i, t in rows:
        order[t or ""] = min(order.get(t or "", (True, 0)), (i is None, i or 0))
    return sorted(order, key=lambda t: (*order[t], hashlib.md5(t.encode()).hexdigest())), order


def worded(text):
    """Lines with a word, their characters and places."""
    found = [(x.strip(SPACES), k) for k, x in enumerate(text.split("\n")) if x.strip(SPACES)]
    return [x for x, _ in found], [len(x) for x, _ in found], [k for _, k in found]


def going(words, chars, least):
    """All runs of lines that would be deleted by themselves."""
    return {
        tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + least, len(words)) + 1)
        if j - i >= least or sum(chars[i:j]) >= lines.LEAST_CHARS
    }


def brute(rows, least=lines.LEAST_LINES):
    """``id, kept text, lines removed``, all pairs of overlapping texts aligned one after the other."""
    ranked, order = ranked_texts(rows)
    cut = {t: worded(t) for t in ranked}
    held = Counter(x for t in ranked for x in set(cut[t][0]))
    first = {}
    for t in ranked:
        for run in going(*cut[t][:2], least):
            first.setdefault(run, t)
    gone = defaultdict(set)
    for n, t in enumerate(ranked):
        words, chars, places = cut[t]
        rare = {x for x in words if held[x] <= lines.RARE}
        owners = {first[run] for run in going(words, chars, least)}
        for earlier in ranked[:n]:
            if earlier in owners or rare & set(cut[earlier][0]):
                for block in lines.doomed_lines(cut[earlier][0], words, chars, least):
                    gone[t] |= set(range(places[block[0]], places[block[-1]] + 1))
    out = []
    for i, t in rows:
        body = t or ""
        if body.strip(SPACES) and (i is None, i or 0) != order[body]:
            out.append((i, "", body.count("\n") + 1))
        else:
            kept = "\n".join(x for k, x in enumerate(body.split("\n")) if k not in gone[body])
            out.append((i, t if t is None else kept, len(gone[body])))
    return sorted(out, key=repr)


def got(frame, **options):
    return sorted(((r.id, r.kept_text, r.n_removed) for r in lines.deduplicated(frame, **options).collect()), key=repr)


def test_messy_rows(messy, nothing):
    assert got(messy) == brute([(r.doc_id, r.text) for r in messy.collect()])
    assert got(nothing) == []
    rows = lines.deduplicated(messy).select("row.*")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, messy.collect()), key=repr)


def test_blocks_common_lines_and_near_copies(spark):
    common = "All rights reserved."
    block = [prose(k, 8) for k in range(6)]
    rows = [(k, f"{prose(100 + k, 9)}\n{common}") for k in range(40)]
    rows += [(50 + k, "\n".join([*block[:k], prose(200 + k, 9), *block[k + 1 :]])) for k in range(6)]
    rows += [(70, "\n".join([prose(300, 9), *block[2:4], "", *block[4:]])), (71, "\n".join(block[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = got(docs)
    assert result == brute(rows)
    kept = {i: t for i, t, _ in result}
    assert all(common in kept[k] for k in range(40))  # a common line alone is no overlap
    assert block[5] not in kept[51]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30), st.lists(st.integers(0, 12), max_size=30))
def test_alignment_is_a_common_order(a, b):
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_alignment_is_whole_where_lines_are_unique():
    a = list(range(1, 60))
    b = [x for x in a if x % 7] + [100, 101]
    assert [i for i, _ in lines.patience(a, b)] == [i for i, x in enumerate(a) if x % 7]
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    assert sum(m.size for m in matcher.get_matching_blocks()) == len(lines.patience(a, b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 8), max_size=25), st.lists(st.integers(1, 8), max_size=25), st.integers(0, 3))
def test_aligned_blocks_and_what_is_left(earlier, later, long):
    """Blocks go by what they hold, stand on both sides, and no run that would go is left in one piece."""
    chars = [120 if x <= long else 10 for x in later]
    blocks = lines.doomed_lines(earlier, later, chars)
    held = {tuple(earlier[i:j]) for i in range(len(earlier)) for j in range(i + 1, len(earlier) + 1)}
    seen = set()
    for block in blocks:
        assert tuple(later[j] for j in block) in held and not seen & set(block)
        assert len(block) >= 3 or sum(chars[j] for j in block) >= lines.LEAST_CHARS
        seen |= set(block)
    rest = [x if j not in seen else None for j, x in enumerate(later)]
    assert not {run for run in going(rest, [0 if x is None else c for x, c in zip(rest, chars, strict=True)], 3) if None not in run} & held


def test_short_lines_are_treated_alike_however_many_hold_them(spark):
    for n in (2, 10, 11, 30):
        rows = [(k, f"{prose(1000 + k, 9)}\nChapter One\n{prose(2000 + k, 9)}") for k in range(n)]
        assert all(removed == 0 for *_, removed in got(spark.createDataFrame(rows, "doc_id long, text string")))


def test_joins_beyond_broadcasts(spark, monkeypatch):
    from affectframe.llm import common
    from affectframe.operators import joins

    rows = [(k, "\n".join([prose(k, 9), *[prose(50 + i, 7) for i in range(4) if i != k % 5], prose(3000 + k // 2, 25)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    monkeypatch.setattr(joins, "is_bounded", lambda *_: False)
    assert got(docs) == brute(rows)
