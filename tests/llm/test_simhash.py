import random
import re

import numpy as np
import pytest
import xxhash

from affectframe.llm import simhash
from affectframe.llm.components import components

from .conftest import prose, same_columns


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def smallest(ids_and_codes, distance):
    rows = list(ids_and_codes)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            out[k] = min(out.get(k, i), i)
    return [(i, out.get(k)) for (i, _), k in zip(rows, label)]


def test_messy_rows(messy, nothing):
    rows = simhash.near_duplicates(messy).collect()
    plain = [(r.doc_id, brute_fingerprint(r.text)) for r in messy.collect()]
    assert sorted(((r.id, r.fp & (1 << 64) - 1) for r in rows), key=repr) == sorted(plain, key=repr)
    assert sorted(((r.id, r.component_id) for r in rows), key=repr) == sorted(smallest(plain, 2), key=repr)
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.one_of_each(nothing).collect() == []


def test_one_of_each_keeps_one_row_of_a_component(messy):
    out = simhash.one_of_each(messy)
    same_columns(out, messy)
    plain = [(r.doc_id, brute_fingerprint(r.text)) for r in messy.collect()]
    assert sorted(brute_fingerprint(r.text) for r in out.collect()) == sorted({c for _, c in plain})  # no two are near
    unique = messy.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = {r.doc_id for r in simhash.one_of_each(unique).collect()}
    assert kept == {c for _, c in smallest([(r.doc_id, brute_fingerprint(r.text)) for r in unique.collect()], 2)}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_no_near_pair_is_missed(spark, distance):
    rng = random.Random(distance)
    codes = [rng.getrandbits(64) for _ in range(40)]
    for c in codes[:]:
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, distance + 2)):
                c ^= 1 << bit
            codes.append(c)
    codes = sorted(set(codes))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    frame = spark.createDataFrame(signed, "fp long")
    keyed = simhash.variants(frame, distance).repartition("slot", "value").sortWithinPartitions("slot", "value")
    roots = {r.node: r.root for r in components(simhash.bucket_edges(keyed, distance)).collect()}
    groups = {}
    for (s,), c in zip(signed, codes):
        groups.setdefault(roots.get(s, s), set()).add(c)
    expected = {}
    for (i, c), (_, k) in zip(enumerate(codes), smallest(enumerate(codes), distance)):
        expected.setdefault(k, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_crowded_bucket_links_sparsely():
    # All share the lower half; the upper halves are within two bits of a neighbour.
    codes = np.array([((1 << k) - 1) << 32 | 7 for k in range(33)], np.uint64)
    links = simhash.bucket_links(codes, -1, 2)
    assert len(links) == 32


def test_long_texts_are_added_up_in_steps():
    text = prose(5, 70_000).encode()
    assert simhash.fingerprint(text) == brute_fingerprint(text.decode())


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
