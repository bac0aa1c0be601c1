from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affectframe.llm import alignment, common
from affectframe.llm.queries import QUERIES

from .conftest import prose

ODD = ["", " ", "  a  b ", "日本語テキスト", "a\tb\r\nc  d", "▁▁ ▁a", "\x00 é ñ 𝒳", "tail ", "\n\n", "<0x0A>x", "a \n b",
       "a\x1c b", "a\x85 b", "a　 b c", " lead", "it's  don't <|endoftext|> <s> x", "x" * 3000, "1 2  3\n\n  4 "]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.Tokenizers.load())


def whole(aligner, text):
    """Counts, groups and overlap links of a text encoded as a whole, token by token."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    spans = []
    for ids, names in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return None
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        spans.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    groups, links, shared, i, j, first = [], [], 0, 0, 0, 0
    for cut in sorted({end for *_, end in spans[0]} & {end for *_, end in spans[1]}):
        i0, j0 = i, j
        while i < len(a) and spans[0][i][2] <= cut:
            i += 1
        while j < len(b) and spans[1][j][2] <= cut:
            j += 1
        groups.append(",".join(str(x) for x in a[i0:i]) + "|" + ",".join(str(x) for x in b[j0:j]))
        shared += (i - i0) * (j - j0)
    for x, start, end in spans[0]:
        while spans[1][first][2] <= start:
            first += 1
        k = first
        while k < len(b) and spans[1][k][1] < end:
            links.append((x, b[k]))
            k += 1
    return (len(a), len(b), len(groups), len(links), shared), ";".join(groups), links


def by_stretches(aligner, text):
    found = aligner.align(alignment.stretches(text)) if text else None
    if found is None or not found.valid.all():
        return None
    pairs = [divmod(p, aligner.n_b) for p in found.pairs.tolist()]
    return tuple(found.counts.sum(0).tolist()), ";".join(found.groups), pairs


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "1", "'s", "é", "日", "  ", "▁x", "\t", ".", "😀", " the", " <s>", "\x1c"]), max_size=25))
def test_stretches_give_what_the_whole_text_gives(aligner, parts):
    text = "".join(parts)
    assert by_stretches(aligner, text) == whole(aligner, text)


def expected(aligner, texts):
    found = [whole(aligner, t) for t in texts]
    counts = Counter(link for w in found if w for link in w[2])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (*w[0][:4], sum(counts[x] == most[x[1]] for x in w[2]), sum(counts[x] for x in w[2]),
         sha256(w[1].encode()).hexdigest(), w[0][4]) if w else (0, 0, 0, 0, 0, 0, "", 0)
        for w in found
    ]


@pytest.mark.parametrize("limit", [None, 0])
def test_documents_against_brute_force(spark, aligner, monkeypatch, limit):
    """Also where the counts are too many to be broadcast, and texts are taken in small parts."""
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(alignment, "_AT_ONCE", 50)
        monkeypatch.setattr(alignment, "_REMEMBERED", 20)
    texts = [*ODD, None, prose(1, 200), prose(1, 200)]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, pair int")
    got = alignment.aligned(docs).collect()
    assert sorted((r.id is not None, r.id or 0, *r[1:]) for r in got) == sorted(
        (i != 3, 0 if i == 3 else i // 2, *e) for i, e in enumerate(expected(aligner, texts))
    )


def test_query_against_brute_force(spark, aligner):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: e for r, e in zip(rows, expected(aligner, [r.text for r in rows]), strict=True)}
    got = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want and len(got) == len(rows)


def test_links_overlap_or_share_a_group(spark, aligner, monkeypatch):
    monkeypatch.setattr(alignment, "_AT_ONCE", 40)
    texts = [*ODD, prose(3, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shared in (False, True):
        rows = alignment.links(docs, shared_group=shared).collect()
        counts = Counter(r.id for r in rows)
        for i, text in enumerate(texts):
            w = whole(aligner, text)
            assert counts[i] == (w[0][4 if shared else 3] if w else 0)
        body = {i: (" " + t).encode() for i, t in enumerate(texts)}
        for r in rows:
            assert body[r.id][r.a_start:r.a_end] == aligner.a_bytes[r.a_token]
            assert body[r.id][r.b_start:r.b_end] == aligner.b_bytes[r.b_token]
            assert r.overlap == max(0, min(r.a_end, r.b_end) - max(r.a_start, r.b_start))
            assert shared or r.overlap > 0
    assert len({(r.id, r.a_index, r.b_index) for r in rows}) == len(rows)


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for n, k, m in ((4, 5, 6), (1, 3, 1), (3, 0, 2), (6, 4, 3)):
        dense = [rng.integers(0, 3, shape) for shape in ((n, k), (k, m))]
        sparse = [alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(1))]).astype(int), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense]
        product = alignment.row_product(*sparse)
        out = np.zeros((n, m), int)
        out[product.row_of_entry(), product.indices] = product.data
        assert (out == dense[0] @ dense[1]).all()
        turned = alignment.transposed(sparse[0])
        back = np.zeros((k, n), int)
        back[turned.row_of_entry(), turned.indices] = turned.data
        assert (back == dense[0].T).all()
        assert alignment.product_sizes(*sparse).tolist() == ((dense[0] > 0).astype(int) @ (dense[1] > 0).astype(int)).sum(1).tolist()


def test_nothing_and_long_texts(spark, nothing):
    assert alignment.aligned(nothing).collect() == [] and alignment.links(nothing).collect() == []
    long = prose(5, 400_000)  # 3 million characters
    docs = spark.createDataFrame([(1, long), (2, "x" * 200_000)], "doc_id long, text string")
    rows = {r.id: r for r in alignment.aligned(docs).collect()}
    assert rows[1].n_a > 400_000 and rows[1].n_groups <= rows[1].n_a and rows[2].n_links >= rows[2].n_a
