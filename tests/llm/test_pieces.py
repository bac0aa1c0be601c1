import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affectframe.llm import pieces, sampling

from .conftest import prose, same_columns

ODD = ["", " ", "  a  b ", "日本語テキスト", "a\tb\r\nc", "x" * 3000, "▁▁ ▁a", "\x00 é ñ 𝒳", "tail ", "\n\n", "<0x0A>x"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


@pytest.fixture(scope="module")
def toy():
    scores = {"▁": -2.0, "a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.0, "bc": -2.75, "abc": -5.75, "▁a": -3.5, "▁ab": -6.0}
    ids = {p: n for n, p in enumerate(scores, 300)}
    return pieces.vocabulary(scores, ids, range(256))


def library(vocab):
    from tokenizers import Tokenizer, models

    least = min(vocab.scores.values())
    listed = [("<unk>", least), *vocab.scores.items(), *((f"<0x{b:02X}>", least) for b in range(256))]
    model = Tokenizer(models.Unigram(listed, 0, True))
    return lambda text: len(model.encode(pieces.SPACE + text.replace(" ", pieces.SPACE)).ids) if text else 0


def counted(vocab, text):
    machine, alphabet = pieces.automaton(vocab), vocab.alphabet()
    return sum(pieces.count_pieces(c, pieces.matches(c, machine, alphabet, vocab.unknown)) for c in pieces.chunks(text))


def test_counts_equal_those_of_the_library(spark, vocab):
    rows = list(enumerate(ODD[:-1] + [prose(n, 50) for n in range(20)]))
    rows += [(100 + i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    got = {r.id: r.n_tokens for r in pieces.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = library(vocab)
    assert got == {i: count(t) for i, t in rows}


@settings(max_examples=300, deadline=None)
@given(st.text("abc dé", max_size=12))
def test_ties_are_broken_as_in_the_library(toy, text):
    assert counted(toy, text) == library(toy)(text)


def all_paths(toy, text):
    """Weights of all segmentations of a text, with the space in front."""
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    paths = {0: [((), 1.0)]}
    for end in range(1, len(text) + 1):
        paths[end] = [
            (path + (toy.ids[text[start:end]],), weight * math.exp(0.7 * toy.scores[text[start:end]]))
            for start in range(end) if text[start:end] in toy.scores for path, weight in paths[start]
        ]
    total = sum(w for _, w in paths[len(text)])
    return {path: w / total for path, w in paths[len(text)]}


@pytest.mark.parametrize("text", ["abc", "abcab cab"])
def test_segmentations_come_with_their_chances(toy, text):
    n = 20_000
    numbers, sizes = sampling.segment([text] * n, [sampling.row_seed(1, i, text) for i in range(n)], sampling.Matcher(toy, 0.7))
    ends = np.cumsum(sizes)
    seen = Counter(tuple(numbers[e - s : e].tolist()) for s, e in zip(sizes, ends))
    chances = all_paths(toy, text)
    assert set(seen) <= set(chances)
    for path, chance in chances.items():
        assert abs(seen[path] / n - chance) < 5 * math.sqrt(chance / n) + 1e-3


def test_messy_rows_round_trip(messy, nothing, vocab):
    encoded = sampling.encode(messy)
    back = sampling.decode(encoded)
    same_columns(encoded.drop("pieces"), messy)
    for r in back.collect():
        assert r.decoded == r.text and (r.pieces is None) == (r.text is None)
        assert r.text != "" or r.pieces == []
    once = sampling.encode_and_decode(messy)
    assert once.columns == [*(c for c in messy.columns if c != "text"), "pieces", "decoded", "lossless"]
    assert sorted(map(repr, once.drop("lossless").collect())) == sorted(map(repr, back.select(once.drop("lossless").columns).collect()))
    assert once.filter("NOT lossless").isEmpty() and sampling.encode_and_decode(nothing).collect() == []
    again = sampling.encode(messy.repartition(5))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, encoded.collect()))
    assert sampling.encode(nothing).collect() == [] and sampling.decode(sampling.encode(nothing)).collect() == []
    counts = {(r.id, r.n_chars) for r in pieces.token_counts(messy).collect()}
    assert counts == {(r.doc_id, len(r.text or "")) for r in messy.collect()}
    assert pieces.token_counts(nothing).collect() == []


def test_the_library_decodes_the_same(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in ODD if pieces.SPACE not in t and "\x00" not in t and t]
    numbers, sizes = sampling.segment(texts, list(range(len(texts))), sampling.Matcher(vocab, 0.5))
    for text, size, end in zip(texts, sizes, np.cumsum(sizes)):
        assert model.decode(numbers[end - size : end].tolist()) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_any_text_round_trips(vocab, texts):
    numbers, sizes = sampling.segment(texts, list(range(len(texts))), sampling.Matcher(vocab, 0.5))
    for text, size, end in zip(texts, sizes, np.cumsum(sizes)):
        assert (sampling.decoded(numbers[end - size : end].tolist(), vocab.table()) if text else "") == text


def test_a_word_is_filtered_once(vocab, monkeypatch):
    made, edges = [], sampling.Matcher.edges
    monkeypatch.setattr(sampling.Matcher, "edges", lambda self, points, ends: made.append(len(points)) or edges(self, points, ends))
    matcher = sampling.Matcher(vocab, 0.5)
    batches = [[*ODD, prose(n, 200)] for n in range(6)]
    alone = [sampling.segment(texts, list(range(len(texts))), matcher) for texts in batches]
    each, kept = sum(made), sampling.Lattices(matcher)
    for most in (3_000_000, 10):  # with ten edges at most, lattices are given up before each batch
        monkeypatch.setattr(sampling, "_KEPT", most)
        made.clear()
        for texts, (numbers, counts) in zip(batches, alone):
            got = sampling.segment(texts, list(range(len(texts))), matcher, kept)
            assert got[0].tolist() == numbers.tolist() and got[1].tolist() == counts.tolist()
            read = sampling.Decoder(vocab.table()).texts(numbers, np.concatenate([[0], np.cumsum(counts)]))
            assert read == texts
        assert sum(made) < each / 3 if most > 10 else sum(made) >= each / 2
    assert kept.n_words < 200


def test_a_long_text_is_taken_in_bounded_steps(vocab, monkeypatch):
    words, letters = [], []
    sample, edges = sampling.Lattices.sample, sampling.Matcher.edges
    monkeypatch.setattr(sampling.Lattices, "sample", lambda self, w, seeds: words.append(len(w)) or sample(self, w, seeds))
    monkeypatch.setattr(sampling.Matcher, "edges", lambda self, points, ends: letters.append(len(points)) or edges(self, points, ends))
    matcher = sampling.Matcher(vocab, 0.5)
    long = " ".join(f"w{n}x" for n in range(50_000))
    numbers, counts = sampling.segment([long, ""], [1, 2], matcher)
    assert sampling.decoded(numbers.tolist(), vocab.table()) == long and counts.tolist() == [len(numbers), 0]
    assert max(words) <= 1 << 15 and max(letters) <= 1 << 15
    texts = [*ODD, prose(1, 300), *ODD]
    whole = sampling.segment(texts, list(range(len(texts))), matcher)
    monkeypatch.setattr(sampling, "_WORDS", 7)
    monkeypatch.setattr(sampling, "_CHARACTERS", 5)
    monkeypatch.setattr(sampling, "_KEPT", 10)
    parts = sampling.segment(texts, list(range(len(texts))), matcher)
    assert [x.tolist() for x in parts] == [x.tolist() for x in whole]


def test_vocabularies_that_do_not_fit_are_refused():
    for scores, n in (({"▁": 0.0, "a▁b": -1.0}, 256), ({"▁": 0.0, "\n": -1.0}, 256), ({"a": 0.0}, 256), ({"▁": 0.0}, 3)):
        with pytest.raises(ValueError):
            pieces.vocabulary(scores, {p: n for n, p in enumerate(scores)}, range(n))
