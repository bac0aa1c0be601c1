import random

import pytest
from pyspark.sql import functions as F

from affectframe.functions import text as X
from affectframe.functions.predicates import (
    essential_substrings,
    has_words,
    is_ceremonial,
    is_repost,
    mentions_any,
)
from affectframe.constants import EVENT_KEYWORDS


@pytest.mark.parametrize("raw, cleaned", [
    (None, ""),
    ("", ""),
    ("     ", ""),
    ("RT @name: hello world", "hello world"),
    ("rt @naıme: hello world", "hello world"),
    ("artı party rt. word", "artı party word"),
    ("RT RT @a: @b: word", "word"),
    ("see https://t.co/abc and http://x.y/%20a(b) www.foo.com/a end", "see and end"),
    ("in pinterest.co/xyz here", "pinteres here"),
    ("@@one:two left", "left"),
    ("write foo@bar.com now", "write foo.com now"),
    ("#Türkiye is #one_2", "Türkiye one_2"),
    ("so 😀 much 漢字 more ♥️", "much more"),
    ("a\x1cbcd efg", "bcd efg"),
    ("x²yz ½ab", "x²yz ½ab"),
    ("ve mü KI ab Kİ ı abc", "ve mü KI abc"),
    ("café is", "cafe"),
    ("one & two; three! four?", "one two three! four?"),
    ('"quoted"\nline', "quoted line"),
])
def test_clean_text(evaluate, raw, cleaned):
    assert evaluate([raw], X.clean_text) == [cleaned]


def test_cleaning_equals_its_single_steps(evaluate):
    """The fused pass gives what the steps give one after the other."""
    alphabet = list("RrTt @:#.,!?-_/aZ9ıİşü²½😀漢é́ \x1c\n\t&;'\"%()") + [
        "RT @", "http://", "www.", "t.co/", " ve ", "K", "®", "️", "ſ", "～"
    ]
    rng = random.Random(7)
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)]

    def steps(t):
        t = X.strip_mentions(X.strip_urls(X.strip_repost_marks(t)))
        t = X.collapse_whitespace(X.strip_emoji(X.unwrap_hashtags(t)))
        return F.trim(X.drop_short_words(X.strip_special(t)))

    assert evaluate(values, X.clean_text) == evaluate(values, steps)


def test_cleaning_plain_text_twice_changes_nothing(evaluate):
    once = evaluate(["the quick brown foxes ve jump"], X.clean_text)
    assert evaluate(once, X.clean_text) == once


def test_long_urls_and_words_do_not_exhaust_the_stack(evaluate):
    url = "before https://x.y/" + "aB1%" * 20_000 + " after"
    word = "w" * 100_000
    assert evaluate([url, word], X.clean_text) == ["before after", word]
    assert evaluate([word, word + " b c"], has_words) == [False, True]


def test_strict_emoji_keeps_other_scripts(evaluate):
    assert evaluate(["漢字 😀"], lambda c: X.strip_emoji(c, strict=True)) == ["漢字 "]
    assert evaluate(["漢字 😀"], X.strip_emoji) == [" "]


@pytest.mark.parametrize("text, enough", [
    (None, False), ("", False), ("  ", False), ("one two", False), ("one, two", False),
    ("one two three", True), ("a-b-c", True), ("...a...b...c", True), ("ş ı ü", True), ("2 ½ _", True),
])
def test_has_words(evaluate, text, enough):
    assert evaluate([text], has_words) == [enough]


@pytest.mark.parametrize("text, expected", [
    (None, False), ("Allah rahmet eylesin", True), ("saygıyla", False), ("Saygı ile", True),
    ("şehitlerimizi", True), ("şehitlerim", False), ("19 mayıs", True), ("219 mayıs", False),
    ("bayramınız kutlu olsun", True), ("iyi ki", True), ("iyi kimse", False), ("ruhları şad olsun", True),
])
def test_ceremonial(evaluate, text, expected):
    assert evaluate([text], is_ceremonial) == [expected]


def test_keywords(evaluate):
    texts = [None, "Bugün MITING", "Mitingimiz", "MİTİNG", "resmi törende", "hiç"]
    # Lower-casing a dotted capital I leaves a combining dot behind it.
    assert evaluate(texts, mentions_any) == [False, True, True, False, True, False]
    assert evaluate(["MİTİNG"], lambda c: mentions_any(c, locale="tr")) == [True]
    assert len(essential_substrings(EVENT_KEYWORDS)) == 13
    assert evaluate(["x"], lambda c: mentions_any(c, [])) == [False]


def test_repost(evaluate):
    assert evaluate(["RT @x", "rt @x", " RT @x", None], is_repost) == [True, False, False, False]


def test_small_functions(evaluate):
    names = ["ANGER", "two Words", "ßx", "élan", "", None]
    assert evaluate(names, X.capitalize) == ["Anger", "Two words", "Ssx", "Élan", "", None]
    assert evaluate(["A b C"], X.slug) == ["a_b_c"]
    assert evaluate(["x" * 200, "x" * 201], X.preview) == ["x" * 200, "x" * 200 + "..."]
    assert evaluate(["NA", "None", "", "nan", "Nana"], X.missing_to_null) == [None] * 4 + ["Nana"]
    assert evaluate([None, "", "  \x1c", "a"], X.is_blank) == [True, True, True, False]
    assert evaluate(["İIıi"], lambda c: X.lower_text(c, "tr")) == ["iııi"]
