"""Statistics of one text, and of Arrow batches of texts. They read whole texts."""

from __future__ import annotations

from collections import Counter
from itertools import islice

UPPER_BYTES = bytes(range(65, 91))
LOWER_BYTES = bytes(range(97, 123))
DIGIT_BYTES = bytes(range(48, 58))
# The characters that count as symbols, and marks of a sentence.
SYMBOL_BYTES = b"#*$%&|<>"
MARK_BYTES = b"!?"
POINT_BYTES = b".,;:"
_CONTINUATION = bytes(range(0x80, 0xC0))
_HIGH = bytes(range(0x80, 0x100))


def held(text: bytes, which: bytes) -> int:
    """How many bytes are among the given ones."""
    return len(text) - len(text.translate(None, which))


def code_points(text: bytes) -> int:
    return len(text) - held(text, _CONTINUATION)


def repeated_words(words: list[bytes]) -> int:
    """Words within a three-word window that occurs twice or more, the first one included."""
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total = end = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    return (
        len(words),
        sum(map(len, words)) - held(text, _CONTINUATION),
        held(text, SYMBOL_BYTES),
        duplicate_lines(text)[1],
        repeated_words(words),
    )


def body(value) -> bytes:
    """UTF-8 of an Arrow value; a null is empty."""
    return value.as_py() if value.is_valid else b""
