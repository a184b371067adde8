"""Passages, words and character n-grams of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Signs at which a passage ends; digits and blank lines end one as well.
_ENDS = ".!?:;\"«»“”„|()[]{}¶§\x00"
_OTHER, _LETTER, _END, _SPACE, _NEWLINE, _APOSTROPHE = range(6)

#: Characters of the texts that are taken together; a longer text is taken in pieces that end where a passage does.
PIECE = 1 << 16

#: Characters of the n-grams; the place before and after a word counts as one.
GRAM = 4

# Odd multipliers for hashes modulo 2 ** 64.
_STEP, _MIX, _PAIR, _SALT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        kinds[i] = _LETTER if c.isalpha() else _SPACE if c.isspace() else _OTHER
    kinds[[ord(c) for c in _ENDS + "0123456789"]] = _END
    kinds[[ord(c) for c in "'’"]] = _APOSTROPHE
    kinds[ord("\n")] = _NEWLINE
    return kinds


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Successive powers of the step, and their inverses, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_STEP, inverse))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Words:
    """The words of some texts, in order, and the n-grams in them; passages that have words are numbered from 0."""

    text: str
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # hashes
    passage: np.ndarray  # of each word
    doc: np.ndarray  # of each passage
    pair: np.ndarray  # hashes of neighbours in a passage
    pair_at: np.ndarray  # passage of each pair
    gram: np.ndarray
    gram_at: np.ndarray

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, pairs and n-grams, and the passage of each."""
        return np.concatenate([self.word, self.pair, self.gram]), np.concatenate([self.passage, self.pair_at, self.gram_at])

    def passages(self) -> list[str]:
        """The text of each passage, from its first to its last word."""
        first = np.flatnonzero(np.diff(self.passage, prepend=-1))
        last = np.append(first[1:], self.passage.size) - 1
        return [self.text[a:b] for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)] if first.size else []


def words(texts: list[str]) -> Words:
    """texts are in plain writing. A passage ends at a sign of its kinds, a digit, a blank line or the text's end."""
    joined = "\x00" + "\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts) + "\x00"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = cp.size
    kind = _kinds()[cp]
    letter = kind == _LETTER
    inner = np.flatnonzero(kind == _APOSTROPHE)
    inner = inner[(inner > 0) & (inner < n - 1)]
    inner = inner[letter[inner - 1] & letter[inner + 1]]
    letter[inner] = True
    over = kind == _END
    lines = np.flatnonzero(kind == _NEWLINE)
    if lines.size > 1:
        dark = np.cumsum((kind != _SPACE) & (kind != _NEWLINE))
        over[lines[:-1][dark[lines[1:]] == dark[lines[:-1]]]] = True
    at = np.cumsum(over, dtype=np.int64)
    doc = np.cumsum(cp == 0, dtype=np.int64) - 1
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the text ends with no letter
    up, down = _powers(PIECE if n < PIECE else n)
    value = np.where(letter, cp, 1).astype(np.uint64)
    value[inner] = ord("'")
    sums = np.concatenate([[np.uint64(0)], np.cumsum((value * _PAIR + _SALT) * up[:n])])
    word = _mixed((sums[end] - sums[start]) * down[start])
    new = np.diff(at[start], prepend=-1) != 0
    passage, number = np.cumsum(new) - 1, at[start][new]
    same = ~new[1:]
    pair = _mixed(word[:-1] * _PAIR + word[1:])[same]
    first = np.flatnonzero(np.logical_and.reduce([letter[i : n - GRAM + 1 + i] for i in range(1, GRAM - 1)])) if n >= GRAM else np.empty(0, np.int64)
    gram = _mixed((sums[first + GRAM] - sums[first]) * down[first] + _SALT)
    return Words(joined, start, end, word, passage, doc[start][new], pair, passage[:-1][same], gram, np.searchsorted(number, at[first + 1]))


def pieces(texts: list[str], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about size characters, with their places in the list; long texts in pieces.

    A piece of a long text ends at the last end of a passage in it, or at the last space, or anywhere if it has none.
    """
    places, held, total = [], [], 0
    for i, text in enumerate(texts):
        while len(text) > size:
            head = text[:size]
            cut = max(max(head.rfind(c) for c in _ENDS), head.rfind("\n\n"))
            cut = cut + 1 if cut > 0 else max(head.rfind(" "), head.rfind("\n")) + 1 or size
            yield [i], [text[:cut]]
            text = text[cut:]
        if held and total + len(text) > size:
            yield places, held
            places, held, total = [], [], 0
        places.append(i)
        held.append(text)
        total += len(text) + 1
    if held:
        yield places, held
