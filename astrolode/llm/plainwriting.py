"""Texts brought back to plain writing: what was disguised by look-alikes, digits, gaps or stretched letters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Cyrillic and Greek letters that look like Latin ones, in the order of the Latin letters after them.
_LOOKALIKES = "аеорсухѕіјкмнвтԁԛԝһɡӏαορνικτυχ", "aeopcyxsijkmhbtdqwhglaopviktux"
# Signs in the place of letters.
_SIGNS = "013457@$!€|", "oieastasiei"

_LETTER_FOR = str.maketrans(*_LOOKALIKES)
_SIGN_FOR = str.maketrans(*_SIGNS)
_ODD = re.compile("[" + _LOOKALIKES[0] + "]")
_INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")
_GAPPED = re.compile(r"(?<![\w.])[^\W\d_]([ .\-_*·•/])[^\W\d_](?:\1[^\W\d_])+(?!\w)")
# written so that the search goes from sign to sign: a sign between letters, or at the head of a word
_SIGN_HINT = re.compile(r"[0-9@$!€|](?:(?<=[^\W\d_].)[0-9@$!€|]*[^\W\d_]|(?<!\w.)(?<![0-9])[^\W\d_]{3})")
_SIGNED = re.compile(r"(?<![\w@$])(?:[@$013457])?[^\W\d_](?:[^\W_]|[@$!|€])*(?:[@$]|[^\W_])(?![\w@$])")
_HAS_SIGN = re.compile(r"[013457@$!€|]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_MASKED = re.compile(r"(?<!\w)[^\W\d_](?:\*{2,})[^\W\d_]*(?!\w)")

#: Words put in for what can't be read back, and after what was.
MASK, DISGUISE = "xmaskx", "xdisguisex"


def _join(m: re.Match) -> str:
    word = m.group()[::2]
    # the first letter may be a word of its own
    return f"{word} {word[1:]} {DISGUISE}" if word[0] in "aeiouyà" and len(word) > 3 else f"{word} {DISGUISE}"


def _signs(m: re.Match) -> str:
    word = m.group()
    if not _HAS_SIGN.search(word) or sum(c.isalpha() for c in word) < 2 or word[:2].isdigit() or word[-2:].isdigit():
        return word
    return f"{word.translate(_SIGN_FOR)} {DISGUISE}"


def _thrice(text: str) -> bool:
    """Whether a letter stands three times in a row."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = a[1:] == a[:-1]
    return any(chr(c).isalpha() for c in set(a[2:][same[1:] & same[:-1]].tolist()))


def plain(text: str) -> str:
    """Lower case, without look-alikes, invisible characters, signs for letters, gaps in words and stretched letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        shown = _INVISIBLE.sub("", text)
        if len(shown) < len(text):
            text = re.sub(r"[^\W\d_]+[­͏᠎​-‏⁠-⁤﻿]+[^\W\d_]+", lambda m: f"{_INVISIBLE.sub('', m.group())} {DISGUISE}", text)
            text = _INVISIBLE.sub("", text)
    text = text.lower()
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii() and _ODD.search(text):
        text = re.sub(r"\w*[" + _LOOKALIKES[0] + r"]\w*", lambda m: f"{m.group().translate(_LETTER_FOR)} {DISGUISE}", text)
    text = _GAPPED.sub(_join, text)
    if _SIGN_HINT.search(text):
        text = _SIGNED.sub(_signs, text)
    if "**" in text:
        text = _MASKED.sub(MASK, text)
    if _thrice(text):
        text = _STRETCHED.sub(r"\1", text)
    return text
