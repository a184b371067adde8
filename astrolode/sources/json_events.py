"""A strict streaming reader of JSON texts: path, ordinals and value of every leaf, without building the document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![0-9A-Za-z.+-]))')
_BLANK = " \t\n\r"

#: What stands for the start of an object or array in the stream of values.
OBJECT, ARRAY = object(), object()


class Malformed(ValueError):
    """The text is not one well-formed JSON value."""


def _string(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def events(text: str) -> Iterator[tuple[tuple, object]]:
    """(path, value) in the order of the text; each step of a path is a key (str) or a position (int).

    Scalars come as str, None, or a (text,) tuple for numbers and booleans; an object or array gives OBJECT or ARRAY
    before its content. Nesting may be of any depth. Raises Malformed, possibly after some events.
    """
    at, path, kinds = 0, [], []
    match, size = _TOKEN.match, len(text)
    want = "value"  # value, first (value or end of array), key, firstkey (key or end of object), colon, next
    while True:
        if not kinds and want == "next":
            if text[at:].strip(_BLANK):
                raise Malformed
            return
        m = match(text, at)
        if m is None:
            raise Malformed
        at = m.end()
        mark, string, plain = m.groups()
        if want in ("value", "first") and mark not in (",", ":", "}") and not (mark == "]" and want == "value"):
            if mark == "]":
                kinds.pop()
                path.pop()
                want = "next"
            elif mark:
                yield tuple(path), OBJECT if mark == "{" else ARRAY
                kinds.append(mark)
                path.append(None if mark == "{" else 0)
                want = "firstkey" if mark == "{" else "first"
            else:
                yield tuple(path), _string(string) if string else None if plain == "null" else (plain,)
                want = "next"
        elif want in ("key", "firstkey") and string:
            path[-1] = _string(string)
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif mark == "}" and (want == "firstkey" or want == "next" and kinds[-1] == "{") or mark == "]" and want == "next" and kinds[-1] == "[":
            kinds.pop()
            path.pop()
            want = "next"
        elif mark == "," and want == "next":
            if kinds[-1] == "{":
                want = "key"
            else:
                path[-1] += 1
                want = "value"
        else:
            raise Malformed
        if at > size:
            raise Malformed
