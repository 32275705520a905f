"""One pass over a JSON text, giving a (path, positions, names, kind, value) event per node."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

_BLANK = r"[ \t\n\r]*+"
_STRING = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
_ATOM = r"(?:true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)"
_SCALAR = rf'(?:"{_STRING}"|{_ATOM})'
_VALUE = re.compile(rf'{_BLANK}(?:([{{\[])|"({_STRING})"|({_ATOM}))')
_NAME = re.compile(rf'{_BLANK}"({_STRING})"{_BLANK}:')
_NEXT = re.compile(rf"{_BLANK}([,}}\]])")
_END = re.compile(rf"{_BLANK}\Z")
#: a scalar, or an array or object of nothing but scalars
_FLAT = re.compile(
    rf"{_BLANK}(?:{_SCALAR}|\[{_BLANK}(?:{_SCALAR}{_BLANK}(?:,{_BLANK}{_SCALAR}{_BLANK})*+)?+\]"
    rf'|\{{{_BLANK}(?:"{_STRING}"{_BLANK}:{_BLANK}{_SCALAR}{_BLANK}(?:,{_BLANK}"{_STRING}"{_BLANK}:{_BLANK}{_SCALAR}{_BLANK})*+)?+\}})'
)

Event = tuple[str, tuple[int, ...], tuple[str, ...], str, str | None]


class Incomplete(ValueError):
    """The text is no complete JSON value."""


def _unescape(raw: str) -> str:
    return json.loads(f'"{raw}"') if "\\" in raw else raw


@lru_cache(maxsize=256)
def ways(wanted: frozenset[str]) -> frozenset[str]:
    """The wanted paths and all paths that lead to them."""
    return frozenset(p[:i] for p in wanted for i in [0, *[m.start() for m in re.finditer(r"\.|\[\]|\{\}", p)], len(p)])


def events(text: str, maps: frozenset[str] = frozenset(), wanted: frozenset[str] | None = None) -> list[Event]:
    """The nodes of one JSON text, parents before children.

    Steps into arrays are written ``[]`` and add the element's position. Objects whose path is in `maps`
    hold data in their names: a step into one is written ``{}`` and adds the name's position and the name.
    Other steps are ``.name``. `wanted` keeps the nodes at exactly these paths, and what lies on no way to them is
    only checked. A name that repeats within an object counts once, with its last value. A text that is one JSON
    string is read once more as the JSON that it holds. Raises Incomplete for any other text.
    """
    out: list[Event | None] = []
    on_way = None if wanted is None else ways(wanted)
    # a frame: [is_array, path, positions, names, count, names seen -> (start, end) in out, current name]
    stack: list[list] = []
    path, pos, names, at, top = "", (), (), 0, None
    while True:
        opened = False
        if on_way is not None and path not in on_way and (m := _FLAT.match(text, at)):
            at = m.end()
        else:
            if not (m := _VALUE.match(text, at)):
                raise Incomplete
            at = m.end()
            mark, string, atom = m.groups()
            if string is not None:
                string = _unescape(string)
                if not stack:
                    top = string
            if wanted is None or path in wanted:
                if mark:
                    out.append((path, pos, names, "object" if mark == "{" else "array", None))
                elif string is not None:
                    out.append((path, pos, names, "string", string))
                else:
                    out.append((path, pos, names, "null" if atom == "null" else "boolean" if atom in ("true", "false") else "number", None if atom == "null" else atom))
            if mark:
                stack.append([mark == "[", path, pos, names, 0, {}, None])
                opened = True
        # on to the next value, out of all that ends here
        while True:
            if opened:
                opened = False
                m = _NEXT.match(text, at)
                if not (m and m[1] == ("]" if stack[-1][0] else "}")):
                    break
                at = m.end()
                stack.pop()
            if not stack:
                if not _END.match(text, at):
                    raise Incomplete
                if top is not None:
                    try:
                        return events_of_value(top, maps, wanted)
                    except Incomplete:
                        pass
                return [e for e in out if e is not None]
            f = stack[-1]
            if not f[0]:
                f[5][f[6]] = (f[5][f[6]][0], len(out))
            f[4] += 1
            if not (m := _NEXT.match(text, at)):
                raise Incomplete
            at = m.end()
            if m[1] == ",":
                break
            if m[1] != ("]" if f[0] else "}"):
                raise Incomplete
            stack.pop()
        f = stack[-1]
        if f[0]:
            path, pos, names = f[1] + "[]", (*f[2], f[4]), (*f[3], "")
            continue
        if not (m := _NAME.match(text, at)):
            raise Incomplete
        at, name = m.end(), _unescape(m[1])
        if name in f[5]:
            start, stop = f[5][name]
            out[start:stop] = [None] * (stop - start)
        f[5][name], f[6] = (len(out), len(out)), name
        if f[1] in maps:
            path, pos, names = f[1] + "{}", (*f[2], f[4]), (*f[3], name)
        else:
            path, pos, names = (f"{f[1]}.{name}" if f[1] else name), f[2], f[3]


def events_of_value(text: str, maps: frozenset[str], wanted: frozenset[str] | None) -> list[Event]:
    """The events of a text held in a JSON string; a further string level isn't opened."""
    if text.lstrip(" \t\n\r")[:1] not in ("{", "["):
        raise Incomplete
    return events(text, maps, wanted)


def safe_events(text: str | None, maps: frozenset[str] = frozenset(), wanted: frozenset[str] | None = None) -> Iterator[Event]:
    """The events, or none if the text is null or no complete JSON."""
    if text is None:
        return iter(())
    try:
        return iter(events(text, maps, wanted))
    except Incomplete:
        return iter(())
