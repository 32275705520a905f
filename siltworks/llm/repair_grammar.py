"""Re-Pair grammars over the token sequences of many texts at once, in numpy.

Tokens are runs of word characters, and single marks; blanks part them. Numbers within words count as one
digit, so that ``field_0`` and ``field_17`` are the same token. In each round every text replaces the pairs
that repeat in it, most frequent first where pairs overlap, until no pair repeats: what stays is the text's
start rule, and the rounds' replacements are its grammar.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_CLASS = np.full(256, 1, dtype=np.uint8)  # 0 blank, 1 mark, 2 word
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = 2
_CLASS[128:] = 2
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(1 << 16, _FACTOR, dtype=np.uint64)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Tokens:
    """The tokens of several texts in a row: text number, begin and size in bytes, hash, and whether a number or word."""

    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    word: np.ndarray
    number: np.ndarray
    data: np.ndarray

    @property
    def apart(self) -> np.ndarray:
        """Whether a blank stands before the token."""
        return np.r_[True, self.begin[1:] > self.begin[:-1] + self.size[:-1]] if len(self.begin) else np.zeros(0, bool)


def tokenize(texts: list[bytes]) -> Tokens:
    """The tokens of the texts; a text without any has none."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = _CLASS[data]
    first = (kind != 0) & ((kind == 1) | np.r_[True, kind[1:] != kind[:-1]])
    begin = np.flatnonzero(first)
    stop = np.r_[begin[1:], len(data)]
    word = kind[begin] == 2
    # a word ends before the next blank or mark; as blanks begin no token, count its word bytes
    inside = np.add.reduceat((kind == 2).astype(np.int32), begin) if len(begin) else begin
    size = np.where(word, inside, 1)
    number = word & _DIGIT[data[begin]]
    digit = _DIGIT[data]
    again = digit & np.r_[False, digit[:-1]]  # further digits of a number within a word count for nothing
    level = np.where(digit, np.uint8(48), data).astype(np.uint64) + np.uint64(1)
    place = np.cumsum(~again) - 1  # place of each byte, not counting those
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros(0, np.uint64), none.astype(bool), none.astype(bool), data)
    own = np.maximum(np.searchsorted(begin, np.arange(len(data)), side="right") - 1, 0)
    at = np.clip(place - place[begin][own], 0, 1 << 16)
    term = np.where(again | (kind == 0), np.uint64(0), level * _POWERS[at])
    h = np.add.reduceat(term, begin)
    return Tokens(np.searchsorted(ends, begin, side="right"), begin, size, _mix(h), word, number, data)


@dataclass
class Grammars:
    """The grammars of several texts.

    By text: length of the start rule, number of rules, greatest reuse of a rule (share of the text's tokens), and the
    share of blanks among the borders that rules close (whether the two parts of a replaced pair stood apart). By
    token: whether a rule holds it. By symbol of the start rules, in order: text, tokens in it, and a hash of the
    tokens that it expands to, which is the same in every text.
    """

    start: np.ndarray
    rules: np.ndarray
    reuse: np.ndarray
    apart: np.ndarray
    covered: np.ndarray
    text: np.ndarray
    width: np.ndarray
    expansion: np.ndarray


def infer(text: np.ndarray, symbols: np.ndarray, texts: int, apart: np.ndarray | None = None) -> Grammars:
    """Grammars of texts whose tokens follow each other; `apart` tells which tokens have a blank before them.

    Rounds go on until no pair repeats in any text.
    """
    n0 = np.maximum(np.bincount(text, minlength=texts), 1).astype(float)
    gap = np.zeros(len(text), bool) if apart is None else apart
    rules, reuse, closed, gaps = np.zeros(texts, np.int64), np.zeros(texts), np.zeros(texts), np.zeros(texts)
    # of each symbol: text, name, first token, tokens, hash of its expansion, factor to shift a hash over it
    t, s, first, w = text.astype(np.int64), symbols.copy(), np.arange(len(text)), np.ones(len(text), np.int64)
    e, shift = symbols.copy(), np.full(len(text), _FACTOR)
    done: list[tuple[np.ndarray, ...]] = []
    while (n := len(s)) >= 2:
        pair = _mix(s[:-1] * np.uint64(3) + _mix(s[1:]) + t[:-1].astype(np.uint64) * _FACTOR)
        at = np.flatnonzero(t[:-1] == t[1:])
        bits = np.uint64(max(1, int(n).bit_length()))
        key = np.sort((pair[at] >> bits << bits) | at.astype(np.uint64))
        place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        group = key >> bits
        edge = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        count = np.diff(np.r_[np.flatnonzero(edge), len(group)])
        counted = np.zeros(n, np.int64)
        counted[place] = np.repeat(count, count)
        best = np.zeros(texts, np.int64)
        np.maximum.at(best, t[place[edge]], count)
        # the frequent pairs of each text, and of overlapping ones the more frequent, then the left
        chosen = (counted >= 2) & (counted * 2 >= best[t])
        left = np.r_[0, counted[:-1]] * np.r_[False, chosen[:-1]]
        right = np.r_[counted[1:], 0] * np.r_[chosen[1:], False]
        chosen &= (counted >= right) & (counted >= left)
        run = np.flatnonzero(chosen & ~np.r_[False, chosen[:-1]])
        if not len(run):
            break
        begin = np.zeros(n, np.int64)
        begin[run] = run
        begin = np.maximum.accumulate(begin)
        chosen &= (np.arange(n) - begin) % 2 == 0
        where = np.flatnonzero(chosen)
        _, inv, used = np.unique(pair[where], return_index=True, return_counts=True)
        rules += np.bincount(t[where[inv]], minlength=texts)
        size = w[where[inv]] + w[where[inv] + 1]
        np.maximum.at(reuse, t[where[inv]], used * size / n0[t[where[inv]]])
        closed += np.bincount(t[where], minlength=texts)
        gaps += np.bincount(t[where], gap[first[where + 1]], minlength=texts)
        s[where], w[where] = pair[where], w[where] + w[where + 1]
        e[where], shift[where] = e[where] * shift[where + 1] + e[where + 1], shift[where] * shift[where + 1]
        keep = np.ones(n, bool)
        keep[where + 1] = False
        rest = best[t] >= 2  # texts without a repeated pair are done
        if not rest.all():
            over = keep & ~rest
            done.append((t[over], first[over], w[over], e[over]))
            keep &= rest
        t, s, first, w, e, shift = t[keep], s[keep], first[keep], w[keep], e[keep], shift[keep]
    done.append((t, first, w, e))
    t, first, w, e = (np.concatenate(x) for x in zip(*done, strict=True))
    o = np.argsort(first, kind="stable")
    t, first, w, e = t[o], first[o], w[o], e[o]
    covered = np.ones(len(text), bool)
    covered[first[w == 1]] = False
    return Grammars(np.bincount(t, minlength=texts), rules, reuse, gaps / np.maximum(closed, 1), covered, t, w, _mix(e))


def segments(g: Grammars, every: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start rules in segments that end with a symbol one in `every` of which ends one: text, hash, tokens of each.

    A segment is a rule of its own, named by its symbols' expansions alone, so equal runs of symbols give equal
    segments in every text; where texts differ, only the segments around the difference do.
    """
    if not len(g.text):
        return g.text, g.expansion, g.width
    last = (g.expansion % np.uint64(every) == 0) | np.r_[g.text[1:] != g.text[:-1], True]
    begin = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    number = np.cumsum(np.r_[False, last[:-1]])
    place = np.arange(len(last)) - begin[number]
    term = _mix(g.expansion + (place.astype(np.uint64) + np.uint64(1)) * _FACTOR)
    return g.text[begin], _mix(np.add.reduceat(term, begin)), np.add.reduceat(g.width, begin)
