"""Text that was decoded with the wrong encoding: found, and restored where nothing was lost.

A piece of text is re-encoded in each candidate legacy encoding and strictly decoded as each encoding that may
have been intended; the round is repeated for nested layers, and a layer is undone if the garbling cost of the
piece drops. Pieces are the lines that hold characters beyond ASCII, and the words of lines that don't decode as
a whole. Where some bytes are gone, the sequences that still decode prove the fault, though the piece can't be
restored; so does a replacement character inside a word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import widen

#: Encodings that text is often read with by mistake, and encodings that were meant instead.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "cp1253", "cp1257", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "gbk", "big5", "shift_jis", "euc_kr")
MEANT = ("cp1251", "koi8_r", "cp866", "shift_jis", "gbk", "euc_jp", "euc_kr", "big5")
_MEANT_BY = {"cp1252": MEANT, "latin-1": MEANT, "mac_roman": MEANT[:5], "cp437": MEANT[:3], "cp850": MEANT[:3], "cp1251": MEANT[1:5], "koi8_r": ("cp1251", "cp866"), "cp866": ("cp1251", "koi8_r"), "cp1250": MEANT[:5]}
#: Fixed value: the letters that are rare in Russian text.
_SELDOM = frozenset("ъщэфцхю")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_NUMBERED = re.compile(r"&#(?:(\d{3,6})|[xX]([0-9a-fA-F]{2,5}));")
_BLANKED = re.compile(rb"([\xc2-\xdf]) ")
_HIGH = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile(r"(?<=\w)�|�(?=\w)")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, bytes]:
    """Of a single-byte encoding: the byte of each character; undefined bytes stand for the control of that number."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, bytes([b]))
    return out


def encode(text: str, encoding: str) -> bytes | None:
    if encoding in ("gbk", "big5", "shift_jis", "euc_kr"):
        if "¥" in text or "‾" in text:  # which some of these fold into ASCII
            return None
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _bytes_of(encoding)
    try:
        return b"".join([table[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> str:
    """Of a character beyond ASCII: its script if it is a letter, or what else it is."""
    cat = unicodedata.category(ch)
    if ch == "�":
        return "lost"
    if cat in ("Cc", "Cn", "Co", "Cs"):
        return "control"
    if cat[0] == "M":
        return "mark"
    if cat[0] == "L" and ch not in "ªº":
        name = unicodedata.name(ch, "")
        script = name.split(" ", 1)[0].split("-")[0]
        return "east" if script in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else "half" if script == "HALFWIDTH" else script
    return "sign"


@lru_cache(maxsize=1 << 16)
def _usual(ch: str) -> bool:
    """Whether an East Asian character is among those that text uses most: kana, syllables, the first level of GB 2312 or JIS."""
    if ch < "一" or ch > "鿿":
        return True
    for enc, low, high in (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF)):
        try:
            if low <= ch.encode(enc)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


def cost(text: str) -> float:
    """How garbled a text looks: signs, controls and foreign scripts inside words, heaped accents, rare ideographs."""
    total, before, run = 0.0, " ", 0
    prev = "space"
    for ch in text:
        if ch < "\x80":
            kind = "LATIN" if ch.isalpha() else "space" if ch.isspace() else "digit" if ch.isdigit() else "punct"
            if kind == "LATIN" and prev in ("CYRILLIC", "GREEK", "HEBREW", "ARABIC", "east", "half"):
                total += 1.0
            elif kind == "LATIN" and prev == "sign" and before not in "«‹“”‘’—–¿¡":
                total += 0.6
            run = 0
        else:
            kind = _kind(ch)
            total += 0.5
            if kind == "lost":
                total += 2.0
            elif kind == "control":
                total += 1.0
            elif kind == "half":
                total += 1.0
            elif kind == "sign":
                drawn = ch in "─═│║" or ch == before
                total += 0.5 if prev in (("LATIN", "CYRILLIC", "east") if drawn else ("LATIN", "sign", "CYRILLIC", "east")) and ch not in "’”»›…—–" else 0.0
            elif kind == "LATIN":
                if ch.isupper() and before.islower():
                    total += 1.0
                if prev not in ("LATIN", "space", "punct", "digit", "mark", "sign"):
                    total += 1.0
                run += 1
                if run > 2 and ch < "Ā":
                    total += 1.0
            elif kind == "east":
                if not _usual(ch):
                    total += 0.7
                if prev == "LATIN":
                    total += 1.0
            elif kind != "mark":
                if prev not in (kind, "space", "punct", "digit", "mark", "sign"):
                    total += 1.0
                if ch.isupper() and before.islower():
                    total += 1.0
                if kind == "CYRILLIC":
                    total += 0.5 if ch > "џ" or ch in "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐѕјЅ" else 0.25 if ch.lower() in _SELDOM else 0.0
                    if ch.isupper() and prev == "CYRILLIC":
                        total += 0.15
            if kind != "LATIN":
                run = 0
        prev, before = kind, ch
    return total


def _excess(text: str) -> float:
    """The cost without the part that any character beyond ASCII has."""
    return cost(text) - 0.5 * sum(c >= "\x80" for c in text)


def undo_layer(text: str, legacy: bool = True) -> tuple[str, bool] | None:
    """One layer of wrong decoding taken off: the text, and whether it is whole. None if no candidate lowers the cost.

    Text meant as UTF-8 comes first, since chance hardly decodes strictly; then UTF-8 of which bytes are gone;
    then text meant in another `legacy` encoding, which must lose most of its cost. A no-break space within a
    sequence counts also if it has become a blank.
    """
    now = cost(text)
    raws: dict[bytes, str] = {}
    for wrong in READ_AS:
        if (raw := encode(text, wrong)) is not None:
            raws.setdefault(raw, wrong)
    best: tuple[float, str] | None = None
    for raw in raws:
        try:
            out = _BLANKED.sub(lambda m: m[1] + b"\xa0", raw).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if (c := cost(out)) < now - 0.2 and (best is None or c < best[0]):
            best = (c, out)
    if best:
        return best[1], True
    for raw, wrong in raws.items():
        if wrong in ("gbk", "big5", "shift_jis", "euc_kr"):
            continue
        found, high = _SEQUENCE.findall(raw), sum(b >= 0x80 for b in raw)
        if found and sum(map(len, found)) >= 0.55 * high:
            out = _SEQUENCE.sub(lambda m: b"\x00" + m[0] + b"\x00", raw)
            out = b"".join(p if k % 2 else p.decode("latin-1").encode() for k, p in enumerate(out.split(b"\x00"))).decode("utf-8", "replace")
            if (c := cost(out)) < now - 0.9 and (best is None or c < best[0]):
                best = (c, out)
    if best:
        return best[1], False
    excess = _excess(text)
    if not legacy or excess < 1.5:
        return None
    for wrong, intended in _MEANT_BY.items():
        if (raw := encode(text, wrong)) is None:
            continue
        for meant in intended:
            if meant == wrong:
                continue
            try:
                out = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if (c := _excess(out)) < 0.45 * excess and (best is None or c < best[0]):
                best = (c, out)
    return (best[1], True) if best else None


def repair(text: str, legacy: bool = True) -> tuple[str, int, bool]:
    """A piece after all layers, however many: the text, how many were undone, and whether nothing was lost.

    Every layer lowers the cost, so there is an end.
    """
    whole, n = True, 0
    out = text
    while _HIGH.search(out) and (step := undo_layer(out, legacy)):
        out, n, whole = step[0], n + 1, whole and step[1]
        if not whole:
            break
    return (out if whole else text), n, whole and not _LOST.search(out)


def _character(m: re.Match) -> str:
    n = int(m[1]) if m[1] else int(m[2], 16)
    return chr(n) if 0x80 <= n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]


def repair_line(line: str) -> tuple[str, int, int]:
    """A line: its text with what could be restored, the garbled pieces in it, and those that were restored.

    Characters written as numbers (``&#233;``) are read as what they stand for, and written so again.
    """
    if "&#" in line and (plain := _NUMBERED.sub(_character, line)) != line:
        out, garbled, restored = repair_line(plain)
        return ("".join(c if c < "\x80" else f"&#{ord(c)};" for c in out) if garbled else line), garbled, restored
    if not _HIGH.search(line):
        return line, 0, 0
    core = line.lstrip("﻿")
    out, n, whole = repair(core)
    if n and whole:
        return line[: len(line) - len(core)] + out, 1, 1
    pieces, garbled, restored = [], 0, 0
    for word in re.split(r"(\s+)", line):
        fixed, k, ok = repair(word, legacy=False) if _HIGH.search(word) and not word.startswith("﻿") else (word, 0, True)
        lost = bool(_LOST.search(word))
        garbled += bool(k) or lost
        restored += bool(k) and ok and not lost
        pieces.append(fixed if ok else word)
    if not garbled and n:
        return line, 1, 0
    return "".join(pieces), garbled, restored


def repair_text(text: str | None) -> tuple[str | None, int, int]:
    """A text of any length, line by line."""
    if text is None or (text.isascii() and "&#" not in text):
        return text, 0, 0
    garbled = restored = 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not line.isascii() or "&#" in line:
            lines[i], g, r = repair_line(line)
            garbled, restored = garbled + g, restored + r
    return "\n".join(lines), garbled, restored


def repair_encoding(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text holds garbled pieces, with `repaired`, `garbled_pieces` and `restored_pieces`.

    A narrow step: rows of ASCII alone are passed over by the scan, and no row is moved for the work unless the
    input has fewer splits than there are cores. Null and empty texts give no row; line ends and byte order
    marks stay as they are; all other columns pass through, save those of the three names, which are replaced.
    """

    @F.pandas_udf("repaired string, garbled_pieces int, restored_pieces int")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([repair_text(t) for t in s], columns=["repaired", "garbled_pieces", "restored_pieces"])

    new = ("repaired", "garbled_pieces", "restored_pieces")
    rows = widen(df.where(F.col(text).rlike(r"[^\x00-\x7F]|&#[0-9xX]")))
    rows = rows.withColumn("__fix", fix(F.col(text)))
    return rows.where(F.col("__fix.garbled_pieces") > 0).select(*[c for c in df.columns if c not in new], *[F.col(f"__fix.{c}") for c in new])
