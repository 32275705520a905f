"""Credentials embedded in code, configuration and questions: found, and redacted in place.

Literals that stand where a credential would stand are indexed, stand-ins among them, and every text is scanned for
all of them with an automaton of those that its own bytes can hold; so the index knows of each literal all its places
and owners, whatever stands around it. A literal that a share of all owners hold is a placeholder, unless it has the
form of a token that a service issues; a rare one that has a credential's form is confirmed, and all its places count.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import stored, widen

#: The forms of tokens that services issue.
STRUCTURED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{40,}"
    r"|glpat-[0-9A-Za-z_\-]{20,}"
    r"|xox[abeoprs]-[0-9A-Za-z\-]{20,}"
    r"|[sr]k_live_[0-9A-Za-z]{16,}"
    r"|npm_[0-9A-Za-z]{36}"
    r"|pypi-[0-9A-Za-z_\-]{40,}"
    r"|AIza[0-9A-Za-z_\-]{35}"
    r"|SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}"
    r"|eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}"
    r")"
)
#: Words that stand for a missing value.
_STAND_IN = re.compile(
    r"your|change|replace|example|placeholder|dummy|sample|insert|redact|mask|todo|fixme|foobar|not[-_ ]?set|undefined|none$|null$|true$|false$|(?-i:x{4,}|X{4,})|\*{3,}|\.{3,}|…|•{3,}|0{8,}|12345678|abcdefgh|hunter2|password1?$|secret$",
    re.I,
)
#: Forms that refer to a secret kept elsewhere, and forms that name one.
_REFERENCE = re.compile(r"[$%#]\{|\{\{|\}\}|^\$\w+$|^\$\(|^%\w+%$|^env:|^vault:|^ssm:|^arn:|^file:|^keyring|environ|getenv|process\.env|secrets?\.|^@|\bvault\b")
_NAME_ONLY = re.compile(r"^<.*>$|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^\[.*\]$")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\{\d+(?:,\d*)?\}|\(\w+(?:\|\w+)+\)|\\[dws]|\.\*|\.\+")
_SECRET_NAME = re.compile(
    r"(?:password|passwd|pwd|passphrase|passwort|secret|token|credentials?|(?:^|[_\-.])(?:pass|pw|auth)|[a-z]Pass"
    r"|(?:api|deploy|private|tls|ssl|sa|encrypt(?:ion)?|secret|access|sign(?:ing)?|auth|ssh|service|account|master|client|license|hmac|session|x)[_\-.]?key)$",
    re.I,
)
_NOT_SECRET = re.compile(r"(?:public|csrf|next|page|cache|primary|foreign|sort)[_\-.]?(?:key|token)$", re.I)
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s:/@'\"`<>]*):([^\s/@'\"`<>]+)@[\w.\-\[{$<]")
_CONN = re.compile(r"(?:^|[;\"'`\s(])(?:pwd|password)\s*=\s*([^;\"'`\s]+)\s*(?=;)", re.I)
_AUTH = re.compile(r"\b(basic|bearer|token)\s+([A-Za-z0-9+/=_\-.~]{8,})", re.I)
_PARAM = re.compile(r"[?&](?:access_token|auth_token|token|api[_-]?key|apikey|key|sig|signature|secret|client_secret|password|passwd|pwd)=([^&\s\"'`<>#)]{8,})", re.I)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_NAMED = re.compile(
    r"""([A-Za-z_][\w.\-]*)["'`\])]{0,2}\s*(?:=>|:=|[:=,]|\bto\b|\bwas\b|\|)\s*(?:"((?:[^"\\\n]|\\.){4,})"|'((?:[^'\\\n]|\\.){4,})'|`([^`\n]{4,})`|([^\s"'`,;|<>()\[\]{}]{6,}))"""
)
_MORE = re.compile(r"""\s*(?:\+|\.)?\s*["']([^"'\n]{4,})["']""")
_XML = re.compile(r"<([A-Za-z_][\w.\-]*)>\s*([^<>\s]{6,})\s*</")
_ATTR = re.compile(r"""(?:key|name)\s*=\s*["']([\w.\-]+)["']\s+value\s*=\s*["']([^"']{6,})["']""", re.I)
_SQL = re.compile(r"""\(\s*'([\w.\-]+)'\s*,\s*'([^']{6,})'\s*\)""")
_DEFINE = re.compile(r"""#\s*define\s+(\w+)\s+["']?([^"'\s]{6,})""")
_CALLED = re.compile(
    r"""\bidentified\s+by\s+'([^']{6,})'|\bpassword\s+'([^']{6,})'|\b(?:sshpass|mysql\w*|htpasswd)\b[^\n]*?\s-p\s*['"]?([^\s'"]{6,})"""
    r"""|\bauth\w*\s*=\s*\(\s*["'][^"']+["']\s*,\s*["']([^"']{6,})["']|--(?:password|token|secret|api-key)[= ]["']?([^\s"']{6,})|\bcurl\b[^\n]*?\s(?:-u|--user)\s+["']?[^\s:"']+:([^\s"']{6,})"""
    r"""|\b(?:login|BasicAuth\w*|authenticate|HTTPBasicAuth)\(\s*["'][^"']+["']\s*,\s*["']([^"']{6,})["']""",
    re.I,
)
_VALUE = re.compile(r"@Value\(\s*\"\$\{([\w.\-]+):([^\"]{4,})\}\"")
_SAID = re.compile(r"\b(?:credentials?|token|key|password|passphrase|secret)\b:?\s+(?:is\s+|of\s+)?([A-Za-z0-9+/=_\-.!@#$%^&*~]{12,})(?=[\s?,;)]|$)", re.I)
_SIGN = re.compile(r"\b(?:user|login|account)\s+[`'\"]?[\w.@\-]+[`'\"]?\s+(?:and|with)\s+[`'\"]([^`'\"\s]{6,})[`'\"]", re.I)
_USER = re.compile(r"\b(?:user|login|account)\s+[\w.@\-]+,?\s+(?:and\s+|with\s+)?password\s+([^\s,)]{6,}?)(?=[\s,;)?]|$)", re.I)
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", re.I)


def usable(value: str, name: str = "") -> bool:
    """Whether a value can be a credential: neither a stand-in nor what `credible` leaves out."""
    return credible(value, name) and genuine(value)


def genuine(value: str) -> bool:
    """No stand-in, as far as the value itself tells: no filler, name or plain word."""
    v = value.strip()
    return len(set(v)) >= 4 and not _STAND_IN.search(v) and not _NAME_ONLY.search(v) and bool(re.search(r"\d|[^\w\-]", v) or _jumbled(v) or re.match(r"(?:AKIA|ASIA|AIza)[A-Z]{4,}$", v))


def credible(value: str, name: str = "") -> bool:
    """Whether a value can be a credential or a stand-in for one: no reference, pattern, path, number, phrase or word in lower case."""
    v = value.strip()
    if len(v) < 6 or " " in v or not re.search(r"\w", v) or re.fullmatch(r"[\d.,]+", v):
        return False
    if _REFERENCE.search(v) or _PATTERN.search(v):
        return False
    if "://" in v or v.startswith(("sha256:", "sha512", "sha1:", "md5:")) or re.fullmatch(r"[./~]*[\w\-]+(?:\.\w+)?(?:/[a-z_\-.]+)+/?|[./~]*/[a-z_\-]+(?:\.[a-z]+)?", v):
        return False
    if re.fullmatch(r"\w+(?:\.\w+)+", v) and v.split(".")[0].lower() in ("os", "self", "this", "config", "settings", "process", "env", "ctx", "app"):
        return False
    if re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*\(.*", v) or re.fullmatch(r"[A-Za-z_][a-z_]*(?:\.[a-z_]+)+;?", v):
        return False
    if name and re.sub(r"\W|_", "", v).lower() == re.sub(r"\W|_", "", name).lower():
        return False
    return bool(re.search(r"\d|[^\w\-]", v)) or _jumbled(v) or v == v.upper() or len(set(v)) < 4


def _jumbled(v: str) -> bool:
    """Letters whose case changes as in no words joined together: pieces of hardly three letters."""
    pieces = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", v)
    return len(v) >= 8 and v.lower() != v != v.upper() and len(pieces) >= 3 and len(v) / len(pieces) < 3.2


def _mixed(v: str) -> bool:
    """Letters of both cases, but no capitalised word."""
    return v.lower() != v != v.upper() and not re.fullmatch(r"[A-Z]?[a-z]+", v)


def login(encoded: str) -> str | None:
    """The password of an encoded login, if it is one."""
    try:
        plain = base64.b64decode(encoded + "=" * (-len(encoded) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    user, colon, password = plain.partition(":")
    return password if colon and user and plain.isprintable() else None


Found = tuple[int, int, str, str, bool]


def literals_in_line(line: str) -> list[Found]:
    """The literals of a line that stand where a credential would: (begin, end, form, literal, whether it is no stand-in)."""
    out: list[Found] = []

    def take(m: re.Match, group: int, form: str, real: bool) -> None:
        out.append((m.start(group), m.end(group), form, m[group], real))

    for m in STRUCTURED.finditer(line):
        take(m, 0, "token", not re.search(r"(\w)\1{5}|XXXX|EXAMPLE|example|\.\.\.", m[0]))
    for m in _URL.finditer(line):
        if credible(m[2]) or (len(m[2]) >= 8 and _mixed(m[2]) and not _REFERENCE.search(m[2])):
            take(m, 2, "login", (genuine(m[2]) and credible(m[2])) or (len(m[2]) >= 8 and _mixed(m[2]) and not _STAND_IN.search(m[2])))
    for m in _CALLED.finditer(line):
        g = m.lastindex
        if credible(m[g]):
            take(m, g, "login", genuine(m[g]))
    for m in _PARAM.finditer(line):
        if credible(m[1]):
            take(m, 1, "parameter", genuine(m[1]))
    for m in _AUTH.finditer(line):
        kind = m[1].lower()
        if kind == "basic":
            password = login(m[2])
            if password and not _REFERENCE.search(password):
                take(m, 2, "login", not _STAND_IN.search(password))
        elif kind == "bearer" and len(m[2]) >= 16 and credible(m[2]) and re.search(r"\d", m[2]):
            take(m, 2, "bearer", genuine(m[2]))
    if re.search(r"(?:server|host|data source|uid|user id)\s*=", line, re.I):
        for m in _CONN.finditer(line):
            if credible(m[1]):
                take(m, 1, "login", genuine(m[1]))
    for rx in (_USER, _SIGN):
        for m in rx.finditer(line):
            if credible(m[1]):
                take(m, 1, "login", genuine(m[1]))
    for rx in (_VALUE, _ATTR, _SQL, _XML, _DEFINE):
        for m in rx.finditer(line):
            if _is_secret(m[1]) and credible(m[2], m[1]):
                take(m, 2, "named", genuine(m[2]))
    for m in _NAMED.finditer(line):
        if not _is_secret(m[1]):
            continue
        g = next(i for i in (2, 3, 4, 5) if m[i] is not None)
        more = _MORE.match(line, m.end()) if g != 5 else None  # a literal in two parts
        whole = m[g] + more[1] if more else m[g]
        if credible(whole, m[1]) and not (g == 5 and re.fullmatch(r"[a-z_]+", m[g])) and not _BEGIN.search(m[g]):
            take(m, g, "named", genuine(whole))
            if more:
                take(more, 1, "named", genuine(whole))
    for m in _SAID.finditer(line):
        if credible(m[1]) and (STRUCTURED.match(m[1]) or _HEX.match(m[1]) or (re.search(r"\d", m[1]) and re.search(r"[A-Z]", m[1]) and len(m[1]) >= 16)):
            take(m, 1, "said", genuine(m[1]))
    return out


def _is_secret(name: str) -> bool:
    return bool(_SECRET_NAME.search(name)) and not _NOT_SECRET.search(name)


#: Lower-case words, one of which every line holds that a pattern of literals_in_line can match.
_WORDS = (
    "pass", "pw", "secret", "token", "key", "auth", "cred", "bearer", "basic", "identified", "login", "user", "account", "mysql", "curl", "://", "sig=", "signature=",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat", "xox", "k_live_", "npm_", "pypi-", "aiza", "sg.", "eyj", "-----begin",
)
#: What must stand around a word for the line to be looked at; the other words suffice alone.
_AROUND = {
    "token": r"token(?!_?count)", "key": r"key(?!=lambda[\s:])", "://": r"://[^\s/]*:[^\s/]*@", "sig=": r"[?&]sig=", "signature=": r"[?&]signature=", "account": r"\baccount\s", "curl": r"\bcurl\b", "mysql": r"\bmysql",
    "akia": r"(?-i:AKIA)", "asia": r"(?-i:ASIA)", "aiza": r"(?-i:AIza)", "sg.": r"(?-i:SG\.)", "eyj": r"(?-i:eyJ)", "-----begin": r"(?-i:-----BEGIN)",
}
_HINT = re.compile("|".join(_AROUND.get(w, re.escape(w)) for w in _WORDS), re.I)
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_BODY_ON = re.compile(r"""(?:(?:[\s"'+,;]|\\[nr])*[A-Za-z0-9+/=]{16,})*""")


@lru_cache(maxsize=1)
def _words() -> ahocorasick.Automaton:
    return automaton(_WORDS)


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """In lower case, every character at its place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def hinted_lines(text: str) -> Iterator[tuple[int, int, str]]:
    """The lines that hold a telling word: (number from 1, begin, line)."""
    done = number = start = 0
    for end, word in _words().iter(_lower(text)):
        if end < done or (word == "token" and text[end + 1 : end + 7].lower() in ("_count", "count", "counts")):
            continue
        begin = text.rfind("\n", 0, end) + 1
        number += text.count("\n", start, begin)
        start = begin
        done = text.find("\n", end)
        done = len(text) if done < 0 else done
        line = text[begin:done]
        if _HINT.search(line):
            yield number + 1, begin, line


def candidates(text: str | None) -> Iterator[tuple[int, int, int, str, str, bool]]:
    """Of a text: (line from 1, begin, end, form, literal, whether it is no stand-in), one per place; places may overlap where forms do."""
    for n, at, line in hinted_lines(text or ""):
        seen: dict = {}
        for b, e, form, lit, real in literals_in_line(line):
            if (b, e) not in seen or (real and not seen[b, e][2]):
                seen[b, e] = (form, lit, real)
        for (b, e), (form, lit, real) in seen.items():
            yield n, at + b, at + e, form, lit, real
        for m in _BEGIN.finditer(line):
            begin = at + m.start()
            end = text.find("-----END", begin)
            stop = text.find("-----", end + 8) + 5 if end >= 0 else -1
            stop = stop if stop >= 5 else at + len(line)
            body = text[at + m.end() : end if end >= 0 else stop]
            if len("".join(_KEY_BODY.findall(body))) >= 48:
                yield n, begin, stop, "key", text[begin:stop], not re.search(r"x{8,}|\.{3}|<[a-z]", body, re.I)


def literals(text: str | None) -> Iterator[tuple[int, int, int, str, str]]:
    """The candidates that are no stand-ins."""
    return (c[:5] for c in candidates(text) if c[5])


RUN = re.compile(r"[A-Za-z0-9_\-]+")
#: Bytes of a literal by which its other places are looked for; no literal is shorter.
GRAM = 6
_GRAM_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_TELLING = np.full(256, 1, dtype=np.int64)
_TELLING[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
_TELLING[[ord(c) for c in "0123456789"]] = 2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of UTF-8 bytes: the hash (in 62 bits) of the GRAM bytes that begin at each place."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    wide, h = data.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(GRAM):
        h += wide[k : k + n] * _GRAM_FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= _GRAM_FACTORS[0]
    return (h ^ (h >> np.uint64(29))) >> np.uint64(2)


def needle_of(form: str, literal: str) -> str:
    """What is looked for: the literal itself; of a key block, the first run of its body, since bodies are copied bare."""
    if form != "key":
        return literal
    body = _BEGIN.sub("", literal).split("-----END")[0]
    return next(iter(_KEY_BODY.findall(body)), literal)


def gram_of(needle: str) -> int:
    """The hash of the literal's most telling bytes."""
    data = np.frombuffer(needle.encode("utf-8", "surrogatepass"), np.uint8)
    hashes = gram_hashes(data)
    worth = np.convolve(_TELLING[data], np.ones(GRAM, np.int64), "valid")
    return int(hashes[worth.argmax()])


_PLACE = "src string, rec_id bigint, owner string, line_no bigint, begin bigint, end bigint, form string, literal string, real boolean, needle string, hash bigint"
_TEXT = "src string, rec_id bigint, owner string, text string, hashes array<bigint>"
_FOUND = "src string, rec_id bigint, owner string, line_no bigint, begin bigint, end bigint, needle string"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def literal_index(texts: DataFrame) -> DataFrame:
    """Every literal that stands where a credential would, with its place; a narrow step over (src, rec_id, owner, text)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, rec, owner, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, b, e, form, lit, real in candidates(text):
                    if len(needle := needle_of(form, lit)) >= GRAM:
                        rows.append((src, rec, owner, n, b, e, form, lit, real, needle, gram_of(needle)))
                    else:  # part of a literal in two parts
                        rows.append((src, rec, owner, n, b, e, form, lit, real, needle, None))
            yield _rows(rows, _PLACE)

    return texts.select("src", "rec_id", "owner", "text").mapInArrow(extract, _PLACE)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _marks(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A set of bits with two for each hash; its size follows their number up to `most_bits`, so it is bounded."""
    n, bits = hashes.count(), 1 << 20
    while bits < 64 * n and bits < most_bits:
        bits *= 2
    spots = hashes.select(F.explode(F.array(F.col("hash"), F.shiftright("hash", 31))).alias("h"))
    spot = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    marks = np.zeros(bits // 8, dtype=np.uint8)
    for row in spots.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).toLocalIterator():
        part = np.frombuffer(row["m"], np.uint8)
        at = (row["b"] - 1) * 4096
        marks[at : at + len(part)] = part[: len(marks) - at]
    return marks


def rescan(texts: DataFrame, index: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """All places of the indexed literals in all texts, whatever stands around them, by the needle found there.

    A set of bits (32 MB at most) marks the literals' most telling bytes; if there are more literals than it can
    keep apart, more texts pass, none is lost. Each text that holds marked bytes is kept once, joined to the literals
    that these can belong to, and scanned as a whole by an Aho-Corasick automaton of its batch's literals.
    """
    spark = texts.sparkSession
    wanted = index.where(F.col("hash").isNotNull()).select("hash", "needle", (F.col("form") == "key").alias("body")).distinct()
    marks = _marks(wanted.select("hash").distinct(), most_bits)
    shared, mask = spark.sparkContext.broadcast(marks), np.uint64(8 * len(marks) - 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            rows = []
            for src, rec, owner, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    data, hit = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), []
                    for at in range(0, len(data), 1 << 15):  # parts that fit a processor's cache, overlapping
                        h = gram_hashes(data[at : at + (1 << 15) + GRAM - 1])
                        for shift in (0, 31):
                            spot = (h >> np.uint64(shift)) & mask
                            h = h[((marked[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                        hit.append(h)
                    if len(found := np.unique(np.concatenate(hit))):
                        rows.append((src, rec, owner, text, found.astype(np.int64)))
            yield _rows(rows, _TEXT)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if at:
                needles, bodies = automaton({x["needle"] for r in at for x in r[4]}), {x["needle"] for r in at for x in r[4] if x["body"]}
                for src, rec, owner, text, _ in at:
                    line = start = done = 0
                    for end, x in needles.iter(text):
                        b = end - len(x) + 1
                        if x in bodies:
                            if b < done:  # within a body found already
                                continue
                            done = end = _BODY_ON.match(text, end + 1).end()
                            end -= 1
                        elif (RUN.match(text[b - 1 : b]) and RUN.match(x[0])) or (RUN.match(text[end + 1 : end + 2]) and RUN.match(x[-1])):
                            continue  # a piece of a longer word
                        if b >= start:
                            line, start = line + text.count("\n", start, b), b
                        rows.append((src, rec, owner, 1 + (line if b == start else text.count("\n", 0, b)), b, end + 1, x))
            yield _rows(rows, _FOUND)

    held = stored(texts.select("src", "rec_id", "owner", "text").mapInArrow(probe, _TEXT), "marked")
    own = held.select("src", "rec_id", F.explode("hashes").alias("hash")).distinct().join(wanted, "hash")
    own = own.groupBy("src", "rec_id").agg(F.collect_set(F.struct("needle", "body")).alias("needles"))
    scanned = held.join(own, ["src", "rec_id"]).select("src", "rec_id", "owner", "text", "needles")
    return scanned.mapInArrow(find, _FOUND).distinct()


@dataclass(frozen=True)
class Rule:
    """When a literal is a placeholder: more than `least_owners` owners hold it, and more than this share of all owners.

    Tokens of a form that services issue aren't suppressed however many forks copy them.
    """

    owner_share: float = 0.01
    least_owners: int = 4


def examine(texts: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """All places of all indexed literals, and what is known of each literal.

    Places have src, rec_id, owner, line_no, begin, end, literal, and `told`: whether the place itself tells of a
    credential, or it was only found by the scan for literals. Literals have form, owners, places, and whether they
    are `shared` by too many owners, and whether they are `confirmed`.
    """
    texts = widen(texts)
    index = stored(literal_index(texts), "literals")
    by_needle = index.groupBy("needle").agg(F.min("literal").alias("literal"))
    found = rescan(texts, index).join(by_needle, "needle").select("src", "rec_id", "owner", "line_no", "begin", "end", "literal")
    told = index.join(by_needle, "needle").select("src", "rec_id", "owner", "line_no", "begin", "end", by_needle["literal"])
    places = told.withColumn("told", F.lit(True)).unionByName(found.withColumn("told", F.lit(False)))
    places = places.groupBy("src", "rec_id", "owner", "line_no", "begin", "end", "literal").agg(F.max("told").alias("told"))
    # a key's bare body within a key block is part of that block
    blocks = index.where(F.col("form") == "key").groupBy("src", "rec_id").agg(F.collect_set(F.struct("begin", "end")).alias("blocks"))
    inside = F.exists("blocks", lambda x: (x["begin"] <= F.col("begin")) & (F.col("end") <= x["end"]))
    places = places.join(blocks, ["src", "rec_id"], "left").where(F.col("told") | F.col("blocks").isNull() | ~inside).drop("blocks")
    places = stored(places, "places")
    owners = texts.select(F.coalesce("owner", F.lit("")).alias("o")).distinct().count()
    form = index.join(by_needle, "needle").groupBy(by_needle["literal"]).agg(F.min("form").alias("form"), F.max("real").alias("real"), F.max(F.col("form").isin("token", "key")).alias("issued"))
    seen = places.groupBy("literal").agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("owners"), F.count("*").alias("places"))
    known = form.join(seen, "literal").withColumn("shared", ~F.col("issued") & (F.col("owners") > max(rule.least_owners, rule.owner_share * owners)))
    return places, known.withColumn("confirmed", F.col("real") & ~F.col("shared"))


def find_credentials(texts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Every place of a usable credential: src, rec_id, line_no, begin, end (characters from 0), literal.

    `texts` has src, rec_id, owner and text. Null and empty texts hold none; a null owner is an owner of its own;
    repeated rows give the same places once. Places may overlap where one literal lies within another.
    """
    places, known = examine(texts, rule)
    return places.join(known.where("confirmed").select("literal"), "literal", "left_semi").select("src", "rec_id", "line_no", "begin", "end", "literal").distinct()


def step_report(texts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """How many literals and places there are by what became of them, and of the places how many only the scan found."""
    places, known = examine(texts, rule)
    step = F.when(F.col("shared"), "shared by owners").when(~F.col("real"), "stand-in by form").otherwise("confirmed")
    return places.join(known, "literal").groupBy(step.alias("step")).agg(F.count_distinct("literal").alias("literals"), F.count("*").alias("places"), F.count_if(~F.col("told")).alias("scan_only"))


def redact(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that hold a credential, with every character of it but blanks and line ends turned into x.

    Lengths, lines and quotes stay as they are, so the code or sentence around a place stays valid.
    """

    @F.pandas_udf("string")
    def blank(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_blank(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    spans = places.groupBy("src", "rec_id").agg(F.collect_set(F.array("begin", "end")).alias("spans"))
    return texts.join(spans, ["src", "rec_id"]).select("src", "rec_id", blank(F.col("text"), F.col("spans")).alias("redacted"), F.size("spans").alias("places"))


def _blank(text: str, spans: Iterable[Iterable[int]]) -> str:
    out = list(text)
    for b, e in spans:
        for i in range(b, min(e, len(out))):
            if not out[i].isspace():
                out[i] = "x"
    return "".join(out)
