"""Source files that nobody typed: generated, minified, dumped as data, or copied from third parties.

Every text gets a Re-Pair grammar over its tokens, and each kind is told by it. A grammar much smaller than its text,
one of whose rules is reused over most of it, gives away a generator. Long literals that no rule covers give away a
blob; numbers or escapes that the rules go over and over, a dump. Rules that close no borders with a blank, in long
lines or over names of one letter, give away minified code. The segments of the start rules, named by what they
expand to, are compared across owners: a text most of whose tokens lie in segments that other owners' texts hold too
is a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.repair_grammar import infer, segments, tokenize
from siltworks.session import stored, widen


@dataclass(frozen=True)
class Signs:
    """Thresholds; shares are of a text's tokens or bytes."""

    grammar_ratio: float = 0.42  # start rule and rules, of the tokens: at most this in generated text
    rule_reuse: float = 0.5  # tokens under one rule: at least this in generated text
    clear_reuse: float = 0.6  # from this reuse on the grammar may be larger, as in short texts
    clear_ratio: float = 0.6
    least_tokens: int = 100
    number_share: float = 0.3  # tokens that are numbers within rules
    literal_share: float = 0.5  # bytes in ASCII words of 24 and more that no rule covers
    escape_share: float = 0.3  # bytes in escapes, where a rule has at least `escape_reuse` of the tokens
    escape_reuse: float = 0.3
    least_literal_bytes: int = 600
    apart_share: float = 0.12  # borders closed by rules that had a blank: less than this in minified text
    letter_share: float = 0.5  # words of one letter, or
    line_bytes: float = 100.0  # bytes of a mean line
    shared_share: float = 0.55  # tokens in segments of at least two owners
    least_segment: int = 8  # tokens of a segment that counts for that


_KEY_BLOCK = re.compile(rb"-----BEGIN [^\n]*?-----.*?-----END [^\n-]*-----", re.S)
_NUMBERED = re.compile(rb"&#[xX]?[0-9a-fA-F]{2,6};")
_FEATURES = "tokens bigint, grammar_ratio double, rule_reuse double, apart_share double, number_share double, literal_share double, escape_share double, letter_share double, line_bytes double, bytes bigint"
_OUT = "file_id bigint, owner bigint, " + _FEATURES + ", rules array<bigint>, held array<int>"


def features(texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each text the shares that tell, and the segments of its start rule with the tokens that each holds."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = [_KEY_BLOCK.sub(b"", r) if b"-----BEGIN" in r else r for r in raw]
    raw = [_NUMBERED.sub(b"e", r) if b"&#" in r else r for r in raw]
    k, tok = len(raw), tokenize(raw)
    g = infer(tok.text, tok.hash, k, tok.apart)
    ascii_word = tok.word & (np.add.reduceat((tok.data >= 0x80).astype(np.int32), tok.begin) == 0 if len(tok.begin) else tok.word)
    per = lambda w: np.bincount(tok.text, w, minlength=k)
    n, words, held_bytes = np.bincount(tok.text, minlength=k), per(tok.word & ~tok.number), np.maximum(per(tok.size), 1)
    size, many = np.array([len(r) for r in raw]), np.maximum(n, 1)
    out = {
        "tokens": n, "grammar_ratio": (g.start + 2 * g.rules) / many, "rule_reuse": g.reuse, "apart_share": g.apart,
        "number_share": per(tok.number & g.covered) / many, "literal_share": per(tok.size * (ascii_word & (tok.size >= 24) & ~g.covered)) / held_bytes,
        "escape_share": np.array([r.count(b"\\x") for r in raw]) * 4 / np.maximum(size, 1), "letter_share": per(tok.word & ~tok.number & (tok.size == 1)) / np.maximum(words, 1),
        "line_bytes": size / np.array([r.count(b"\n") + 1 for r in raw]), "bytes": size,
    }
    t, s, w = segments(g)
    cuts = np.searchsorted(t, np.arange(1, k))
    return out, np.split(s.view(np.int64), cuts), np.split(w.astype(np.int32), cuts)


def _slices(batch: pa.RecordBatch, rows: int = 512, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and, unless a single text is longer, bytes of text."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(2)).to_pylist()]
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin == rows or held + n > most_bytes):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def file_features(files: DataFrame) -> DataFrame:
    """The features and segments of files (file_id, repo, content); one pass, no shuffle."""
    names = [c.split()[0] for c in _FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _slices(big):
                ids, owners, texts = (c.to_pylist() for c in batch.columns)
                f, rules, held = features(texts)
                kinds = [pa.int64(), *[pa.float64()] * 8, pa.int64()]
                columns = [pa.array(ids, pa.int64()), pa.array(owners, pa.int64())]
                columns += [pa.array(f[c], k) for c, k in zip(names, kinds, strict=True)]
                columns += [pa.array(rules, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file_id", "owner", *names, "rules", "held"])

    rows = widen(files.select("file_id", F.xxhash64(F.coalesce("repo", F.lit(""))).alias("owner"), "content"))
    return rows.mapInArrow(read, _OUT)


#: parts that the files of one segment are dealt into, so that a licence header of most files isn't one task's
SALTS = 8


def not_typed(files: DataFrame, signs: Signs = Signs()) -> DataFrame:
    """The files that nobody typed: file_id and `kinds`, an array of generated, minified, data and copied.

    Null and empty contents are no cases; a null repo is an owner of its own. The segments of all files are compared
    with those of all others; one that any number of files hold is counted in partial sums, so none is compared pair
    by pair.
    """
    seen, s, c = stored(file_features(files), "grammars"), signs, F.col
    held = seen.select("file_id", "owner", F.explode(F.arrays_zip("rules", "held")).alias("r")).select("file_id", "owner", c("r.rules").alias("rule"), c("r.held").alias("held"))
    held = held.where(c("held") >= s.least_segment).withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)))
    shared = held.groupBy("rule").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where(c("low") != c("high"))
    shared = shared.select("rule", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    copied = held.join(shared, ["rule", "salt"], "left_semi").groupBy("file_id").agg(F.sum("held").alias("shared_tokens"))
    enough, some = c("tokens") >= s.least_tokens, c("tokens") >= 40
    kind = {
        "generated": enough & (((c("grammar_ratio") <= s.grammar_ratio) & (c("rule_reuse") >= s.rule_reuse)) | ((c("grammar_ratio") <= s.clear_ratio) & (c("rule_reuse") >= s.clear_reuse))),
        "minified": some & (c("apart_share") < s.apart_share) & ((enough & (c("letter_share") >= s.letter_share)) | (c("line_bytes") >= s.line_bytes)),
        "data": (c("bytes") >= s.least_literal_bytes)
        & ((c("number_share") >= s.number_share) | (c("literal_share") >= s.literal_share) | ((c("escape_share") >= s.escape_share) & (c("rule_reuse") >= s.escape_reuse))),
        "copied": some & (F.coalesce(c("shared_tokens"), F.lit(0)) >= s.shared_share * c("tokens")),
    }
    rows = seen.drop("rules", "held").join(copied, "file_id", "left")
    return rows.select("file_id", F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in kind.items()])).alias("kinds")).where(F.size("kinds") > 0)
