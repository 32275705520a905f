"""A small predicate language over signals, compiled to one Column.

``applies_if`` texts know AND, OR (also && and ||), parentheses, ``name``, ``name == literal``, and the short
forms always, true, never, false and empty. AND binds tighter than OR. Names are columns; comparison ignores
case and compares texts, where a missing value is the text "none".
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

_TOKEN = re.compile(r"""\s*(?:(?P<mark>\(|\)|==|&&|\|\|)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<word>[A-Za-z_][\w.]*))""")


class BadPredicate(ValueError):
    """The text is no predicate of the language."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise BadPredicate(f"unexpected {text[at:].strip()[:12]!r}")
        if m["mark"]:
            out.append(("op", {"&&": "and", "||": "or"}.get(m["mark"], m["mark"])))
        elif m["word"] is not None:
            low = m["word"].lower()
            out.append(("op", low) if low in ("and", "or") else ("name", m["word"]))
        else:
            out.append(("text", m["dq"] if m["dq"] is not None else m["sq"]))
        at = m.end()
    return out


def compile_predicate(text: str | None, schema: StructType) -> Column:
    """The predicate as a Column that is never null; a name that is no column is missing."""
    short = (text or "").strip().lower()
    if short in ("always", "true"):
        return F.lit(True)
    if short in ("never", "false", ""):
        return F.lit(False)
    tokens = _tokens(text)
    kinds = {f.name: f.dataType for f in schema.fields}

    def peek() -> tuple[str, str] | None:
        return tokens[0] if tokens else None

    def name_as_text(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("none"))) if name in kinds else F.lit("none")

    def truth(name: str) -> Column:
        if name.lower() in ("true", "false"):
            return F.lit(name.lower() == "true")
        if name not in kinds:
            return F.lit(False)
        c = F.col(name)
        held = c if isinstance(kinds[name], BooleanType) else c != 0 if isinstance(kinds[name], NumericType) else F.length(c.cast("string")) > 0
        return F.coalesce(held, F.lit(False))

    def either() -> Column:
        out = both()
        while peek() == ("op", "or"):
            tokens.pop(0)
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while peek() == ("op", "and"):
            tokens.pop(0)
            out = out & one()
        return out

    def one() -> Column:
        if not tokens:
            raise BadPredicate("the text ends too early")
        kind, value = tokens.pop(0)
        if (kind, value) == ("op", "("):
            out = either()
            if not tokens or tokens.pop(0) != ("op", ")"):
                raise BadPredicate("a parenthesis isn't closed")
            return out
        if kind != "name":
            raise BadPredicate(f"unexpected {value!r}")
        if peek() == ("op", "=="):
            tokens.pop(0)
            if not tokens or tokens[0][0] == "op":
                raise BadPredicate("a comparison lacks its literal")
            return name_as_text(value) == F.lit(tokens.pop(0)[1].lower())
        return truth(value)

    out = either()
    if tokens:
        raise BadPredicate(f"unexpected {tokens[0][1]!r}")
    return out


def activate(signals: DataFrame, rules: Mapping[str, str], key: str = "repo") -> DataFrame:
    """Per row of signals and module its verdict: (key, module_id, enabled, confidence).

    A module that always applies is 0.9 certain, one that depends on signals 0.65.
    """
    each = [
        F.struct(F.lit(m).alias("module_id"), compile_predicate(text, signals.schema).alias("enabled"), F.lit(0.9 if (text or "").strip().lower() in ("always", "true") else 0.65).alias("confidence"))
        for m, text in rules.items()
    ]
    return signals.select(key, F.explode(F.array(*each)).alias("m")).select(key, "m.*")
