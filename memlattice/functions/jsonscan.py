"""JSON objects out of free text, and state that no built-in function can fold."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "---JSON---"


def objects(text: str) -> Iterator[str]:
    """Outermost {...} of a text; braces in quoted strings do not count, closing ones too many are passed over."""
    depth, begin, i, n, quoted = 0, 0, 0, len(text), False
    while i < n:
        c = text[i]
        if quoted:
            i += 1 if c == "\\" else 0
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[begin : i + 1]
        i += 1


def extract_object(text: str | None, required=(), optional=()) -> dict | None:
    """The object with all required fields and most optional ones, the last of equals; what follows the separator counts, if there is one."""
    if not text or not text.strip():
        return None
    rest = text.partition(SEPARATOR)[2] if SEPARATOR in text else text
    for fence in ("```json", "```JSON", "```"):
        rest = rest.replace(fence, "")
    best, score = None, -1
    for piece in objects(rest):
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        if all(k in found for k in required):
            s = sum(k in found for k in optional)
            if s >= score:
                best, score = found, s
    return best


def feedback_of(text: str | None) -> dict | None:
    """The object's feedback_data (read again if it is text), or the object."""
    found = extract_object(text)
    if found is None or "feedback_data" not in found:
        return found
    inner = found["feedback_data"]
    if isinstance(inner, str):
        try:
            return json.loads(inner)
        except ValueError:
            return None
    return inner


def extract_json(text: Column, required=(), optional=(), feedback: bool = False) -> Column:
    """``extract_object`` (or ``feedback_of``) of a column, as JSON text with sorted keys."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = [feedback_of(t) if feedback else extract_object(t, required, optional) for t in s]
        return pd.Series([None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in out])

    return run(text)


def within_budget(text: str | None, most: float, from_end: bool = False) -> str:
    """The longest start (or end) that costs at most ``most``: 0.3 an ASCII character, 0.6 any other, added one by one."""
    if most < 0:
        raise ValueError("a budget cannot be negative")
    used, n = 0.0, 0
    for c in reversed(text or "") if from_end else text or "":
        used += 0.3 if c < "\x80" else 0.6
        if used > most:
            break
        n += 1
    t = text or ""
    return (t[len(t) - n :] if from_end else t[:n]) if n else ""


def truncate_tokens(text: Column, most: float, from_end: bool = False) -> Column:
    """``within_budget`` of a column, in whole units of 0.3: a character costs one or two, so no more than the first (or last) units matter."""
    if most < 0:
        raise ValueError("a budget cannot be negative")
    units = int(most / 0.3 + 1e-9)
    if not units:
        return F.lit("")
    t = F.coalesce(text, F.lit(""))
    part = F.reverse(F.right(t, F.lit(units))) if from_end else F.substring(t, 1, units)
    # a character of one unit becomes a, one of two units bc: what is cut after so many units has as many characters as a and c
    costs = F.regexp_replace(F.regexp_replace(part, r"[\x00-\x7F]", "a"), r"[^\x00-\x7F]", "bc")
    n = F.char_length(F.replace(F.substring(costs, 1, units), F.lit("b"), F.lit("")))
    return F.right(t, n) if from_end else F.substring(t, F.lit(1), n)


def process_query(text: Column, rag: Column, names: list[str], most: float = 500) -> Column:
    """The query to search with: the RAG query, as it is up to 100 characters; else, without the names, the last ``most`` tokens."""
    from memlattice.functions.text import remove_names

    q = F.when(F.coalesce(rag, F.lit("")) != "", rag).otherwise(F.coalesce(text, F.lit("")))
    short = (F.coalesce(rag, F.lit("")) != "") & (F.char_length(rag) <= 100)
    return F.when(short, q).otherwise(truncate_tokens(remove_names(q, names), most, True))
