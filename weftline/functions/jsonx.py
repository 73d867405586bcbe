"""JSON, YAML front matter and XML in text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import _C, col


def probe(x: _C, *paths: str) -> Column:
    """JSN-03: the first path that holds something; malformed text gives null."""
    return F.coalesce(*[F.get_json_object(col(x), p) for p in paths])


def or_raw(x: _C, path: str) -> Column:
    """JSN-03: the property, or the raw text where it is no JSON or lacks it."""
    return F.coalesce(F.get_json_object(col(x), path), col(x))


def block(x: _C) -> Column:
    """JSN-04: the last json fence, else the last other fence, else first brace to last brace, else null."""
    fence = F.regexp_extract_all(col(x), F.lit(r"(?s)```json\s*\n(.*?)```"), 1)
    other = F.regexp_extract_all(col(x), F.lit(r"(?s)```[a-z]*\s*\n(.*?)```"), 1)
    braces = F.regexp_extract(col(x), r"(?s)(\{.*\})", 1)
    return F.trim(F.coalesce(F.try_element_at(fence, F.lit(-1)), F.try_element_at(other, F.lit(-1)), F.nullif(braces, F.lit(""))), F.lit(" \n\t\r"))


#: A string, to its end or that of the text, or a mark of structure.
_JSON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\],]', re.DOTALL)
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def repair(text: str | None) -> str | None:
    """JSN-05: JSON that was cut off or closed wrongly, made valid; null if nothing can be saved.

    One scan keeps the stack of open brackets and the last place at which a value had ended. Wrong closers are replaced,
    missing ones added; if that does not parse, the text is cut back to earlier and earlier such places.
    """
    if text is None or not text.strip():
        return None
    stack: list[str] = []
    out: list[str] = []
    ends: list[tuple[int, str]] = []
    n, at, text = 0, 0, text.strip()
    tail = ""

    def closers() -> str:
        return "".join(reversed(stack))

    for m in _JSON_MARKS.finditer(text):
        out.append(text[at : m.start()])
        n += m.start() - at
        at, c = m.end(), m[0]
        if c in "}]":
            if not stack:
                continue
            c = stack.pop()
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c == ",":
            ends.append((n, closers()))
        elif not _JSON_STRING.fullmatch(c):
            tail = '\\"' if (len(c) - len(c.rstrip("\\"))) % 2 else '"'
        out.append(c)
        n += len(c)
        if c in "}]" or c[0] == '"' and not tail:
            ends.append((n, closers()))
        if c in "}]" and not stack:
            at = len(text)
            break
    out.append(text[at:])
    whole = "".join(out) + tail
    for candidate in (whole + closers(), *(whole[:k] + rest for k, rest in reversed(ends[-200:]))):
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            continue
    return None


def repaired(x: _C) -> Column:
    """JSN-05 as a column: the scan of nested brackets is no regular expression, so it runs over Arrow batches, and finds nothing to do in valid rows."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(repair, na_action="ignore")

    valid = F.try_parse_json(col(x)).isNotNull()
    return F.when(valid, col(x)).otherwise(run(F.when(~valid, col(x))))


def front_matter_value(x: _C, key: str) -> Column:
    """JSN-08: a scalar of the YAML front matter, without quotes."""
    head = F.regexp_extract(col(x), r"(?s)^---\s*\n(.*?)\n---", 1)
    return F.nullif(F.btrim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.+)$", 1), F.lit(" \"'")), F.lit(""))


def front_matter_list(x: _C, key: str) -> Column:
    """JSN-08: a list of the YAML front matter, one item a line or in brackets."""
    head = F.regexp_extract(col(x), r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.regexp_extract(F.concat(head, F.lit("\n")), rf"(?m)^{key}:[ \t]*\n((?:[ \t]+-[^\n]*\n)+)", 1)
    inline = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    strip = lambda v: F.btrim(v, F.lit(" \"'"))
    return F.when(lines != "", F.transform(F.regexp_extract_all(lines, F.lit(r"-[ \t]*([^\n]+)"), 1), strip)).otherwise(F.filter(F.transform(F.split(inline, ","), strip), lambda v: v != ""))


def title_of(x: _C) -> Column:
    """JSN-08: the title of the front matter, else the first heading of level 1."""
    return F.coalesce(front_matter_value(x, "title"), F.nullif(F.trim(F.regexp_extract(col(x), r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")))


def sanitize_xml(x: _C) -> Column:
    """XML-03: fences and text outside the outermost tags go, bare ampersands are escaped."""
    inner = F.regexp_extract(F.regexp_replace(col(x), r"```(?:xml)?", ""), r"(?s)(<.*>)", 1)
    return F.regexp_replace(inner, r"&(?!(?:amp|lt|gt|quot|apos|#\d+);)", "&amp;")


def xml_pages(x: _C) -> Column:
    """XML-01: titles of the pages of a structure document; null where it is no XML."""
    return F.xpath(sanitize_xml(x), F.lit("//page/title/text()"))


def xml_pages_by_pattern(x: _C) -> Column:
    """XML-02: the same by regular expression, for documents that do not parse."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"(?s)<page\b[^>]*>.*?<title>(.*?)</title>"), 1), lambda x: F.trim(x))


def tool_calls(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", longest: int = 500) -> DataFrame:
    """JSN-09: calls in order with the number of their round; a round starts with each assistant message; arguments are cut."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order, text).rowsBetween(Window.unboundedPreceding, 0)
    rounds = messages.withColumn("round", F.sum((F.col(role) == "assistant").cast("long")).over(w))
    return rounds.select(key, order, "round", F.left(F.col(text), F.lit(longest)).alias("arguments"))


def floats_to_bytes(x: _C) -> Column:
    """BIN-01: float32 values as little-endian bytes."""
    import numpy as np

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return run(col(x))


def bytes_to_floats(x: _C) -> Column:
    """BIN-01: and back; bytes beyond the last whole value are left out."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.frombuffer(v[: len(v) // 4 * 4], "<f4"), na_action="ignore")

    return run(col(x))
