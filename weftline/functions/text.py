"""Text functions: slugs, markdown, outlines, front matter, templates, escapes, lines, enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_C = Column | str


def col(x: _C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_default(x: _C, default: _C) -> Column:
    """PRJ-04: ``default`` where x is null or blank."""
    return F.when(F.trim(col(x)) != "", col(x)).otherwise(col(default) if isinstance(default, Column) else F.lit(default))


def fold_distinct(items: Column) -> Column:
    """SET-05, ARR-04: trimmed, blanks dropped, first of each spelling kept whatever its case."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def merge_distinct(a: _C, b: _C) -> Column:
    """SET-05: ordered union of two arrays, case-insensitive; null arrays are empty."""
    none = F.array().cast("array<string>")
    return fold_distinct(F.concat(F.coalesce(col(a), none), F.coalesce(col(b), none)))


def slug(x: _C) -> Column:
    """STR-05: lower case, runs of other characters to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slug_unicode(x: _C) -> Column:
    """STR-05: as slug, but letters and digits of any script stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def identifier(x: _C) -> Column:
    """STR-05: word characters and hyphens; others become underscores."""
    return F.regexp_replace(F.trim(col(x)), r"[^A-Za-z0-9_-]", "_")


def safe_file_name(x: _C, longest: int = 80) -> Column:
    """STR-05: characters that file systems refuse become hyphens; cut to a length."""
    return F.left(F.regexp_replace(col(x), r"[/\\:*?\"<>|\s]+", "-"), F.lit(longest))


def humanize(x: _C) -> Column:
    """STR-06: CamelCase, snake_case and kebab-case to words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " "), r" +", " "))


def anchor(x: _C) -> Column:
    """STR-07: heading anchor: letters, digits, hyphens; blanks to hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}\- ]+", "")), r" +", "-")


def normalise_markdown(x: _C) -> Column:
    """STR-08: think blocks and code-fence lines out, ends trimmed."""
    no_think = F.regexp_replace(col(x), r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(no_think, r"(?m)^```[a-zA-Z]*[ \t]*\n?", ""), F.lit(" \n\t\r"))


def normalise_pages(pages: _C) -> Column:
    """STR-08: the same for every value of a map."""
    return F.transform_values(col(pages), lambda _, v: normalise_markdown(v))


def outline(content: _C, title: _C) -> Column:
    """STR-09: array<struct(level, title, anchor)>: the page title, then headings of levels 2 to 6."""
    marks = F.regexp_extract_all(col(content), F.lit(r"(?m)^(#{2,6})[ \t]+(.+)$"), 1)
    titles = F.regexp_extract_all(col(content), F.lit(r"(?m)^(#{2,6})[ \t]+(.+)$"), 2)
    row = lambda level, t: F.struct(level.cast("int").alias("level"), F.trim(t).alias("title"), anchor(t).alias("anchor"))
    return F.concat(F.array(row(F.lit(1), col(title))), F.transform(F.arrays_zip(marks.alias("m"), titles.alias("t")), lambda z: row(F.length(z["m"]), z["t"])))


def code_references(content: _C, most: int = 100) -> Column:
    """STR-10: identifiers in backticks and bold PascalCase names, distinct whatever their case."""
    ticks = F.regexp_extract_all(col(content), F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)(?:\(\))?`"), 1)
    bold = F.regexp_extract_all(col(content), F.lit(r"\*\*([A-Z][A-Za-z0-9]+)\*\*"), 1)
    return F.slice(fold_distinct(F.concat(ticks, bold)), 1, most)


def yaml_escape(x: _C) -> Column:
    return F.replace(F.replace(col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def front_matter(fields: dict[str, Column], lists: dict[str, Column], body: _C) -> Column:
    """STR-11: YAML front matter of quoted scalars and lists, then the body."""
    scalars = [F.concat(F.lit(f'{k}: "'), yaml_escape(F.coalesce(v.cast("string"), F.lit(""))), F.lit('"')) for k, v in fields.items()]
    items = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit('  - "'), yaml_escape(x), F.lit('"'))), "\n"))).otherwise(F.lit(f"{k}: []")) for k, v in lists.items()]
    return F.concat_ws("\n", F.lit("---"), *scalars, *items, F.lit("---"), F.lit(""), col(body))


def escape_xml(x: _C) -> Column:
    """STR-12: ampersand first."""
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def interpolate(template: _C, values: _C) -> Column:
    """STR-13: every ``{{name}}`` that the map has; unknown names stay. Values are put in one after the other, in key order."""
    entries = F.array_sort(F.map_entries(col(values)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.aggregate(entries, col(template), lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def left_pad_number(x: _C, width: int) -> Column:
    """STR-21: zero-padded number."""
    return F.lpad(col(x).cast("string"), width, "0")


def numbered_lines(content: _C, first: int = 1, most: int = 500) -> Column:
    """SRC-17: lines from ``first`` on with a gutter of six columns, and a notice where lines are left out."""
    lines = F.split(col(content), "\n")
    shown = F.slice(F.transform(lines, lambda x, i: F.format_string("%6d | %s", i + 1, x)), first, most)
    rest = F.size(lines) - F.lit(first - 1 + most)
    return F.concat(F.array_join(shown, "\n"), F.when(rest > 0, F.format_string("\n... (%d more lines)", rest)).otherwise(F.lit("")))


def cut_with_suffix(x: _C, n: int, suffix: str = "...") -> Column:
    """STR-22."""
    return F.when(F.length(col(x)) > n, F.concat(F.left(col(x), F.lit(n)), F.lit(suffix))).otherwise(col(x))


def multi_line_list(x: _C) -> Column:
    """STR-23: lines, trimmed, blanks dropped, URL-decoded where that is possible."""
    return F.transform(F.filter(F.transform(F.split(col(x), r"\r?\n"), lambda x: F.trim(x)), lambda v: v != ""), lambda v: F.coalesce(F.try_url_decode(v), v))


def numbered_outline(plan: _C) -> Column:
    """STR-24: array<struct(title, description)> from lines like ``1. Title: description``; quotes and bold marks go."""
    hit = F.filter(F.split(col(plan), r"\r?\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s+\S"))
    body = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\d+[.)]\s+", ""), r"[*\"]", ""))
    parts = lambda x: F.split(body(x), r"\s+[-–—]\s+|:\s+", 2)
    return F.transform(hit, lambda x: F.struct(F.trim(F.get(parts(x), 0)).alias("title"), F.coalesce(F.trim(F.get(parts(x), 1)), F.lit("")).alias("description")))


def summary(content: _C) -> Column:
    """STR-25: the first two paragraphs that are no code."""
    return F.array_join(F.slice(F.filter(F.split(col(content), "\n\n"), lambda p: ~F.trim(p).startswith("```") & (F.trim(p) != "")), 1, 2), "\n\n")


def collapse(x: _C) -> Column:
    """STR-26: white space to single blanks, quotes and blanks off the ends."""
    return F.btrim(F.regexp_replace(col(x), r"\s+", " "), F.lit(" \"'"))


def pattern_hint(name: _C, confidence: _C, file: _C, detail: _C) -> Column:
    """STR-27: name|confidence|file|detail."""
    return F.concat_ws("|", col(name), F.format_number(col(confidence), 2), col(file), col(detail))


def parse_hint(hint: _C) -> Column:
    """STR-27: struct(name, confidence, file, detail); a confidence that is no number is null."""
    p = F.split(col(hint), r"\|", 4)
    at = lambda i: F.trim(F.get(p, i))
    return F.struct(at(0).alias("name"), at(1).try_cast("double").alias("confidence"), at(2).alias("file"), at(3).alias("detail"))


def one_of(x: _C, allowed: list[str], default: str) -> Column:
    """STR-28: the trimmed lower-case value if it is allowed, else the default."""
    v = F.lower(F.trim(col(x)))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def fixed_chunks(x: _C, n: int) -> Column:
    """STR-31: pieces of n characters; an empty text has none."""
    c = col(x)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(n)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def signature(x: _C) -> Column:
    """STR-34: what stands before the body, an arrow or a semicolon, on one line."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.concat(col(x), F.lit(";")), r"(?s)^(.*?)(?:\{|=>|;)", 1), r"\s+", " "))


def has_any(x: _C, words: list[str]) -> Column:
    """FLT-12: any of the words, whatever the case."""
    import re

    return F.lower(col(x)).rlike("|".join(re.escape(w.lower()) for w in words))


def contains_folded(x: _C, part: _C) -> Column:
    """FLT-08: substring, whatever the case."""
    return F.contains(F.lower(col(x)), F.lower(col(part) if isinstance(part, Column) else F.lit(part)))


def applies(providers: _C, provider: str) -> Column:
    """FLT-09: a null or empty list means any; otherwise membership whatever the case."""
    a = col(providers)
    return a.isNull() | (F.size(a) == 0) | F.exists(a, lambda x: F.lower(x) == provider.lower())


def in_locale(x: _C, locale: str) -> Column:
    """SRT-04: the text as its locale orders it (``zh``: by pinyin, ``sv``: å, ä, ö last), for sorting and comparing."""
    return F.collate(col(x), locale)
