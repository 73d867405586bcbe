"""Token estimates, the search tokenizer, windows over words, characters and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import _C, col

#: STR-04, fixed values: the character ranges that count as CJK.
CJK = r"[一-鿿㐀-䶿　-〿＀-￯぀-ゟ゠-ヿ]"
#: STR-01, fixed values: separators of the search tokenizer. The underscore is none.
SEPARATORS = r"[\s.,;:!?()\[\]{}<>\"'`/\\|@#$%^&*+=~-]+"


def count_cjk(x: _C) -> Column:
    """STR-04. Texts of ASCII alone, whose bytes are as many as their characters, are not searched."""
    n = F.length(col(x))
    return F.when(F.octet_length(col(x)) == n, 0).otherwise(n - F.length(F.regexp_replace(col(x), CJK, "")))


def estimate(x: _C) -> Column:
    """STR-02: CJK characters at 1.5 a token, others at 4, each rounded up; null is 0."""
    n = count_cjk(x)
    return F.coalesce((F.ceil(n / 1.5) + F.ceil((F.length(col(x)) - n) / 4.0)).cast("int"), F.lit(0))


def estimate_quarter(x: _C) -> Column:
    """STR-02: a quarter of the characters, 1 at least, 0 if empty or null."""
    n = F.length(col(x))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.lit(0))


def estimate_floor(x: _C) -> Column:
    """STR-02: a quarter of the characters, rounded down."""
    return F.coalesce(F.floor(F.length(col(x)) / 4).cast("int"), F.lit(0))


def truncate_to(x: _C, limit: int) -> Column:
    """STR-03: the longest prefix whose estimate is within the limit.

    A token covers at most four characters, so only that many are looked at; the cost of a prefix grows with its length, and
    the prefixes of even cost are counted from running counts of CJK characters.
    """
    c = F.left(col(x), F.lit(4 * limit))
    chars = F.split(c, "")
    running = F.aggregate(
        F.transform(chars, lambda ch: ch.rlike(CJK).cast("int")),
        F.struct(F.lit(0).alias("cjk"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda a, v: F.struct((a["cjk"] + v).alias("cjk"), (a["n"] + 1).alias("n"), F.when(F.ceil((a["cjk"] + v) / 1.5) + F.ceil((a["n"] + 1 - a["cjk"] - v) / 4.0) <= limit, a["n"] + 1).otherwise(a["best"]).alias("best")),
        lambda a: a["best"],
    )
    return F.when(estimate(x) <= limit, col(x)).otherwise(F.left(c, running))


def search_tokens(x: _C) -> Column:
    """STR-01: distinct tokens of two characters or more, parts of snake_case, CJK pairs and, from two on, single CJK characters.

    Camel case is not split, as the text is in lower case by then (Q-03).
    """
    low = F.lower(col(x))
    parts = F.filter(F.array_distinct(F.split(low, SEPARATORS)), lambda t: F.length(t) >= 2)
    snake = F.filter(F.flatten(F.transform(F.filter(parts, lambda t: F.contains(t, F.lit("_"))), lambda t: F.split(t, "_"))), lambda t: F.length(t) >= 2)
    cjk = F.regexp_extract_all(low, F.lit(r"([一-鿿])"), 1)
    pairs = F.transform(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, i: F.concat(a, F.get(cjk, i + 1)))
    many = F.size(cjk) >= 2
    none = F.array().cast("array<string>")
    # Most texts have neither, and each costs a pass over the text: bytes as many as characters leave no room for CJK.
    whole = F.when(F.contains(low, F.lit("_")), F.array_distinct(F.concat(parts, snake))).otherwise(parts)
    no_cjk = (F.octet_length(col(x)) == F.length(col(x))) | ~low.rlike(r"[一-鿿]")
    return F.when(no_cjk, whole).otherwise(F.array_distinct(F.concat(whole, F.when(many, pairs).otherwise(none), F.when(many, cjk).otherwise(none))))


def windows(items: Column, size: int, overlap: int) -> Column:
    """WIN-10: slices of ``size`` items that overlap; the last is the first one that reaches the end."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(items) - size) / step).cast("int") * step), F.lit(step))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def word_windows(x: _C, size: int, overlap: int) -> Column:
    words = F.filter(F.split(col(x), r"\s+"), lambda w: w != "")
    return F.transform(windows(words, size, overlap), lambda w: F.array_join(w, " "))


def line_windows(x: _C, size: int, overlap: int) -> Column:
    return F.transform(windows(F.split(col(x), "\n"), size, overlap), lambda w: F.array_join(w, "\n"))


def char_windows(x: _C, size: int, overlap: int) -> Column:
    c, step = col(x), max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(c) - size) / step).cast("int") * step), F.lit(step))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substr(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
