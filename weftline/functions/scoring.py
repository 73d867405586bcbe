"""Scores, costs, budgets, ratios, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import _C, col

#: MTH-03, fixed values of the ranking formula.
K1, B = 1.5, 0.75


def ratio(a: _C, b: _C) -> Column:
    """MTH-08: a / b, 0 where b is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b)).otherwise(F.lit(0.0))


def idf(n: _C, df: _C) -> Column:
    return F.log((col(n) - col(df) + 0.5) / (col(df) + 0.5) + 1.0)


def saturation(tf: _C, length: _C, mean: _C) -> Column:
    """MTH-03."""
    return damped(col(tf), F.greatest(col(length), F.lit(1)), col(mean))


def damped(tf, length, mean):
    """MTH-03, of columns or arrays; lengths are 1 at least."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def cosine(a: _C, b: _C) -> Column:
    """MTH-04: over the shorter length, in double; 0 if either is zero."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = (F.transform(F.slice(col(v), 1, n), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def recommended_pages(modules: _C, entries: _C, patterns: _C, depth: _C) -> Column:
    """MTH-01: within 15 and 80."""
    return F.greatest(F.lit(15), F.least(F.lit(80), 3 * col(modules) + 2 * col(entries) + 2 * col(patterns) + 3 * col(depth)))


def max_depth(files: _C) -> Column:
    """MTH-01."""
    return F.when(col(files) < 50, 2).when(col(files) < 200, 3).when(col(files) < 500, 4).otherwise(5)


def batches(n: _C, size: int) -> Column:
    """MTH-02."""
    return F.ceil(col(n) / size)


def percent(done: _C, total: _C) -> Column:
    """MTH-02: whole percent, rounded down; 0 without a total."""
    return F.when(col(total) > 0, F.floor(100 * col(done) / col(total))).otherwise(0).cast("int")


def cost_by_price(input_tokens: _C, output_tokens: _C, input_price: _C, output_price: _C, call_price: _C, billing: _C) -> Column:
    """MTH-05: per million tokens, or flat per call."""
    per = (col(input_tokens).cast("decimal(18,0)") * col(input_price) + col(output_tokens).cast("decimal(18,0)") * col(output_price)) / F.lit(1_000_000)
    return F.when(col(billing) == "per_call", col(call_price).cast("decimal(18,6)")).otherwise(per.cast("decimal(18,6)"))


#: MTH-05, fixed values: dollars for a million tokens in and out, by a word in the provider's name.
KEYWORD_PRICES = {"claude": (3.0, 15.0), "gpt": (2.5, 10.0), "gemini": (0.5, 1.5), "deepseek": (0.14, 0.28)}


def cost_by_keyword(provider: _C, input_tokens: _C, output_tokens: _C, default: tuple[float, float] = (1.0, 2.0)) -> Column:
    """MTH-05: the first keyword that the provider's name holds."""
    out = F.lit(None).cast("double")
    pay = lambda p: (col(input_tokens) * p[0] + col(output_tokens) * p[1]) / 1_000_000
    for k, p in reversed(KEYWORD_PRICES.items()):
        out = F.when(F.contains(F.lower(col(provider)), F.lit(k)), pay(p)).otherwise(out)
    return F.coalesce(out, pay(default))


def cost_flat(tokens: _C, local: _C) -> Column:
    """AGG-05: 0.002 for a thousand tokens; nothing for local providers."""
    return F.when(col(local), F.lit(0.0)).otherwise(col(tokens) / 1000 * 0.002)


def page_quality(content: _C, related: _C, files: _C, fallback: _C) -> Column:
    """MTH-06: 0 to 100."""
    c, n = col(content), F.length(col(content))
    blank = F.coalesce(F.trim(c) == "", F.lit(True))
    size = F.when(blank, -30).when(n > 3000, 15).when(n > 1000, 10).when(n > 300, 5).otherwise(-10)
    has = lambda *xs: [F.coalesce(F.contains(c, F.lit(x)), F.lit(False)) for x in xs]
    fence, bar, rule, head = has("```", "|", "---", "##")
    marks = F.when(fence, 10).otherwise(0) + F.when(bar & rule, 5).otherwise(0) + F.when(head, 5).otherwise(0)
    links = F.when(col(related) >= 3, 8).when(col(related) >= 1, 4).otherwise(0)
    sources = F.when(col(files) >= 8, 7).when(col(files) >= 3, 3).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + size + marks + links + sources - F.when(col(fallback), 20).otherwise(0)))


def context_budget(max_context: _C, fill: _C, system_tokens: _C) -> Column:
    """MTH-07: what the system prompt leaves of the filled context, 0 at least."""
    return F.greatest(F.lit(0), F.floor(col(max_context) * col(fill)).cast("int") - col(system_tokens))


def packing_strategy(billing: _C) -> Column:
    """MTH-07: flat calls are filled, paid tokens are saved."""
    return F.when(col(billing) == "per_call", "maximize").when(col(billing) == "per_token", "economize").otherwise("balanced")


def sha256(x: _C, length: int | None = None) -> Column:
    """HSH-01: hex digest, whole or its first characters."""
    h = F.sha2(F.coalesce(col(x).cast("string"), F.lit("")), 256)
    return h if length is None else F.left(h, F.lit(length))


def request_hash(*fields: _C) -> Column:
    """HSH-01: digest of the fields joined by bars; a null field is empty, not left out."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(f).cast("string"), F.lit("")) for f in fields]), 256)


def iso8601(ts: _C) -> Column:
    """DAT-05."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_millis(ts: _C) -> Column:
    """DAT-03."""
    return F.unix_millis(col(ts).cast("timestamp"))


def from_unix(seconds: _C) -> Column:
    """DAT-02."""
    return F.timestamp_seconds(col(seconds))


def ago(ts: _C, minutes: int = 0, days: int = 0) -> Column:
    """DAT-04."""
    return col(ts) - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(minutes))


def short_id(x: _C) -> Column:
    """HSH-02: the first eight characters of an id."""
    return F.left(F.replace(col(x), F.lit("-"), F.lit("")), F.lit(8))
