"""Quality rules with adaptive thresholds: DataFrame functions only.

Counts of each text are turned into shares in parts per million. For each language and source a mergeable quantile sketch of
each share is kept: counts of logarithmic buckets (64 for each doubling, so that a quantile is within 1/64 of its value), which
add up over tasks, sources and languages. A group's cutoff lies ``STRETCH`` times the distance from median to upper quartile
above the upper quartile; no constant stands beside it. Where most texts of a group have nothing to count, its cutoff is 0.

A text is too high if its share is so for certain: what is compared with the cutoff is the share less ``SURE`` standard
errors, so that two equal lines of four say little, and forty of eighty much. Groups of fewer than ``LEAST_GROUP`` texts use
the sketch of their language, and those of a small language that of all texts.

Null texts have no words and fail the base rules. A null language or source is a group of its own. Repeated rows are judged
as often as they occur. Ties need no order: every text at a threshold is kept. An empty table gives an empty result. Other
columns pass through, whatever their names; only one named as the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, nested, unnested

#: Base rules: fewest words, and the percentage of words in repeated 3-word windows beyond which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share: (its count, the count it is a share of, how many of the count come together: a repeated window counts three words).
SHARES = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 3)}
STRETCH, SURE, LEAST_GROUP = 4, 4, 100
#: Thresholds are broadcast up to so many groups; beyond them they are joined by a salted shuffle.
BROADCAST_GROUPS, SALTS = 100_000, 32

SPACES = r"[\x20\x09-\x0D]+"


def with_counts(docs: DataFrame, text: str = "text", counts: str = "counts") -> DataFrame:
    """``docs`` with a struct of the counts of each whole text. Row by row; no shuffle.

    Words in repeated windows: window hashes are sorted with their positions, equal neighbours are repeated windows, and the
    words that their positions reach are added up. Texts of which no window repeats skip that.
    """
    out = nested(docs, t=F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split("t", SPACES), lambda x: x != "")
    out = out.withColumns({"w": words, "l": lines})
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    out = out.withColumn("h", F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("h")) < F.size("h")
    out = out.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    out = out.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), (i > 0) & (F.get("s", i - 1)["h"] == x["h"]), F.lit(False))), lambda x: x["p"])))
    reached = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    c = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", "")),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": F.coalesce(reached, F.lit(0)),
    }
    return unnested(out, **{counts: F.struct(*[v.cast("long").alias(k) for k, v in c.items()])})


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def share(c: Column, name: str) -> Column:
    part, whole, _ = SHARES[name]
    return F.when(c[whole] > 0, F.least(F.lit(1_000_000).cast("long"), F.floor(c[part] * 1_000_000 / c[whole]).cast("long"))).otherwise(F.lit(0).cast("long"))


def sure_share(c: Column, name: str) -> Column:
    """The share less ``SURE`` standard errors of a share of that many, in parts per million."""
    part, whole, together = SHARES[name]
    p = F.least(F.lit(1.0), c[part] / c[whole])
    return F.when(c[whole] > 0, (p - SURE * F.sqrt(p * (1 - p) * together / c[whole])) * 1_000_000).otherwise(F.lit(0.0))


def bucket(ppm: Column) -> Column:
    """The lower end of the logarithmic bucket: seven leading bits are kept."""
    shift = F.greatest(F.lit(0), F.length(F.bin(ppm)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", ppm, shift), shift)


def sketches(counted: DataFrame, counts: str = "counts", lang: str = "lang", source: str = "source") -> DataFrame:
    """(level, lang, source, share, bucket, n): bucket counts by source, by language and overall, each a sum of those below it."""
    each = F.array(*[F.struct(F.lit(k).alias("share"), bucket(share(F.col(counts), k)).alias("bucket")) for k in SHARES])
    src = counted.where(~base_failed(F.col(counts))).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("e"))
    by_source = src.groupBy("lang", "source", "e.share", "e.bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    level = lambda df, n: df.select(F.lit(n).alias("level"), "lang", "source", "share", "bucket", "n")
    by_lang = by_source.groupBy("lang", "share", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none)
    overall = by_source.groupBy("share", "bucket").agg(F.sum("n").alias("n")).withColumns({"lang": none, "source": none})
    return level(by_source, 2).unionByName(level(by_lang, 1)).unionByName(level(overall, 0))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, size, one column for each share): the highest share that is kept, in parts per million."""
    key = ["level", "lang", "source", "share"]
    w = Window.partitionBy(*key)
    placed = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "size": F.sum("n").over(w)})
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("size") * percent, F.col("bucket")))
    q = placed.groupBy(*key).agg(at(50).alias("q50"), at(75).alias("q75"), F.first("size").alias("size"))
    cutoff = F.col("q75") + STRETCH * (F.col("q75") - F.col("q50"))
    columns = [F.max(F.when(F.col("share") == k, cutoff)).alias(k) for k in SHARES]
    return q.groupBy("level", "lang", "source").agg(F.max("size").alias("size"), *columns)


def judge(counted: DataFrame, counts: str = "counts", lang: str = "lang", source: str = "source", kept: str = "kept") -> DataFrame:
    """``counted`` with a boolean ``kept``. The cutoffs come from all its rows: it is written once and read twice, so leave the texts out."""
    rows, names = cut(nested(counted, c=F.col(counts), lang=F.col(lang).cast("string"), source=F.col(source).cast("string"))), list(SHARES)
    t = cut(thresholds(sketches(rows, "c")))
    overall = t.where("level = 0").select(F.struct("size", *names).alias("t0"))
    by_source = t.where("level = 2").select(F.col("lang").alias("l2"), F.col("source").alias("s2"), F.struct("size", *names).alias("t2"))
    by_lang = t.where("level = 1").select(F.col("lang").alias("l1"), F.struct("size", *names).alias("t1"))
    fits = t.count() <= BROADCAST_GROUPS
    groups = by_source.join(F.broadcast(by_lang) if fits else by_lang, F.col("l2").eqNullSafe(F.col("l1"))).join(F.broadcast(overall))
    pick = F.when(F.col("t2.size") >= LEAST_GROUP, F.col("t2")).when(F.col("t1.size") >= LEAST_GROUP, F.col("t1")).otherwise(F.col("t0"))
    groups = groups.select("l2", "s2", pick.alias("t"))
    on = F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2"))
    if fits:
        joined = rows.join(F.broadcast(groups), on, "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("c", "lang"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("own") == F.col("salt")), "left")
    ok = ~base_failed(F.col("c"))
    for k in names:
        ok = ok & (sure_share(F.col("c"), k) <= F.col("t")[k])
    return unnested(joined, **{kept: F.coalesce(ok, F.lit(False))})


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass; columns stay as they are. Verdicts go by id and hash of the text, so that rows that repeat share theirs."""
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = with_counts(src).select("d", F.xxhash64("text").alias("t"), "lang", "source", "counts")
    drop = cut(judge(counted).where("not kept").select("d", "t").distinct())
    few = F.broadcast(drop) if drop.count() <= 500_000 else drop
    return nested(docs, key=F.col(doc_id), hash=F.xxhash64(F.col(text))).join(few, F.col("key").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t")), "left_anti").select("row.*")
