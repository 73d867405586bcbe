"""Line de-duplication by winnowing over line hashes: DataFrame functions only.

Of every window of ``window`` consecutive lines the line of the smallest hash is selected as a fingerprint; every run of that
many lines that stands twice has a fingerprint at the same place, and only selected lines are written and shuffled, each with
the hashes of the lines around it. Fingerprints are counted first, pre-aggregated by task, and those that stand once go. The
positions of the others are joined and extended to both sides, over the windows of which they are the minimum; equal windows
of a fingerprint meet in an aggregation that keeps the first position alone, so that no pair of positions is ever formed,
however common a line is. A window that is not the first of its kind is a repeat; overlapping repeats make up the repeated
run, all lines of which go.

First means: smallest id, then smallest hash of the text, and within one text the smallest line number. Lines without a word
are no part of a run and stay. Documents without an id are left alone and delete nothing; rows of the same id and text count
as one document. Null texts stay null. An empty table gives an empty result. Other columns pass through, whatever their
names; only those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, nested, own_exchange, unnested

#: Lines of a run from which on a repeat is found; every longer run is. With 1, every line is a fingerprint of its own.
WINDOW = 2


def _at(text: Column) -> Column:
    """Numbers of the lines that hold a word."""
    lines = F.split(text, "\n")
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(fingerprint, d, t, first, around array<struct(h, g, line)>): the selected lines, by id and hash of the text.

    ``around``: 96 bits of hash and the numbers of the lines of all windows that hold the selected one; ``first``: the place
    of the first of them among the text's lines with a word.
    """
    src = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x")).where("d is not null and x is not null")
    lines = F.transform(F.split("x", "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), i.alias("line"))))
    src = src.select("d", "t", F.filter(lines, lambda x: x.isNotNull()).alias("l")).where(F.size("l") >= window)
    n = F.size("l")
    least = F.transform(F.sequence(F.lit(0), n - window), lambda s: F.array_min(F.transform(F.slice("l", s + 1, window), lambda x: x["h"])))
    src = src.withColumn("least", least)
    # No minimum of a window over line i exceeds its hash, so line i is selected if the largest of them is its hash.
    start = lambda i: F.greatest(F.lit(0), i - window + 1)
    most = lambda i: F.array_max(F.slice("least", start(i) + 1, F.least(i, n - window) - start(i) + 1))
    each = F.transform("l", lambda x, i: F.when(most(i) == x["h"], F.struct(x["h"].alias("fingerprint"), start(i).alias("first"), F.slice("l", start(i) + 1, i + window - start(i)).alias("around"))))
    return src.select("d", "t", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.fingerprint", "d", "t", "f.first", "f.around")


def repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, gone array<int>): numbers of the lines to delete, by id and hash of the text."""
    selected = cut(fingerprints(docs, window, doc_id, text))
    common = selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(own_exchange("fingerprint"))
    shared = selected.join(common, "fingerprint")
    part = lambda s: F.slice("around", s + 1, window)
    extended = F.transform(
        F.sequence(F.lit(0), F.size("around") - window),
        lambda s: F.when(
            F.array_min(F.transform(part(s), lambda x: x["h"])) == F.col("fingerprint"),
            F.struct(F.xxhash64(F.transform(part(s), lambda x: x["h"]), F.transform(part(s), lambda x: x["g"])).alias("content"), (F.col("first") + s).alias("i"), F.transform(part(s), lambda x: x["line"]).alias("lines")),
        ),
    )
    w = shared.select("fingerprint", "d", "t", F.explode(F.filter(extended, lambda x: x.isNotNull())).alias("w")).select("fingerprint", "d", "t", "w.*")
    first = w.groupBy("fingerprint", "content").agg(F.min(F.struct("d", "t", "i")).alias("least"), F.max(F.struct("d", "t", "i")).alias("most")).where("least < most")
    later = w.join(first.select(own_exchange("fingerprint"), own_exchange("content"), "least"), ["fingerprint", "content"]).where(F.struct("d", "t", "i") > F.col("least"))
    return later.select("d", "t", F.explode("lines").alias("line")).groupBy("d", "t").agg(F.collect_set("line").alias("gone"))


def remove(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", clean: str = "clean_text", lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text that is left, the number of lines with a word, and of those deleted."""
    gone = repeats(docs, window, doc_id, text)
    keyed = nested(docs, key=F.col(doc_id), hash=F.xxhash64(F.col(text)))
    joined = keyed.join(gone.hint("shuffle_hash"), (F.col("key") == F.col("d")) & (F.col("hash") == F.col("t")), "left")
    x = F.col("row")[text]
    joined = joined.withColumn("all", F.when(F.col("gone").isNotNull(), F.split(x, "\n")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"), lambda i: F.get("all", i))
    results = {
        clean: F.when(F.col("gone").isNull(), x).otherwise(F.array_join(left, "\n")),
        lines: F.coalesce(F.size(_at(x)), F.lit(0)).cast("long"),
        removed: F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    return unnested(joined, **results)
