"""Summaries, structure documents, drafts, typed relations, metadata precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scoring, text


def call_summary(calls: DataFrame, tokens: Column, latency: Column, failed: Column, keys: list[str] | None = None) -> DataFrame:
    """AGG-02 to AGG-04: calls, tokens, mean and highest latency, failures, failure rate; overall, or for each key. Nothing gives zeros."""
    out = calls.groupBy(*(keys or [])).agg(F.count("*").alias("n_calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency"), F.coalesce(F.max(latency), F.lit(0.0)).alias("max_latency"), F.count_if(failed).alias("failures"))
    return out.withColumn("failure_rate", scoring.ratio("failures", "n_calls"))


def counts_by(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """AGG-08, AGG-20, AGG-21, FLT-14: rows of each key, with at least so many."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def count_map(df: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """AGG-08, MAP-01: the counts as one map, which is one value: for keys such as modules or kinds. More keys than ``most`` are refused."""
    counted = counts_by(df.where(F.col(key).isNotNull()), key)
    if counted.limit(most + 1).count() > most:
        raise ValueError(f"{key} has over {most} values; use counts_by")
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def projection_totals(files: DataFrame) -> DataFrame:
    """AGG-15: files, symbols, edges and chunks of analysis results; a null list counts as empty."""
    size = lambda c: F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))), F.lit(0))
    return files.agg(F.count("*").alias("files"), size("symbols").alias("symbols"), size("call_edges").alias("edges"), size("chunks").alias("chunks"))


def quality_report(pages: DataFrame, page: str, content: str, fallback: Column, score: Column, weak: int = 60) -> DataFrame:
    """AGG-16, AGG-18: pages, empty, fallback, weak ones (below the score and no fallback), lowest score."""
    rows = pages.select(F.col(page).alias("page"), F.col(content).alias("c"), fallback.alias("f"), score.alias("s"))
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.trim("c") == "", F.lit(True))).alias("empty_pages"), F.count_if("f").alias("fallback_pages"), F.count_if((F.col("s") < weak) & ~F.col("f")).alias("weak_pages"), F.coalesce(F.min("s"), F.lit(0)).alias("lowest"))


def first_call(calls: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """PRJ-02, LIM-03: a value of each key's first call, in a defined order."""
    return calls.groupBy(key).agg(F.min_by(value, order).alias(value))


def backfilled(rows: DataFrame, name: str, branch: str, title: str = " Wiki") -> DataFrame:
    """PRJ-05, PRJ-06: a title from the name, and the branch or main where it is blank."""
    return rows.withColumns({"title": F.concat(F.col(name), F.lit(title)), "branch": text.or_default(branch, "main")})


def neighbours(symbols: DataFrame, edges: DataFrame, name: str, most: int = 5) -> DataFrame:
    """JN-11: each symbol with its first callers and callees, distinct and in order. One aggregation for each side, then joins on the name."""
    callers = edges.groupBy(F.col("callee").alias(name)).agg(F.slice(F.array_sort(F.collect_set("caller")), 1, most).alias("callers"))
    callees = edges.groupBy(F.col("caller").alias(name)).agg(F.slice(F.array_sort(F.collect_set("callee")), 1, most).alias("callees"))
    none = F.array().cast("array<string>")
    return symbols.join(callers, name, "left").join(callees, name, "left").withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("callers", "callees")})


def page_relations(pages: DataFrame, page: str, lists: dict[str, str], parent: str | None = None) -> DataFrame:
    """JN-19, JN-12, SET-03: (source, target, relation) from id lists and parents; ids without a page, and a page's own, are left out."""
    known = pages.select(F.col(page).alias("target"))
    sides = [pages.select(F.col(page).alias("source"), F.explode(c).alias("target"), F.lit(r).alias("relation")) for r, c in lists.items()]
    if parent:
        sides.append(pages.select(F.col(page).alias("source"), F.col(parent).alias("target"), F.lit("parent").alias("relation")))
    edges = reduce(DataFrame.unionByName, sides).where(F.col("source") != F.col("target")).distinct()
    return edges.join(known, "target", "left_semi").select("source", "target", "relation")


def linked_back(pages: DataFrame, page: str, related: str) -> DataFrame:
    """ARR-05, GRF-07: each page's related ids with those of the pages that name it."""
    back = pages.select(F.col(page).alias("_from"), F.explode(related).alias(page)).groupBy(page).agg(F.array_sort(F.collect_set("_from")).alias("_back"))
    none = F.array().cast(pages.schema[related].dataType)
    return pages.join(back, page, "left").withColumn(related, F.array_union(F.coalesce(F.col(related), none), F.coalesce("_back", none))).drop("_back")


def normalised_structure(pages: DataFrame, page: str, title: str, section: str, related: str) -> DataFrame:
    """JSN-06: ids from titles where missing and unique by a suffix, a default section, related ids that exist, each once."""
    from pyspark.sql import Window

    base = F.coalesce(F.nullif(text.slug(F.coalesce(F.col(page), F.col(title))), F.lit("")), F.lit("page"))
    n = F.row_number().over(Window.partitionBy("_id").orderBy(title, section))
    named = pages.withColumn("_id", base).withColumn(page, F.when(n > 1, F.concat("_id", F.lit("-"), n.cast("string"))).otherwise(F.col("_id"))).drop("_id")
    named = named.withColumn(section, text.or_default(section, "general"))
    links = named.select(F.col(page).alias("_p"), F.explode(related).alias(page)).where(F.col("_p") != F.col(page)).join(named.select(page), page, "left_semi")
    kept = links.groupBy(F.col("_p").alias(page)).agg(F.array_sort(F.collect_set(page)).alias("_r"))
    return named.drop(related).join(kept, page, "left").withColumn(related, F.coalesce("_r", F.array().cast("array<string>"))).drop("_r")


def merged_drafts(pages: DataFrame, drafts: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """JSN-07: a draft's value where it is not blank, else the page's; lists are joined, first spelling first."""
    d = drafts.select(key, *[F.col(c).alias(f"_d_{c}") for c in (*scalars, *lists)])
    out = pages.join(d, key, "left")
    return out.withColumns({c: text.or_default(f"_d_{c}", F.col(c)) for c in scalars} | {c: text.merge_distinct(F.col(c), F.col(f"_d_{c}")) for c in lists}).drop(*[f"_d_{c}" for c in (*scalars, *lists)])


def effective_metadata(models: DataFrame, overrides: DataFrame, config: DataFrame, keys: list[str], values: list[str], defaults: dict[str, object]) -> DataFrame:
    """MTH-09: override, else configuration, else default; the two lookups have a row a key."""
    out = models
    for n, frame in (("_o", overrides), ("_c", config)):
        out = out.join(frame.select(*keys, *[F.col(v).alias(f"{n}_{v}") for v in values]), keys, "left")
    return out.select(*models.columns, *[F.coalesce(f"_o_{v}", f"_c_{v}", F.lit(defaults[v])).alias(v) for v in values])


def as_json(df: DataFrame, keys: list[str], out: str = "payload") -> DataFrame:
    """JSN-01: all other columns as one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(out))
