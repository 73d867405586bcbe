"""Named queries over summaries, relations, drafts and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scoring, text
from weftline.operators import relational as R
from weftline.operators import reports
from weftline.plans.catalogue import Tables, query


@query("""SELECT count(*) AS n_calls, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens, round(avg(value),6) AS avg_latency, max(value) AS max_latency, count(*) FILTER (WHERE event_type='error') AS failures, round(count(*) FILTER (WHERE event_type='error')/count(*)::DOUBLE,6) AS failure_rate FROM events""")
def call_summary(t: Tables) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    return reports.call_summary(t("events"), tokens, F.col("value"), F.col("event_type") == "error").withColumns({c: F.round(c, 6) for c in ("avg_latency", "failure_rate")})


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1,2), f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS provider FROM events GROUP BY 1)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens, provider, CASE WHEN provider='view' THEN 0.0 ELSE round(CAST(sum(tokens) AS BIGINT)/1000.0*0.002,9) END::DOUBLE AS cost, string_agg(event_type||':'||n, ',' ORDER BY event_type) AS stages FROM s JOIN f USING (user_id) GROUP BY user_id, provider""")
def task_metrics_detail(t: Tables) -> DataFrame:
    """QRY-03: totals, stages, and the cost by the first call's provider (Q-06)."""
    e = t("events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    stages = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"))
    total = stages.groupBy("user_id").agg(F.sum("n").alias("n_calls"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit(":"), "n"))), ",").alias("stages"))
    first = reports.first_call(e, "user_id", F.col("at"), "event_type").withColumnRenamed("event_type", "provider")
    return total.join(first, "user_id").withColumn("cost", F.round(scoring.cost_flat("tokens", F.col("provider") == "view"), 9))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, max(ts) OVER () AS latest FROM events) WHERE ts BETWEEN latest - INTERVAL 7 DAY AND latest""")
def metrics_last_week(t: Tables) -> DataFrame:
    """QRY-04: the seven days before the newest call; its time is a one-row aggregate."""
    e = t("events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("latest")))).where(F.col("ts").between(scoring.ago("latest", days=7), F.col("latest"))).select("user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT DISTINCT left(text,40) AS title FROM documents WHERE lang IN ('en','de')), b AS (SELECT DISTINCT left(text,40) AS title FROM documents WHERE lang IN ('en','fr'))
SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def version_compare(t: Tables) -> DataFrame:
    """QRY-06: added, removed and kept titles."""
    d = t("documents").select("lang", F.left("text", F.lit(40)).alias("title"))
    a, b = d.where(F.col("lang").isin("en", "de")), d.where(F.col("lang").isin("en", "fr"))
    return R.labelled_counts({"added": R.only_in(b, a, "title"), "removed": R.only_in(a, b, "title"), "kept": R.in_both(a, b, "title")}).withColumnRenamed("label", "change")


@query("""SELECT string_agg(source||'='||n, ',' ORDER BY source) AS counts FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""")
def files_per_module(t: Tables) -> DataFrame:
    m = reports.count_map(t("documents"), "source")
    return m.select(F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


@query("""WITH p AS (SELECT n_nationkey AS id, n_regionkey AS parent FROM nation), r AS (SELECT id AS source, unnest([id+1, id*2, id]) AS target, 'related_to' AS relation FROM p UNION ALL SELECT id, unnest([id-3]), 'depends_on' FROM p UNION ALL SELECT id, parent, 'parent' FROM p)
SELECT DISTINCT source, target, relation FROM r WHERE source<>target AND target IN (SELECT id FROM p)""")
def typed_relations(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    p = t("nation").select(k.alias("id"), F.col("n_regionkey").alias("parent"), F.array(k + 1, k * 2, k).alias("related"), F.array(k - 3).alias("needs"))
    return reports.page_relations(p, "id", {"related_to": "related", "depends_on": "needs"}, "parent")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), r AS (SELECT b AS id, string_agg(a::VARCHAR, ',' ORDER BY a::VARCHAR) AS l FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a::VARCHAR) AS r FROM e) WHERE r<=5 GROUP BY 1), c AS (SELECT a AS id, string_agg(b::VARCHAR, ',' ORDER BY b::VARCHAR) AS l FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b::VARCHAR) AS r FROM e) WHERE r<=5 GROUP BY 1)
SELECT s_suppkey AS id, coalesce(r.l,'') AS callers, coalesce(c.l,'') AS callees FROM supplier LEFT JOIN r ON r.id=s_suppkey LEFT JOIN c ON c.id=s_suppkey""")
def caller_lists(t: Tables) -> DataFrame:
    e = t("lineitem").select(F.col("l_partkey").cast("string").alias("caller"), F.col("l_suppkey").cast("string").alias("callee"))
    s = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    out = reports.neighbours(s, e, "id")
    return out.select(F.col("id").cast("long").alias("id"), F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("""SELECT s_suppkey, s_name||' Wiki' AS title, CASE WHEN s_nationkey%2=0 THEN 'main' ELSE 'dev' END AS branch FROM supplier""")
def backfill_projection(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 2 == 0, F.lit("  ")).otherwise("dev").alias("b"))
    return reports.backfilled(s, "s_name", "b").select("s_suppkey", "title", "branch")


@query("""WITH o AS (SELECT p_brand, p_type, max(p_size) AS v FROM part WHERE p_size>40 GROUP BY 1,2), c AS (SELECT p_brand, p_type, min(p_size) AS v FROM part WHERE p_size<5 GROUP BY 1,2)
SELECT DISTINCT p_brand, p_type, coalesce(o.v, c.v, 8000) AS max_context FROM part LEFT JOIN o USING (p_brand, p_type) LEFT JOIN c USING (p_brand, p_type)""")
def metadata_precedence(t: Tables) -> DataFrame:
    p, keys = t("part"), ["p_brand", "p_type"]
    o = p.where("p_size > 40").groupBy(*keys).agg(F.max("p_size").alias("max_context"))
    c = p.where("p_size < 5").groupBy(*keys).agg(F.min("p_size").alias("max_context"))
    return reports.effective_metadata(p.select(*keys).distinct(), o, c, keys, ["max_context"], {"max_context": 8000})


@query("""SELECT doc_id, CASE WHEN quality=1 THEN 'draft '||doc_id ELSE source END AS title, CASE WHEN quality IS NOT NULL THEN upper(lang)||',draft' ELSE upper(lang) END AS tags FROM documents LEFT JOIN labels USING (doc_id)""")
def draft_merge(t: Tables) -> DataFrame:
    pages = t("documents").select("doc_id", F.col("source").alias("title"), F.array(F.upper("lang")).alias("tags"))
    drafts = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("draft "), "doc_id")).otherwise(" ").alias("title"), F.array(F.col("lang"), F.lit("draft")).alias("tags"))
    return reports.merged_drafts(pages, drafts, "doc_id", ["title"], ["tags"]).select("doc_id", "title", F.array_join("tags", ",").alias("tags"))


@query("""WITH s AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name),'[^a-z0-9]+','-','g') AS s FROM part) SELECT CASE WHEN r>1 THEN s||'-'||r ELSE s END AS id, p_brand AS section FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_brand, p_partkey) AS r FROM s)""")
def structure_normalise(t: Tables) -> DataFrame:
    p = t("part").select(F.lit(None).cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("section"), F.array(text.slug("p_name")).alias("related"))
    return reports.normalised_structure(p, "id", "title", "section", "related").select("id", "section")


@query("""SELECT n_nationkey, '{"n_name":"'||n_name||'","n_regionkey":'||n_regionkey||'}' AS payload FROM nation""")
def json_payloads(t: Tables) -> DataFrame:
    return reports.as_json(t("nation"), ["n_nationkey"])
