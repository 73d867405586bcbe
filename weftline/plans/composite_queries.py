"""Composite reads: one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths, scoring, text
from weftline.operators import relational as R
from weftline.operators import windows as W
from weftline.plans.catalogue import Tables, query


@query("""WITH s AS (SELECT c_nationkey AS k, min(c_custkey) AS space FROM customer GROUP BY 1), v AS (SELECT o_custkey, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT n_nationkey, n_name, s.space, v.version FROM nation LEFT JOIN s ON s.k=n_nationkey LEFT JOIN v ON v.o_custkey=s.space""")
def project_list(t: Tables) -> DataFrame:
    """QRY-01: each project with its first space and that space's latest version."""
    s = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("space"))
    v = t("orders").groupBy(F.col("o_custkey").alias("space")).agg(F.max("o_orderkey").alias("version"))
    return t("nation").select("n_nationkey", "n_name").join(s, "n_nationkey", "left").join(v, "space", "left")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus='F'), p AS (SELECT * FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 100),
m AS (SELECT l_orderkey, count(*) AS n_calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, coalesce(n_calls,0) AS n_calls, coalesce(tokens,0) AS tokens, round(coalesce(tokens,0)/1000.0*0.002,9)::DOUBLE AS estimated_cost, (SELECT count(*) FROM f) AS total FROM p LEFT JOIN m ON l_orderkey=o_orderkey""")
def task_page(t: Tables) -> DataFrame:
    """QRY-02: a page of tasks with their metrics and cost (Q-08); metrics are aggregated for the page's tasks alone."""
    rows = R.page_with_total(R.where_all(t("orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 0, 100).drop("o_orderdate")
    calls = t("lineitem").join(F.broadcast(rows.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    m = calls.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_calls"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))
    return R.left_lookup(rows, m, "o_orderkey", {"n_calls": 0, "tokens": 0}).withColumn("estimated_cost", F.round(scoring.cost_flat("tokens", F.lit(False)), 9)).select("o_orderkey", "o_custkey", "n_calls", "tokens", "estimated_cost", "total")


@query("""SELECT count(*) AS tasks, count(*) FILTER (WHERE o_orderstatus='F') AS done, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM supplier) AS repositories, CASE WHEN count(*)=0 THEN 100.0 ELSE round(100.0*count(*) FILTER (WHERE o_orderstatus='F')/count(*),6) END::DOUBLE AS success FROM orders""")
def dashboard(t: Tables) -> DataFrame:
    """QRY-05, AGG-17: one-row aggregates side by side; without a task the rate is 100 (Q-14)."""
    one = t("orders").agg(F.count("*").alias("tasks"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    out = one.join(F.broadcast(t("customer").agg(F.count("*").alias("users")))).join(F.broadcast(t("supplier").agg(F.count("*").alias("repositories"))))
    return out.withColumn("success", F.when(F.col("tasks") == 0, 100.0).otherwise(F.round(100.0 * F.col("done") / F.col("tasks"), 6)))


@query("""WITH l AS (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus='F') AS published, max(o_orderkey) AS latest FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey%3=0 AND c_custkey IN (SELECT o_orderkey FROM orders) THEN c_custkey END, published, latest) AS version FROM customer LEFT JOIN l ON o_custkey=c_custkey""")
def resolve_version(t: Tables) -> DataFrame:
    """QRY-07, QRY-08, SRT-05: the version asked for if it exists, else the published one, else the latest."""
    o = t("orders")
    l = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("published"), F.max("o_orderkey").alias("latest"))  # noqa: E741
    asked = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("asked"))
    known = o.select(F.col("o_orderkey").alias("asked"), F.col("o_orderkey").alias("found"))
    return asked.join(known, "asked", "left").join(l, "c_custkey", "left").select("c_custkey", F.coalesce("found", "published", "latest").alias("version"))


@query("""WITH r AS (SELECT o_custkey, bool_or(o_orderstatus='P') AS running, bool_or(o_orderstatus='O') AS waiting, bool_or(o_orderstatus='F') AS done FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN running THEN 'running' WHEN waiting THEN 'pending' WHEN done AND c_acctbal>0 THEN 'reused' ELSE 'queued' END AS decision FROM customer LEFT JOIN r ON o_custkey=c_custkey""")
def submit_decisions(t: Tables) -> DataFrame:
    """QRY-09: running, pending and completed work decide what a new request becomes."""
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    r = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(has("P").alias("running"), has("O").alias("waiting"), has("F").alias("done"))
    decision = F.when(F.col("running"), "running").when(F.col("waiting"), "pending").when(F.col("done") & (F.col("c_acctbal") > 0), "reused").otherwise("queued")
    return t("customer").join(r, "c_custkey", "left").select("c_custkey", decision.alias("decision"))


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories, count(*) AS n FROM part GROUP BY 1""")
def template_categories(t: Tables) -> DataFrame:
    """QRY-10, AGG-11."""
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("categories"), F.count("*").alias("n"))


@query("""SELECT conv_id, string_agg(text, chr(10)||chr(10) ORDER BY turn, text) FILTER (WHERE role='system') AS system_prompt, string_agg(text, chr(10)||chr(10) ORDER BY turn, text) FILTER (WHERE role='user') AS user_prompt FROM conversations GROUP BY 1""")
def prompt_merge(t: Tables) -> DataFrame:
    """QRY-12, STR-33: the parts of each class joined in order."""

    def part(role: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n"))

    return t("conversations").groupBy("conv_id").agg(part("system").alias("system_prompt"), part("user").alias("user_prompt"))


@query("""SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS models FROM part GROUP BY 1""")
def provider_metadata(t: Tables) -> DataFrame:
    """QRY-13."""
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("models"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url,'^[a-zA-Z]+://([^/:?#]+)',1)) AS host FROM pages), f AS (SELECT host, min(page_id) AS first_page FROM u GROUP BY 1) SELECT page_id, first_page AS repository, page_id<>first_page AS existing FROM u JOIN f USING (host)""")
def import_or_get(t: Tables) -> DataFrame:
    """QRY-11: the first import of a key makes the entry, others get it."""
    u = t("pages").select("page_id", paths.url_host("url").alias("host"))
    return u.join(u.groupBy("host").agg(F.min("page_id").alias("repository")), "host").select("page_id", "repository", (F.col("page_id") != F.col("repository")).alias("existing"))


@query("""SELECT source, CASE WHEN n<=3 THEN 0 WHEN r<=3 THEN r ELSE 4 END::INT AS bucket, count(*) AS n_files, CASE WHEN n<=3 THEN source WHEN r<=3 THEN source||'-'||lang ELSE source||'-more' END AS slug FROM
(SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY ALL""")
def site_plan(t: Tables) -> DataFrame:
    """QRY-14: pages of a site: the longest files of each module stand alone, the rest share a page."""
    planned = W.top_and_rest(t("documents").select("doc_id", "source", "lang", "n_chars"), "source", [F.col("n_chars").desc(), F.col("doc_id")])
    name = F.when(F.col("bucket") == 0, F.col("source")).when(F.col("bucket") <= 3, F.concat("source", F.lit("-"), "lang")).otherwise(F.concat("source", F.lit("-more")))
    return planned.withColumn("slug", text.slug(name)).groupBy("source", "bucket", "slug").agg(F.count("*").alias("n_files"))
