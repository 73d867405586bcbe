"""Named queries over scans, filters, joins, aggregates, sets, sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scoring, text
from weftline.operators import intervals
from weftline.operators import relational as R
from weftline.operators import windows as W
from weftline.plans.catalogue import Tables, query


def _tokens() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


@query("""SELECT user_id, count(*) AS n_calls, CAST(coalesce(sum(CAST(props->>'$.k' AS BIGINT)),0) AS BIGINT) AS tokens, round(avg(value),6) AS avg_latency, max(value) AS max_latency,
count(*) FILTER (WHERE event_type='error') AS failures, round(CASE WHEN count(*)>0 THEN count(*) FILTER (WHERE event_type='error')/count(*)::DOUBLE ELSE 0.0 END,6) AS error_rate FROM events GROUP BY user_id""")
def task_metrics_summary(t: Tables) -> DataFrame:
    failed = F.col("event_type") == "error"
    out = t("events").groupBy("user_id").agg(F.count("*").alias("n_calls"), F.coalesce(F.sum(_tokens()), F.lit(0)).alias("tokens"), F.round(F.avg("value"), 6).alias("avg_latency"), F.max("value").alias("max_latency"), F.count_if(failed).alias("failures"))
    return out.withColumn("error_rate", F.round(scoring.ratio("failures", "n_calls"), 6))


@query("""SELECT user_id, event_type, count(*) AS n_calls, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens, round(avg(value),6) AS avg_latency FROM events GROUP BY ALL""")
def stage_metrics_for_task(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n_calls"), F.sum(_tokens()).alias("tokens"), F.round(F.avg("value"), 6).alias("avg_latency"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus='F') AS completed, count(*) FILTER (WHERE o_orderstatus='O') AS active, round(coalesce(sum(o_totalprice),0),2) AS volume,
CASE WHEN count(*)=0 THEN 100.0 ELSE round(100.0*count(*) FILTER (WHERE o_orderstatus='F')/count(*),6) END::DOUBLE AS success_percent FROM orders""")
def global_conditional_stats(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    out = t("orders").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("completed"), F.count_if(s == "O").alias("active"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("volume"))
    return out.withColumn("success_percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("completed") / F.col("total"), 6)))


@query("""SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
def metrics_time_range(t: Tables) -> DataFrame:
    return R.in_range(t("events"), "ts", F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id", "event_type", "value")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus='O' AND o_orderpriority='1-URGENT'), p AS (SELECT o_orderkey, o_custkey, o_totalprice FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40)
SELECT p.*, (SELECT count(*) FROM f) AS total FROM p""")
def dynamic_filter_page(t: Tables) -> DataFrame:
    rows = R.where_all(t("orders"), F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT", None)
    return R.page_with_total(rows.select("o_orderkey", "o_custkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40, 20)


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey IN (1,3,5,7)""")
def in_list_lookup(t: Tables) -> DataFrame:
    return R.in_list(R.in_list(t("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]), "c_nationkey", [1, 3, 5, 7]).select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT p_partkey AS k, p_name AS name, 'part' AS kind FROM part WHERE contains(lower(p_name),'ring') UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier WHERE contains(lower(s_name),'00001')""")
def case_insensitive_contains(t: Tables) -> DataFrame:
    a = t("part").where(text.contains_folded("p_name", "RING")).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit("part").alias("kind"))
    return a.unionByName(t("supplier").where(text.contains_folded("s_name", "00001")).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("""SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('de','fr','es') OR lang = 'fr'""")
def any_or_member_array(t: Tables) -> DataFrame:
    providers = F.when(F.col("lang").isin("de", "fr", "es"), F.array(F.upper("lang")))
    return t("documents").where(text.applies(providers, "fr")).select("doc_id", "lang")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus='P' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 5 MINUTE AND o_totalprice < 300000""")
def stale_running(t: Tables) -> DataFrame:
    return R.stale(t("orders"), "o_orderdate", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 5, F.col("o_orderstatus") == "P", F.col("o_totalprice") < 300000).select("o_orderkey")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
def three_table_inner_join(t: Tables) -> DataFrame:
    c, n, r = t("customer"), t("nation"), t("region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')""")
def anti_join_backfill(t: Tables) -> DataFrame:
    return R.missing(t("customer"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("""WITH l AS (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem WHERE l_returnflag='R' GROUP BY 1) SELECT o_orderkey, coalesce(l.s, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN l ON l_orderkey=o_orderkey""")
def update_from_join(t: Tables) -> DataFrame:
    new = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("s"))
    return R.update_from(t("orders").select("o_orderkey", "o_orderstatus"), new, "o_orderkey", {"o_orderstatus": "s"})


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) AS n_children FROM customer""")
def correlated_count(t: Tables) -> DataFrame:
    return R.child_counts(t("customer").select("c_custkey"), t("orders"), "c_custkey", "o_custkey")


@query("""WITH m AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice),2) AS spent FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(n_orders,0) AS n_orders, coalesce(spent,0.0) AS spent FROM customer LEFT JOIN m ON o_custkey=c_custkey ORDER BY spent DESC, c_custkey LIMIT 50""")
def left_join_metrics_page(t: Tables) -> DataFrame:
    m = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return R.top(R.left_lookup(t("customer").select("c_custkey", "c_name"), m, "c_custkey", {"n_orders": 0, "spent": 0.0}), [F.col("spent").desc(), F.col("c_custkey")], 50)


@query("""SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1)""")
def semi_join_refs(t: Tables) -> DataFrame:
    return R.present(t("documents"), t("labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber+CAST(l_quantity AS INT)%3 AS e FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber*2 AS s2, l_linenumber*2+1 AS e2 FROM lineitem WHERE l_returnflag='N')
SELECT k, count(*) AS n_overlaps FROM a JOIN b USING (k) WHERE s2<=e AND e2>=s GROUP BY k""")
def interval_overlap_join(t: Tables) -> DataFrame:
    a = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("e"))
    b = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 2).alias("s2"), (F.col("l_linenumber") * 2 + 1).alias("e2"))
    return intervals.overlap(a, b, "k", "s", "e", "s2", "e2").groupBy("k").agg(F.count("*").alias("n_overlaps"))


_SPANS = """a AS (SELECT l_returnflag AS f, l_orderkey AS id, l_linenumber AS n, l_partkey*50+l_suppkey AS s, l_partkey*50+l_suppkey+CAST(l_quantity AS BIGINT) AS e FROM lineitem)"""


def _spans(t: Tables) -> DataFrame:
    """Lines of three keys, each of which holds a third of all rows or more, as intervals of part and supplier."""
    at = F.col("l_partkey") * 50 + F.col("l_suppkey")
    return t("lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), at.alias("s"), (at + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""WITH {_SPANS}, b AS (SELECT f, s AS s2, e AS e2 FROM a WHERE n=1)
SELECT f, count(*) AS n_pairs, sum(s2-s)::BIGINT AS shift FROM a JOIN b USING (f) WHERE a.n=2 AND s2<=e AND e2>=s GROUP BY 1""")
def interval_pairs_by_bins(t: Tables) -> DataFrame:
    a = _spans(t)
    b = a.where("n = 1").select("f", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return intervals.overlap(a.where("n = 2"), b, "f", "s", "e", "s2", "e2", hot=1).groupBy("f").agg(F.count("*").alias("n_pairs"), F.sum(F.col("s2") - F.col("s")).cast("long").alias("shift"))


@query(f"""WITH {_SPANS}, c AS (SELECT DISTINCT f, s, e FROM a WHERE n<=2), y AS (SELECT f, id, n, s AS s2, e AS e2 FROM a WHERE n>2),
m AS (SELECT c.f, c.s, c.e, arg_min(id, (s2,id)) FILTER (WHERE n<=5) AS first_type, arg_min(id, (s2,id)) FILTER (WHERE n>5) AS first_callable FROM c JOIN y ON y.f=c.f AND s2<=c.e AND e2>=c.s GROUP BY 1,2,3)
SELECT c.f, c.s, c.e, first_type, first_callable FROM c LEFT JOIN m USING (f,s,e)""")
def first_symbol_of_chunk(t: Tables) -> DataFrame:
    a = _spans(t)
    symbols = a.where("n > 2").select("f", "id", "n", F.col("s").alias("s2"), F.col("e").alias("e2"))
    kinds = {"first_type": F.col("n") <= 5, "first_callable": F.col("n") > 5}
    return intervals.first_overlap(a.where("n <= 2").select("f", "s", "e").distinct(), symbols, "f", ["s", "e"], "s", "e", "s2", "e2", ["s2"], "id", kinds).select("f", "s", "e", "first_type", "first_callable")


@query("""WITH a AS (SELECT c_nationkey AS nk, c_mktsegment AS seg, min(c_custkey) AS v FROM customer GROUP BY 1,2), b AS (SELECT s_nationkey AS nk, min(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT n_nationkey AS nk, s.seg, coalesce(a.v,b.v,-1) AS resolved FROM nation CROSS JOIN (SELECT 'BUILDING' AS seg UNION ALL SELECT 'NONE') s LEFT JOIN a ON a.nk=n_nationkey AND a.seg=s.seg LEFT JOIN b ON b.nk=n_nationkey""")
def cascading_resolution(t: Tables) -> DataFrame:
    base = t("nation").select(F.col("n_nationkey").alias("nk"), F.explode(F.array(F.lit("BUILDING"), F.lit("NONE"))).alias("seg"))
    exact = t("customer").groupBy(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg")).agg(F.min("c_custkey").alias("v"))
    wide = t("supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").alias("v"))
    out = R.cascade(base, [(exact, ["nk", "seg"], "v"), (wide, ["nk"], "v")], "resolved")
    return out.select("nk", "seg", F.coalesce("resolved", F.lit(-1)).alias("resolved"))


@query("""WITH n AS (SELECT DISTINCT lower(split_part(p_name,' ',1)) AS needle FROM part) SELECT item_id, needle FROM benchmark JOIN n ON contains(lower(text), needle)""")
def contains_theta_join(t: Tables) -> DataFrame:
    needles = t("part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("needle")).distinct()
    return R.contains_join(t("benchmark"), needles, "text", "needle").select("item_id", "needle")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang<>'es'), b AS (SELECT doc_id, CASE WHEN n_chars>2000 THEN sha256(text||'.') ELSE sha256(text) END AS h FROM documents WHERE lang<>'de')
SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h=b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id=b.doc_id""")
def snapshot_compare(t: Tables) -> DataFrame:
    d = t("documents")
    a = d.where("lang <> 'es'").select("doc_id", scoring.sha256("text").alias("h"))
    b = d.where("lang <> 'de'").select("doc_id", scoring.sha256(F.when(F.col("n_chars") > 2000, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("h"))
    return R.compare(a, b, "doc_id", "h")


@query("""SELECT c_custkey, n_name AS parent, r_name AS grandparent FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey""")
def self_join_parents(t: Tables) -> DataFrame:
    nodes = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name")).unionByName(t("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")))
    leaf = t("customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"))
    p, g = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"), F.col("parent_id").alias("gid")), nodes.select(F.col("id").alias("gid"), F.col("name").alias("grandparent"))
    return leaf.join(p, "parent_id", "left").join(g, "gid", "left").select("c_custkey", "parent", "grandparent")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus='F'), b AS (SELECT o_custkey AS k, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus='O')
SELECT k, CAST(position AS BIGINT) AS position, x, y FROM a JOIN b USING (k, position)""")
def positional_zip(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    a, b = o.where("o_orderstatus = 'F'").select("k", F.col("o_orderkey").alias("x")), o.where("o_orderstatus = 'O'").select("k", F.col("o_orderkey").alias("y"))
    return R.positional(a, b, [F.col("x")], [F.col("y")], "k").select("k", F.col("position").cast("long").alias("position"), "x", "y")


@query("""WITH c AS (SELECT p_brand AS brand, p_size AS size, min(p_partkey) AS cand FROM part GROUP BY 1,2)
SELECT p_partkey, cand AS parent FROM (SELECT p_partkey, cand, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN cand%5=p_partkey%5 THEN 10 ELSE 5 END DESC, cand) AS r FROM part JOIN c ON c.size=p_size-1) WHERE r=1""")
def best_candidate_parent(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", "p_size")
    c = t("part").groupBy("p_brand", F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("cand")).drop("p_brand")
    score = F.when(F.col("cand") % 5 == F.col("p_partkey") % 5, 10).otherwise(5)
    return R.best_candidate(p, c, F.col("size") == F.col("p_size") - 1, score, ["p_partkey"], [F.col("cand")], [F.col("p_size"), F.col("p_partkey") % 5]).select("p_partkey", F.col("cand").alias("parent"))


@query("""SELECT d.doc_id, CASE WHEN l.quality=1 THEN 'override '||l.doc_id WHEN l.quality=0 THEN d.source||chr(10)||'override '||l.doc_id ELSE d.source END AS resolved FROM documents d LEFT JOIN labels l USING (doc_id)""")
def override_or_base(t: Tables) -> DataFrame:
    base = t("documents").select("doc_id", "source")
    o = t("labels").select("doc_id", F.concat(F.lit("override "), F.col("doc_id")).alias("content"), F.when(F.col("quality") == 1, "replace").otherwise("append").alias("strategy"), F.lit(1).alias("priority"))
    return R.override_or_base(base, o, "doc_id", "source", "content", "strategy", "priority").select("doc_id", "resolved")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem) WHERE r=1""")
def distinct_by_first(t: Tables) -> DataFrame:
    return R.distinct_by(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY r_name""")
def nested_group_list(t: Tables) -> DataFrame:
    n, r = t("nation"), t("region")
    return R.grouped_lists(n.join(r, n["n_regionkey"] == r["r_regionkey"]), "r_name", "n_name").select("r_name", F.array_join("items", ",").alias("nations"))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1 ORDER BY n_suppliers DESC, l_partkey LIMIT 50""")
def distinct_count_top(t: Tables) -> DataFrame:
    return R.top(t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n_suppliers")), [F.col("n_suppliers").desc(), F.col("l_partkey")], 50)


@query("""SELECT source, count(*) AS n_files, max(n_chars) AS longest FROM documents GROUP BY source HAVING count(*)>=2""")
def group_having(t: Tables) -> DataFrame:
    return t("documents").groupBy("source").agg(F.count("*").alias("n_files"), F.max("n_chars").alias("longest")).where("n_files >= 2")


@query("""WITH d AS (SELECT l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_suppkey, count(*) AS n_calls FROM d GROUP BY 1 ORDER BY n_calls DESC, l_suppkey LIMIT 10)
SELECT l_suppkey, n_calls, (SELECT string_agg(p::VARCHAR, ',' ORDER BY p) FROM (SELECT DISTINCT l_partkey AS p FROM d WHERE d.l_suppkey=g.l_suppkey ORDER BY p LIMIT 10)) AS callees FROM g""")
def top_callers(t: Tables) -> DataFrame:
    from weftline.operators import graph

    return graph.top_callers(t("lineitem"), "l_suppkey", "l_partkey").select("l_suppkey", "n_calls", F.array_join(F.col("callees").cast("array<string>"), ",").alias("callees"))


@query("""SELECT o_custkey, coalesce(max(o_orderkey),0)+1 AS next_no FROM orders GROUP BY 1""")
def next_version_no(t: Tables) -> DataFrame:
    return R.next_number(t("orders"), ["o_custkey"], "o_orderkey")


@query("""SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def labelled_union_counts(t: Tables) -> DataFrame:
    return R.labelled_counts({k: t(k) for k in ("region", "nation", "customer", "supplier")})


@query("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal>5000""")
def set_difference(t: Tables) -> DataFrame:
    return R.only_in(t("nation").select(F.col("n_nationkey").alias("k")), t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal>9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal>5000""")
def set_intersection(t: Tables) -> DataFrame:
    return R.in_both(t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_check(t: Tables) -> DataFrame:
    return R.missing(t("documents"), t("labels"), "doc_id").select("doc_id")


@query("""SELECT event_type, count(*) FILTER (WHERE value>50) AS large, count(*) FILTER (WHERE value<=50) AS small FROM events GROUP BY 1""")
def counts_with_predicates(t: Tables) -> DataFrame:
    return R.conditional_counts(t("events"), {"large": F.col("value") > 50, "small": F.col("value") <= 50}, ["event_type"])


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100""")
def custom_rank_sort_topk(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(2)
    return R.top(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [rank, F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r=1""")
def latest_per_group(t: Tables) -> DataFrame:
    return R.latest(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r=1""")
def first_per_group(t: Tables) -> DataFrame:
    return R.distinct_by(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, o_orderdate=max(o_orderdate) OVER (PARTITION BY o_custkey) AND o_orderkey=max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS is_latest FROM orders""")
def supersede_flags(t: Tables) -> DataFrame:
    return W.superseded(t("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey", "is_latest")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 7), o_totalprice DESC, o_orderkey) AS r FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)) WHERE r=1""")
def upsert_latest(t: Tables) -> DataFrame:
    from weftline.sources import sinks

    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", (-(F.col("o_orderkey") % 7)).alias("age"))
    best = Window.partitionBy("o_custkey").orderBy(F.col("age").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey"))
    one = o.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return sinks.upsert(one, one, ["o_custkey"], "age").drop("age")


@query("""SELECT event_type, CAST(sum(CASE WHEN event_type='error' THEN 0 ELSE CAST(props->>'$.k' AS BIGINT) END) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def incremented_counters(t: Tables) -> DataFrame:
    from weftline.sources import sinks

    return sinks.increments(t("events").select("event_type", F.when(F.col("event_type") == "error", 0).otherwise(_tokens()).alias("tokens")), "event_type", ["tokens"])
