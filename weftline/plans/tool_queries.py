"""Named queries over sinks, tools, caches, progress and line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import jsonx, scoring
from weftline.operators import checkpoints, reports, search, tools
from weftline.operators import relational as R
from weftline.plans.catalogue import Tables, query
from weftline.plans.text_queries import BM25
from weftline.sources import files as sources
from weftline.sources import sinks
from weftline.streaming import tasks


@query("""SELECT 'appended' AS what, count(*)*2 AS n FROM nation UNION ALL SELECT 'deleted', count(*) FILTER (WHERE n_regionkey=2) FROM nation UNION ALL SELECT 'queued', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')))
UNION ALL SELECT 'pending', (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id%3=0)""")
def sink_counts(t: Tables) -> DataFrame:
    n, o, d = t("nation"), t("orders"), t("documents")
    spark = n.sparkSession
    path = checkpoints.new_folder(spark, "append")
    sinks.append(n, path)
    sinks.append(n, path)
    _, deleted = sinks.delete(n, F.col("n_regionkey") == 2)
    queued = sinks.enqueue(o.select("o_custkey", "o_orderstatus"), o, ["o_custkey"], F.col("o_orderstatus") == "P")
    pages = d.select("text", F.when(F.col("doc_id") % 3 != 0, "path").alias("path"))
    moved = sinks.migrations({"documents": (pages, "text", "path")})
    named = lambda k, df, c: df.select(F.lit(k).alias("what"), F.col(c).alias("n"))
    out = named("appended", spark.read.parquet(path).agg(F.count("*").alias("n")), "n").unionByName(named("deleted", deleted, "deleted"))
    return out.unionByName(named("queued", queued.agg(F.count("*").alias("n")), "n")).unionByName(named("pending", moved, "pending"))


@query("""SELECT c_mktsegment AS id8, count(*) AS n, min(c_name) AS first FROM (SELECT c_mktsegment[1:8] AS c_mktsegment, c_name FROM customer) GROUP BY 1""")
def json_by_folder(t: Tables) -> DataFrame:
    c = t("customer")
    path = checkpoints.new_folder(c.sparkSession, "folders")
    sinks.by_folder(c.select("c_mktsegment", "c_name"), "c_mktsegment", path)
    return c.sparkSession.read.json(path).groupBy(F.col("id8").cast("string").alias("id8")).agg(F.count("*").alias("n"), F.min("c_name").alias("first"))


@query("""SELECT n_regionkey AS r_regionkey, n_nationkey, n_name FROM nation""")
def json_lines_by_group(t: Tables) -> DataFrame:
    n = t("nation").withColumnRenamed("n_regionkey", "r_regionkey")
    path = checkpoints.new_folder(n.sparkSession, "groups")
    sinks.json_lines_by(n, "r_regionkey", ["n_nationkey"], path)
    return n.sparkSession.read.schema("n_nationkey int, n_name string, r_regionkey int").json(path).select("r_regionkey", "n_nationkey", "n_name")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey=(SELECT min(o_orderkey) FROM orders)""")
def point_lookup(t: Tables) -> DataFrame:
    o = t("orders")
    return sources.by_key(o, "o_orderkey", o.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40 AND p_retailprice>500""")
def optional_predicates(t: Tables) -> DataFrame:
    return R.where_all(t("part"), F.col("p_size").between(10, 40), None, F.col("p_retailprice") > 500).select("p_partkey")


@query(BM25 + """ SELECT item_id, doc_id, round(score,6) AS score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank<=1""")
def cached_search(t: Tables) -> DataFrame:
    """A stored index, searched twice: the second result comes from the cache. Then the index goes."""
    d, b = t("documents").select("doc_id", "text"), t("benchmark")
    root = checkpoints.new_folder(d.sparkSession, "search")
    index = search.build(d, "doc_id", F.col("text"), path=f"{root}/index")
    search.cached_search(index, b, "item_id", "text", 1, f"{root}/cache")
    hits = search.cached_search(index, b, "item_id", "text", 1, f"{root}/cache")
    index.drop()
    return hits.select("item_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE,9) AS a, round(embedding[64]::DOUBLE,9) AS b, len(embedding)::BIGINT AS n FROM embeddings""")
def float_bytes(t: Tables) -> DataFrame:
    v = jsonx.bytes_to_floats(jsonx.floats_to_bytes("embedding"))
    e = t("embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(F.get("v", 0).cast("double"), 9).alias("a"), F.round(F.element_at("v", -1).cast("double"), 9).alias("b"), F.size("v").cast("long").alias("n"))


@query("""SELECT event_id, replace(md5(event_id::VARCHAR),'-','')[1:8] AS id8, greatest(0, floor(1000*0.8)::INT-(event_id%1200)::INT) AS left_over, CASE event_id%3 WHEN 0 THEN 'maximize' WHEN 1 THEN 'economize' ELSE 'balanced' END AS strategy FROM events""")
def ids_and_budgets(t: Tables) -> DataFrame:
    e = t("events").withColumns({"sys": (F.col("event_id") % 1200).cast("int"), "kind": F.element_at(F.array(F.lit("per_call"), F.lit("per_token"), F.lit("free")), (F.col("event_id") % 3 + 1).cast("int"))})
    return e.select("event_id", scoring.short_id(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("id8"), scoring.context_budget(F.lit(1000), F.lit(0.8), "sys").alias("left_over"), scoring.packing_strategy("kind").alias("strategy"))


@query("""SELECT event_id, event_id*60000 AS at, event_type AS author, 'm||'||user_id AS message FROM events""")
def git_log_lines(t: Tables) -> DataFrame:
    e = t("events").select("event_id", F.concat_ws("||", (F.col("event_id") * 60).cast("string"), "event_type", F.concat(F.lit("m||"), "user_id")).alias("value"))
    rows = sources.git_log(e, "value")
    return rows.select((F.unix_millis("commit_time") / 60000).cast("long").alias("event_id"), F.unix_millis("commit_time").alias("at"), "author", "message")


@query("""SELECT event_type AS delta, count(*) AS n FROM events WHERE event_id%5<>0 GROUP BY 1""")
def sse_deltas(t: Tables) -> DataFrame:
    e = t("events")
    k = F.col("event_id") % 5
    lines = e.select(F.when(k == 0, F.lit("data: [DONE]")).otherwise(F.concat(F.lit('data: {"text": "'), "event_type", F.lit('"}'))).alias("value")).unionByName(e.select(F.lit(": keep-alive").alias("value")))
    return sources.sse(lines).groupBy("delta").agg(F.count("*").alias("n"))


@query("""SELECT user_id, epoch_us(date_trunc('minute', ts))//1000 AS minute, count(*) AS n FROM events GROUP BY 1,2""")
def progress_by_minute(t: Tables) -> DataFrame:
    e = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    return tasks.progress(e, "user_id", "at").select("user_id", F.unix_millis("minute").alias("minute"), "n")


@query("""SELECT count(*) AS n, 2::BIGINT AS readers FROM nation""")
def fan_out_readers(t: Tables) -> DataFrame:
    """Three readers of a stream over a small table, of which one fails at once: the other two have all of it."""
    n = t("nation")
    spark = n.sparkSession
    base = checkpoints.new_folder(spark, "fan")
    sinks.append(n, f"{base}/in")

    def fails(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("gone")

    each = tasks.fan_out(tasks.write_by_batch(f"{base}/a", "n_nationkey", "n_name"), fails, tasks.write_by_batch(f"{base}/b", "n_nationkey", "n_name"))
    q = tasks.run_once(tasks.read(spark, f"{base}/in", n.schema), f"{base}/state", each)
    if q.exception():
        raise q.exception()
    a, b = (spark.read.parquet(f"{base}/{x}").select("n_nationkey", "content_hash") for x in "ab")
    both = a.withColumn("r", F.lit("a")).unionByName(b.withColumn("r", F.lit("b")))
    return both.agg(F.countDistinct("n_nationkey").alias("n"), F.countDistinct("r").alias("readers"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus='F') WHERE r<=3""")
def admitted_tasks(t: Tables) -> DataFrame:
    o = t("orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "pending").otherwise("done"))
    return tasks.admitted(o, "status", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query("""WITH e AS (SELECT user_id, event_id, event_type<>'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
x AS (SELECT *, sum((event_id%13=0)::INT) OVER (PARTITION BY user_id ORDER BY r) AS unknowns FROM e), y AS (SELECT *, CASE WHEN NOT ok AND lag(ok,1,true) OVER w=false AND lag(ok,2,true) OVER w=false AND lag(ok,3,true) OVER w=false AND lag(ok,4,true) OVER w=false THEN 1 ELSE 0 END AS five FROM x WINDOW w AS (PARTITION BY user_id ORDER BY r)),
z AS (SELECT *, coalesce(sum(five) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS gone FROM y)
SELECT user_id, event_id, CASE WHEN event_id%13=0 THEN 'unknown' WHEN ok THEN 'ok' ELSE 'error' END AS outcome FROM z WHERE gone=0 AND ((unknowns=0 AND r<=8) OR (unknowns=1 AND event_id%13=0 AND r<=8))""")
def allowed_calls(t: Tables) -> DataFrame:
    e = t("events").withColumns({"known": F.col("event_id") % 13 != 0, "ok": F.col("event_type") != "error"})
    return tasks.allowed_calls(e, "user_id", ["ts"], "event_id", "known", "ok")


@query("""SELECT DISTINCT 'caller' AS direction, 'p'||l_partkey AS neighbour FROM lineitem WHERE l_suppkey=7 ORDER BY 1,2 LIMIT 40""")
def tool_functions(t: Tables) -> DataFrame:
    """A registered table function, called by name as a stage allows it."""
    li = t("lineitem")
    spark = li.sparkSession
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("caller_symbol"), F.concat(F.lit("s"), "l_suppkey").alias("callee_symbol"))
    symbols = t("part").select(F.col("p_name").alias("name"), F.lit("class").alias("kind"), F.lit("a").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    files = t("documents").select(F.col("source").alias("file_path"), F.col("text").alias("content"))
    tools.register(spark, symbols, edges, files)
    return tools.call(spark, "weft_query_call_graph", "s7", allowed=tools.available("plan"))


@query("""WITH p AS (SELECT p_partkey AS id, [p_partkey%50, p_partkey%50+1] AS rel FROM part WHERE p_partkey<=200), b AS (SELECT r AS id, list_sort(list(DISTINCT id)) AS back FROM (SELECT id, unnest(rel) AS r FROM p) GROUP BY 1)
SELECT id, len(list_distinct(list_concat(rel, coalesce(back, []))))::BIGINT AS n FROM p LEFT JOIN b USING (id)""")
def linked_back(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    p = t("part").where("p_partkey <= 200").select(k.alias("id"), F.array(k % 50, k % 50 + 1).alias("rel"))
    return reports.linked_back(p, "id", "rel").select("id", F.size("rel").cast("long").alias("n"))


@query("""SELECT 'p'||p_partkey AS id, CASE WHEN p_partkey%4=0 THEN 'new'||(p_partkey%8+1) ELSE p_name END AS content FROM part""")
def recovered_artifacts(t: Tables) -> DataFrame:
    p = t("part")
    k = F.col("p_partkey")
    payload = lambda n: F.concat(F.lit('{"pages": [{"id": "p'), k, F.lit('", "content": "'), F.lit("new"), n, F.lit('"}]}'))
    old = p.where(k % 4 == 0).select(F.lit("completed").alias("status"), F.lit(1).alias("sequence"), payload(F.lit("old")).alias("payload_json"))
    new = p.where(k % 4 == 0).select(F.lit("completed").alias("status"), F.lit(2).alias("sequence"), payload((k % 8 + 1).cast("string")).alias("payload_json"))
    failed = p.select(F.lit("failed").alias("status"), F.lit(9).alias("sequence"), payload(F.lit("x")).alias("payload_json"))
    return sources.recovered(old.unionByName(new).unionByName(failed), p.select(F.concat(F.lit("p"), k).alias("id"), F.col("p_name").alias("content")))


@query("""SELECT 'https://gitlab.com/api/v4/projects/g%2Fsub%2Fn'||n_nationkey||'/repository/files/src%2Fa.cs/raw?ref=main' AS base FROM nation WHERE n_nationkey%2=0 UNION ALL SELECT 'https://api.github.com/repos/own/n'||n_nationkey||'/contents/src/a.cs' FROM nation WHERE n_nationkey%2=1""")
def connector_urls(t: Tables) -> DataFrame:
    from weftline.functions import paths

    k = F.col("n_nationkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://gitlab.com/g/sub/n"), k, F.lit(".git"))).otherwise(F.concat(F.lit("https://github.com/own/n"), k, F.lit("/")))
    return t("nation").select(paths.raw_file_url(url, F.lit("main"), F.lit("src/a.cs")).alias("base"))


@query("""SELECT n_nationkey, CASE n_nationkey%4 WHEN 0 THEN 'https://h/o/r/blob/main/a'||n_nationkey||'.cs' WHEN 1 THEN 'https://h/o/r/-/blob/main/a'||n_nationkey||'.cs' WHEN 2 THEN 'https://h/o/r/src/main/a'||n_nationkey||'.cs' ELSE 'a'||n_nationkey||'.cs' END AS url FROM nation""")
def file_urls(t: Tables) -> DataFrame:
    from weftline.functions import paths

    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ("github", "gitlab", "bitbucket", "local"))), (k % 4 + 1).cast("int"))
    return t("nation").select("n_nationkey", paths.file_url(F.lit("https://h/o/r.git"), kind, F.lit("main"), F.concat(F.lit("a"), k, F.lit(".cs"))).alias("url"))


@query("""SELECT 'r'||r_regionkey AS id, NULL::VARCHAR AS provider_type, r_name AS repo_name, true AS stamped FROM region""")
def conformed_rows(t: Tables) -> DataFrame:
    """Columns in another case brought to the schema of a table, with audit columns."""
    from weftline import schemas

    raw = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("Id"), F.col("r_name").alias("RepoName"), F.lit(1).alias("Other"))
    rows = sinks.stamped(sinks.conform(schemas.snake_case(raw), schemas.REPOSITORIES))
    return rows.select("id", F.col("provider_type").cast("string").alias("provider_type"), "repo_name", (F.col("created_at").isNotNull() & (F.col("updated_at") == F.col("created_at"))).alias("stamped"))


@query("""SELECT n_name AS name, n_regionkey AS start_line FROM nation""")
def symbol_array_file(t: Tables) -> DataFrame:
    """One file that holds an array of symbols, of 25 nations, written and read back."""
    n = t("nation")
    spark = n.sparkSession
    path = checkpoints.new_folder(spark, "symbols") + "/symbols.json"
    body = n.agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("start_line")))).alias("j")).first()["j"]
    sinks.write_text(spark, path, body)
    return sources.symbol_file(spark, path).select("name", "start_line")


_RULES = "('a.cs'),('src/core/x/b.cs'),('web/c.ts'),('tests/d.py'),('lib/e/f.go')"


@query(f"""WITH p(p) AS (VALUES {_RULES}), s AS (SELECT p, string_split(p,'/') AS x FROM p) SELECT p, CASE WHEN len(x)=1 THEN 'root' ELSE x[1] END AS first, CASE WHEN len(x)=1 THEN 'root' WHEN x[1] NOT IN ('src','tests','lib') THEN x[1] WHEN len(x)>2 THEN x[2] ELSE 'root' END AS second, CASE WHEN len(x)=1 THEN 'root' ELSE x[len(x)-1] END AS last,
CASE WHEN p LIKE '%core/%' THEN 'core' WHEN p LIKE 'web/%' THEN 'web' END AS known, CASE right(p,2) WHEN 'cs' THEN 'csharp' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'go' END AS analysis FROM s""")
def module_rules(t: Tables) -> DataFrame:
    from weftline.functions import paths

    p = t("region").limit(1).select(F.explode(F.array(*map(F.lit, ("a.cs", "src/core/x/b.cs", "web/c.ts", "tests/d.py", "lib/e/f.go")))).alias("p"))
    return p.select("p", paths.module_first("p").alias("first"), paths.module_second("p").alias("second"), paths.module_last("p").alias("last"), paths.module_of("p", F.array(F.lit("core"), F.lit("web"))).alias("known"), paths.language("p", "analysis").alias("analysis"))
