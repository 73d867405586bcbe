"""Named queries over trees and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.catalogue import Tables, query

_TREE_SQL = "SELECT 'r'||r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey FROM nation UNION ALL SELECT 'c'||c_custkey, 'n'||c_nationkey FROM customer"


def _tree(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    r = t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"))
    return r.unionByName(n).unionByName(t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent")))


@query("SELECT DISTINCT l_partkey AS a, l_suppkey+1000000 AS b FROM lineitem UNION SELECT DISTINCT l_suppkey+1000000, l_partkey FROM lineitem")
def symmetric_closure(t: Tables) -> DataFrame:
    e = t("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return graph.symmetric(e, "a", "b")


@query(f"WITH RECURSIVE t AS ({_TREE_SQL}), l AS (SELECT id, id AS root, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.id, l.root, l.level+1 FROM t JOIN l ON t.parent=l.id) SELECT id, root, level FROM l")
def tree_depth(t: Tables) -> DataFrame:
    return graph.levels(_tree(t), "id", "parent")


@query(f"WITH RECURSIVE t AS ({_TREE_SQL}), a AS (SELECT id, parent AS ancestor, 1 AS distance FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.id, t.parent, a.distance+1 FROM a JOIN t ON t.id=a.ancestor WHERE t.parent IS NOT NULL) SELECT id, ancestor, distance FROM a")
def ancestor_chain(t: Tables) -> DataFrame:
    return graph.ancestors(_tree(t), "id", "parent")


@query(f"WITH RECURSIVE t AS ({_TREE_SQL}), l AS (SELECT id, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.id, l.level+1 FROM t JOIN l ON t.parent=l.id) SELECT id, row_number() OVER (ORDER BY level, parent NULLS FIRST, id)::INT AS position FROM t JOIN l USING (id)")
def bfs_order(t: Tables) -> DataFrame:
    return graph.tree_order(_tree(t), "id", "parent", ["parent"]).select("id", "position")


@query("SELECT o_orderkey AS node FROM orders WHERE o_orderkey%10<>9")
def nodes_on_cycle(t: Tables) -> DataFrame:
    """Orders in rings of nine; every tenth leads into one."""
    k = F.col("o_orderkey")
    begin = k - k % 10
    known = t("orders").select(k.alias("a"), F.when(k % 10 == 9, begin).when(k % 10 == 8, begin).otherwise(k + 1).alias("b"))
    rings = known.join(known.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    return graph.on_cycle(rings, "a", "b")


@query("SELECT o_orderkey AS node, o_orderkey - o_orderkey%10 AS component FROM orders WHERE o_orderkey%10<8")
def cycle_components(t: Tables) -> DataFrame:
    """Rings of eight orders with chords; the ninth lies between its ring and the next, for every other ring, the tenth leads into its own."""
    k = F.col("o_orderkey")
    begin, at = k - k % 10, k % 10
    each = F.when(at < 8, F.array(begin + (at + 1) % 8, begin + (at * 3 + 2) % 8)).when(at == 8, F.when(begin % 20 == 0, F.array(begin + 10))).otherwise(F.array(begin))
    edges = t("orders").select(k.alias("a"), F.explode(each).alias("b")).unionByName(t("orders").where("o_orderkey % 10 = 8").select((k - 8).alias("a"), k.alias("b")))
    return graph.components(edges, "a", "b")


@query("SELECT n_nationkey//5 AS start_of, string_agg(n_nationkey::VARCHAR, '>' ORDER BY n_nationkey)||'>'||min(n_nationkey) AS cycle FROM nation GROUP BY 1")
def simple_cycles(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    rings = t("nation").select(k.alias("a"), (F.floor(k / 5) * 5 + (k % 5 + 1) % 5).cast("int").alias("b"))
    c = graph.cycles(rings, "a", "b")
    return c.select(F.floor(F.get("path", 0) / 5).cast("int").alias("start_of"), F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey+1)*1000000+l_partkey AS b FROM lineitem UNION SELECT DISTINCT (l_suppkey+1)*1000000+l_partkey, -((l_suppkey+1)*1000000+l_partkey)*10-l_linenumber FROM lineitem UNION SELECT -((l_suppkey+1)*1000000+l_partkey)*10-l_linenumber, 1000000000000000+l_orderkey FROM lineitem WHERE l_returnflag='R'),
r AS (SELECT DISTINCT a AS root FROM e WHERE a NOT IN (SELECT b FROM e) ORDER BY 1 LIMIT 100)
SELECT root, max(d)::INT AS depth FROM (SELECT root, CASE WHEN z.a IS NOT NULL THEN 3 WHEN y.a IS NOT NULL THEN 2 ELSE 1 END AS d FROM r JOIN e x ON x.a=root LEFT JOIN e y ON y.a=x.b LEFT JOIN e z ON z.a=y.b) GROUP BY 1""")
def max_call_depth(t: Tables) -> DataFrame:
    """Suppliers call parts, these their lines, and lines that came back their orders: walks that part and meet again."""
    li = t("lineitem")
    mid = (F.col("l_suppkey") + 1) * 1000000 + F.col("l_partkey")
    low = -mid * 10 - F.col("l_linenumber")
    e = li.select(F.col("l_suppkey").alias("a"), mid.alias("b")).unionByName(li.select(mid.alias("a"), low.alias("b"))).unionByName(li.where("l_returnflag = 'R'").select(low.alias("a"), (F.col("l_orderkey") + 1000000000000000).alias("b")))
    return graph.longest_path(e, "a", "b")


@query("(SELECT DISTINCT 'callee' AS direction, l_suppkey AS neighbour FROM lineitem WHERE l_partkey=7 ORDER BY neighbour LIMIT 20) UNION ALL (SELECT DISTINCT 'caller', l_partkey FROM lineitem WHERE l_suppkey=7 ORDER BY l_partkey LIMIT 20)")
def call_neighbourhood(t: Tables) -> DataFrame:
    return graph.neighbourhood(t("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 7)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey=9 OR l_suppkey=9 ORDER BY 1,2 LIMIT 25")
def find_usages(t: Tables) -> DataFrame:
    return graph.usages(t("lineitem"), "l_partkey", "l_suppkey", 9)


@query("SELECT r_name AS \"from\", 'nation' AS \"to\", count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def module_dependencies(t: Tables) -> DataFrame:
    n, r = t("nation"), t("region")
    imports = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("module"), F.lit("NATION").alias("target"))
    modules = r.select(F.col("r_name").alias("m")).unionByName(r.select(F.lit("nation").alias("m")).distinct())
    return graph.module_edges(imports, modules, "module", "target", "m")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey BETWEEN 3 AND 5 OR n_nationkey=0 THEN NULL ELSE n_nationkey-1 END AS parent FROM nation")
def hierarchy_fixed(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    parent = F.when(k == 0, 999).when(k == 3, 5).otherwise(k - 1).cast("int")
    return graph.break_cycles(t("nation").select(k.alias("id"), parent.alias("parent")), "id", "parent")
