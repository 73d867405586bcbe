"""Graphs and trees as edge tables. Iterations are joins whose state is written to the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.checkpoints import Rounds
from weftline.operators.checkpoints import cut as _cut


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """GRF-07: each edge both ways, once."""
    return edges.select(a, b).union(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def climbed(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, at, distance, done): from each node up to its root, by doubling, so that rounds grow with the logarithm of the depth.

    ``done`` rows are at their root. What is left stands on or under a cycle, at a node of it; nodes under a parent that does
    not exist are left out. Each node has one parent at most.
    """
    no_parent = F.col(parent).isNull()
    rounds = Rounds(nodes.sparkSession)
    state = rounds.put(nodes.select(F.col(node).alias("node"), F.when(no_parent, F.col(node)).otherwise(F.col(parent)).alias("at"), F.when(no_parent, 0).otherwise(1).alias("distance"), no_parent.alias("done")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where(~F.col("done")).isEmpty():
            break
        up = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("distance").alias("_more"), F.col("done").alias("_done"))
        moved = state.where(~F.col("done")).join(up, "at").select("node", F.col("_at").alias("at"), (F.col("distance") + F.col("_more")).alias("distance"), F.col("_done").alias("done"))
        state = rounds.put(state.where("done").unionByName(moved))
    return state


def levels(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """GRF-04, GRF-05: (node, root, level): distance from the root, however deep; nodes under a cycle, or under a parent that does not exist, are not reached."""
    return climbed(nodes, node, parent).where("done").select(F.col("node").alias(node), F.col("at").alias("root"), F.col("distance").alias("level"))


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """GRF-08: (node, ancestor, distance) by doubling. Each round joins the paths of the longest length so far, one a node, to the paths so far, so that a path is made once. Nodes of a cycle have each other, and themselves, as ancestors."""
    step = nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).distinct()
    reach, jump = (_cut(step),) * 2
    seen = -1
    while not jump.isEmpty():
        by = jump.select(F.col("node"), F.col("ancestor").alias("via"), F.col("distance").alias("_d"))
        onward = by.join(reach.select(F.col("node").alias("via"), "ancestor", "distance"), "via").select("node", "ancestor", (F.col("_d") + F.col("distance")).alias("distance"))
        reach = _cut(reach.unionByName(onward).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        now = reach.count()
        if now == seen:
            break
        seen = now
        jump = _cut(by.join(jump.select(F.col("node").alias("via"), "ancestor", "distance"), "via").select("node", "ancestor", (F.col("_d") + F.col("distance")).alias("distance")))
    return reach.withColumnRenamed("node", node)


def trees(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """GRF-08: (node, children, depth): each node with its children in order and its distance from the root: a tree as nested lists, a row for each node."""
    lists = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(node)).agg(F.array_sort(F.collect_set(node)).alias("children"))
    none = F.array().cast(lists.schema["children"].dataType)
    return levels(nodes, node, parent).join(lists, node, "left").select(node, F.coalesce("children", none).alias("children"), F.col("level").alias("depth"))


def _least_reaching(edges: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """(node, least): for each node the least (p, node) of itself and all nodes that reach it along ``edges``.

    A node's least also takes over that of the node it names, which reaches it too, so that rounds don't grow with the length
    of a path but about with its logarithm.
    """
    rounds = Rounds(nodes.sparkSession)
    state = rounds.put(nodes.select("node", F.struct("p", "node").alias("least")))
    while True:
        come = edges.join(state.select(F.col("node").alias(start), "least"), start).select(F.col(end).alias("node"), "least")
        far = state.select(F.col("least.node").alias("_via"), "node").join(state.select(F.col("node").alias("_via"), "least"), "_via").select("node", "least")
        mine = state.withColumn("_own", F.lit(True)).unionByName(come.unionByName(far).withColumn("_own", F.lit(False)))
        state = rounds.put(mine.groupBy("node").agg(F.min("least").alias("least"), F.min(F.when(F.col("_own"), F.col("least"))).alias("_old")).select("node", "least", (F.col("least") < F.col("_old")).alias("_moved")))
        if state.where("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")


def _without_dead_ends(e: DataFrame) -> DataFrame:
    """Edges (a, b) without the nodes whose only way on, however long, ends at a node without an edge out."""
    out = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    up = climbed(nodes.join(out, F.col("node") == F.col("a"), "left").select("node", F.when(F.col("n") == 1, F.col("b")).alias("up")), "node", "up").where("done")
    dead = _cut(up.join(e.select(F.col("a").alias("at")).distinct(), "at", "left_anti").select(F.col("node").alias("_n")))
    return _cut(e.join(dead, F.col("a") == F.col("_n"), "left_anti").join(dead, F.col("b") == F.col("_n"), "left_anti"))


#: Edges of neighbouring nodes whose cycles are looked for at once, in one task.
CHUNK_EDGES = 1 << 18


def strong(first: list[int], to: list[int]) -> list[int]:
    """For each node v, whose edges lead to ``to[first[v] : first[v + 1]]``, one node of its strongly connected component (Tarjan's algorithm, without recursion)."""
    n, clock = len(first) - 1, 0
    at, low, root, inside, waiting = first[:-1], [0] * n, [-1] * n, [0] * n, []
    for start in range(n):
        if inside[start] or root[start] >= 0:
            continue
        path = [start]
        while path:
            v = path[-1]
            if not inside[v]:
                clock += 1
                inside[v] = low[v] = clock
                waiting.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not inside[w]:
                    path.append(w)
                elif root[w] < 0 and inside[w] < low[v]:
                    low[v] = inside[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == inside[v]:
                while root[v] < 0:
                    root[waiting.pop()] = v
    return root


def _nearby(t: pa.Table) -> pa.Table:
    """From sorted edges (a, b): (a, b, near). Near rows: nodes of cycles inside the chunk, beside the least node of their component there. Others: the edges that are left, from such least nodes and, where the chunk shows it, to them."""
    ends = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks().dictionary_encode()
    code, n = ends.indices.to_numpy().astype(np.int64), t.num_rows
    a, b = code[:n], code[n:]  # starts are numbered in their order
    whole = (a != a[0]) & (a != a[-1])  # of the first and last start the chunk may hold some edges only, so they stay as they are
    known = np.zeros(len(ends.dictionary), bool)
    known[a[whole]] = True
    inner = whole & known[b] & (a != b)
    first = np.concatenate(([0], np.cumsum(np.bincount(a[inner], minlength=len(known)))))
    root = np.array(strong(first.tolist(), b[inner].tolist()), np.int64)
    least = np.full(len(root), len(root))
    np.minimum.at(least, root, np.arange(len(root)))
    to = least[root]
    node = np.concatenate((np.flatnonzero(np.bincount(to, minlength=len(to))[to] > 1), a[a == b]))
    rest = np.flatnonzero(to[a] != to[b])
    x, y = np.concatenate((node, to[a[rest]])), np.concatenate((to[node], to[b[rest]]))
    return pa.table({"a": ends.dictionary.take(pa.array(x)), "b": ends.dictionary.take(pa.array(y)), "near": np.arange(len(x)) < len(node)})


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, n = [], 0
    for batch in batches:
        chunk.append(batch)
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield from _nearby(pa.Table.from_batches(chunk)).to_batches()
            chunk, n = [], 0
    if n:
        yield from _nearby(pa.Table.from_batches(chunk)).to_batches()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """GRF-02: (node, component) of the nodes on cycles: strongly connected components of two nodes or more, and nodes with an edge to themselves. The component is its least node.

    Edges are dealt out and sorted by their nodes; cycles among neighbours in that order are contracted where they lie, in chunks
    of a bounded size, so that the rounds see only what is left between them.
    By forward and backward colouring: a node's colour is the node of least priority that reaches it; of the nodes of one colour
    those that reach it back are its component. Priorities are hashed anew each round, which halves what is left on average.
    Chains that lead nowhere, or that nothing leads into, leave at once before that, and single such nodes in each round.
    """
    kind = edges.select(a).union(edges.select(b)).schema[0].dataType
    src = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a is not null and b is not null")
    if isinstance(kind, (T.IntegralType, T.StringType)):
        dealt = src.repartitionByRange("a", "b").distinct().sortWithinPartitions("a", "b")
        parts = Rounds(edges.sparkSession).put(dealt.mapInArrow(_contracted, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("near", T.BooleanType())])))
        near = parts.where("near").select(F.col("a").alias("node"), F.col("b").alias("component"))
        moved = near.where("node <> component").select(F.col("node").alias("b"), "component")
        e = _cut(parts.where("not near").select("a", "b").join(moved, "b", "left").select("a", F.coalesce("component", "b").alias("b")).where("a <> b").distinct())
    else:
        e = _cut(src.distinct())
        near, e = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")), _cut(e.where("a <> b"))
    found, seed = e.limit(0).toDF("node", "component"), 0
    e = _without_dead_ends(e)
    e = _without_dead_ends(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    while True:
        for _ in range(2):
            heads, tails = e.select(F.col("b").alias("_n")).distinct(), e.select(F.col("a").alias("_n")).distinct()
            e = e.join(heads, F.col("a") == F.col("_n"), "left_semi").join(tails, F.col("b") == F.col("_n"), "left_semi")
        e = _cut(e)
        if e.isEmpty():
            break
        nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("p", F.xxhash64("node", F.lit(seed)))
        colour = _cut(_least_reaching(e, nodes, "a", "b").select("node", F.col("least.node").alias("c")))
        by = lambda side: colour.select(F.col("node").alias(side), F.col("c").alias(f"_{side}"))  # noqa: E731, B023
        inner = _cut(e.join(by("a"), "a").join(by("b"), "b").where("_a = _b").select("a", "b"))
        back = _least_reaching(inner, nodes, "b", "a").select("node", F.col("least.node").alias("r"))
        member = _cut(colour.join(back, "node").where("c = r").select("node", "c"))
        groups = member.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
        found = found.unionByName(_cut(member.join(groups, "c").select("node", "component")))
        gone = member.select(F.col("node").alias("_n"))
        e, seed = _cut(inner.join(gone, F.col("a") == F.col("_n"), "left_anti").join(gone, F.col("b") == F.col("_n"), "left_anti")), seed + 1
    merged = found.select(F.col("node").alias("component"), F.col("component").alias("_c"))
    near = near.join(merged, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    return near.unionByName(found).groupBy("node").agg(F.min("component").alias("component"))


def _permuted(e: DataFrame) -> DataFrame:
    """(node): nodes on cycles of edges (a, b), one from each node at most.

    Those at which walks of N edges end; with N doubled they only grow fewer, and once they do not, each of them is led to by
    one of them: a permutation, so that all are on cycles. Rounds grow with the logarithm of the longest way into a cycle.
    """
    rounds, n = Rounds(e.sparkSession), -1
    state = rounds.put(e.select(F.col("a").alias("node"), F.col("b").alias("at")))
    while True:
        ends = _cut(state.select(F.col("at").alias("node")).distinct())
        now = ends.count()
        if now in (0, n):
            return ends
        n = now
        state = rounds.put(state.join(state.select(F.col("node").alias("at"), F.col("at").alias("_at")), "at").select("node", F.col("_at").alias("at")))


def on_cycle(edges: DataFrame, a: str, b: str) -> DataFrame:
    """GRF-02, GRF-06: nodes on cycles: where each node has one edge out (a parent), by doubled walks; else those of the strongly connected components."""
    e = _cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    if e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _permuted(e)
    return components(e, "a", "b").select("node")


def cycles(edges: DataFrame, a: str, b: str, longest: int = 10) -> DataFrame:
    """GRF-02: simple cycles of up to so many edges, each once, from its smallest node (Q-16). Paths never leave nodes above their start."""
    inner = on_cycle(edges, a, b)
    e = _cut(edges.select(a, b).distinct().join(inner, F.col(a) == F.col("node"), "left_semi").join(inner, F.col(b) == F.col("node"), "left_semi"))
    paths = e.where(F.col(b) >= F.col(a)).select(F.array(a, b).alias("path"))
    found = paths.where(F.get("path", 0) == F.get("path", 1))
    for _ in range(longest - 1):
        paths = _cut(paths.where(F.get("path", 0) != F.element_at("path", -1)).join(e, F.element_at("path", -1) == F.col(a)).where((F.col(b) >= F.get("path", 0)) & (~F.array_contains(F.slice("path", 2, 1000), F.col(b)))).select(F.concat("path", F.array(b)).alias("path")))
        if paths.isEmpty():
            break
        found = found.unionByName(paths.where(F.get("path", 0) == F.element_at("path", -1)))
    return found


#: Nodes up to which one step's are broadcast.
BROADCAST_NODES = 100_000


def _reached(e: DataFrame, front: DataFrame, steps: int) -> DataFrame:
    """The distinct edges (a, b) that walks of so many steps from the nodes of ``front`` (at) can take."""
    seen, out = front, e.limit(0)
    for _ in range(steps):
        n = front.count()
        if not n:
            break
        step = _cut(e.join(F.broadcast(front) if n <= BROADCAST_NODES else front, F.col("a") == F.col("at"), "left_semi").distinct())
        out = out.unionByName(step)
        front = _cut(step.select(F.col("b").alias("at")).where("at is not null").distinct().join(seen, "at", "left_anti"))
        seen = seen.unionByName(front)
    return _cut(out)


def longest_path(edges: DataFrame, a: str, b: str, roots: int = 100, deepest: int = 30) -> DataFrame:
    """GRF-03, fixed values 100 and 30: (root, depth): edges on the longest walk from each of the first roots that meets no node twice, up to a depth.

    A walk that has left a strongly connected component never comes back, so only the nodes met inside the present one matter:
    outside cycles, walks of one root that meet at a node after as many edges are one row, at most roots x nodes rows a step;
    inside a component walks are kept apart by the set of its nodes that they have met. Only edges that the roots reach in so
    many steps are looked at for components and walks.
    """
    e = _cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    starts = e.select(F.col("a").alias("root")).distinct().join(e.select(F.col("b").alias("root")).distinct(), "root", "left_anti").orderBy("root").limit(roots)
    starts = _cut(starts)
    e = _reached(e, starts.select(F.col("root").alias("at")), deepest)
    ends = components(e, "a", "b").select(F.col("node").alias("b"), "component")
    e = _cut(e.join(ends, "b", "left"))
    none = F.array().cast(T.ArrayType(e.schema["b"].dataType))
    front = _cut(starts.select("root", F.col("root").alias("at"), F.lit(None).cast(ends.schema["component"].dataType).alias("inside"), none.alias("met")))
    out = front.select("root", F.lit(0).alias("depth"))
    for n in range(1, deepest + 1):
        far = front.join(e, F.col("at") == F.col("a")).where(~F.array_contains("met", F.col("b")))
        met = F.when(F.col("component").isNull(), none).when(F.col("component").eqNullSafe(F.col("inside")), F.array_sort(F.concat("met", F.array("b")))).otherwise(F.array("b"))
        front = _cut(far.select("root", F.col("b").alias("at"), F.col("component").alias("inside"), met.alias("met")).distinct())
        if front.isEmpty():
            break
        out = out.unionByName(front.select("root", F.lit(n).alias("depth")).distinct())
    return out.groupBy("root").agg(F.max("depth").alias("depth"))


def break_cycles(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """GRF-06: parents that do not exist, and those of nodes on a cycle, become null."""
    known = nodes.select(F.col(node).alias("_k"))
    cyc = on_cycle(nodes, node, parent).withColumn("_c", F.lit(True))
    joined = nodes.join(known, F.col(parent) == F.col("_k"), "left").join(cyc, F.col(node) == cyc["node"], "left")
    return joined.withColumn(parent, F.when(F.col("_k").isNotNull() & F.col("_c").isNull(), F.col(parent))).select(*nodes.columns)


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Position of every row in one complete order, from 1, without a task that holds all rows.

    Rows are dealt out by range and sorted where they land; a row's position is its place there after the rows of the
    partitions before it. The table of partitions has one row each.
    """
    placed = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("_m", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_m") - F.shiftleft(F.shiftright("_m", 33), 33)
    return placed.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + inside + 1).cast("int")).drop("_part", "_m", "_before")


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one in one complete order, without a task that holds all rows: as ``ranked``."""
    placed = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)))
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_upto"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_upto") + inside).drop("_part", "_m", "_upto")


def tree_order(nodes: DataFrame, node: str, parent: str, order: list[str]) -> DataFrame:
    """GRF-04, SET-07: breadth-first position; siblings in order; nodes that no root reaches come last."""
    lv = levels(nodes, node, parent)
    placed = nodes.join(lv.drop("root"), node, "left")
    return ranked(placed, [F.col("level").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in (*order, node)]], "position")


def neighbourhood(edges: DataFrame, a: str, b: str, name, most: int = 20) -> DataFrame:
    """GRF-09: (direction, neighbour): the first callers and callees of a node."""
    callers = edges.where(F.col(b) == name).select(F.lit("caller").alias("direction"), F.col(a).alias("neighbour")).distinct().orderBy("neighbour").limit(most)
    callees = edges.where(F.col(a) == name).select(F.lit("callee").alias("direction"), F.col(b).alias("neighbour")).distinct().orderBy("neighbour").limit(most)
    return callers.unionByName(callees)


def usages(edges: DataFrame, a: str, b: str, name, most: int = 25) -> DataFrame:
    """GRF-10: distinct edges that touch a node."""
    return edges.where((F.col(a) == name) | (F.col(b) == name)).select(a, b).distinct().orderBy(a, b).limit(most)


def top_callers(edges: DataFrame, caller: str, callee: str, k: int = 10, most: int = 10, file: str | None = None, confidence: str | None = None) -> DataFrame:
    """AGG-14: callers by number of calls, with their first callees; given their columns, with their first file and highest confidence too."""
    more = [f(c).alias(n) for f, c, n in ((F.min, file, "first_file"), (F.max, confidence, "confidence")) if c]
    n = edges.groupBy(caller).agg(F.count("*").alias("n_calls"), F.slice(F.array_sort(F.collect_set(callee)), 1, most).alias("callees"), *more)
    return n.orderBy(F.col("n_calls").desc(), caller).limit(k)


#: Words in module names, one of each kind for a layered architecture.
LAYERS = [["Api", "Controller"], ["Core", "Service"], ["Repository", "Data"]]


def architecture(modules: DataFrame, name: str) -> DataFrame:
    """GRF-11: layered where module names show all three layers, else modular."""
    hits = modules.agg(*[F.coalesce(F.bool_or(F.col(name).rlike("|".join(words))), F.lit(False)).alias(f"l{i}") for i, words in enumerate(LAYERS)])
    return hits.select(F.when(F.col("l0") & F.col("l1") & F.col("l2"), "layered").otherwise("modular").alias("architecture"))


def module_edges(imports: DataFrame, modules: DataFrame, file_module: str, target: str, module: str) -> DataFrame:
    """GRF-01, JN-13: (from, to, n): imports resolved to the modules that they name; a module's own do not count."""
    m = modules.select(F.col(module).alias("_m")).distinct()
    return imports.join(m, F.lower(target) == F.lower("_m")).where(F.col(file_module) != F.col("_m")).groupBy(F.col(file_module).alias("from"), F.col("_m").alias("to")).agg(F.count("*").alias("n"))
