"""Named queries over windows, folds, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import tokens
from weftline.operators import windows as W
from weftline.plans.catalogue import Tables, query

_COST = "CAST(ceil(length(text)/4.0) AS BIGINT)"


@query("""SELECT source, CASE WHEN n<=3 THEN 0 WHEN r<=3 THEN r ELSE 4 END::INT AS bucket, count(*) AS n_docs, min(doc_id) AS first_doc FROM
(SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY 1,2""")
def top3_rest_bucket(t: Tables) -> DataFrame:
    return W.top_and_rest(t("documents").select("doc_id", "source", "n_chars"), "source", [F.col("n_chars").desc(), F.col("doc_id")]).groupBy("source", "bucket").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r<=3""")
def last_n_turns(t: Tables) -> DataFrame:
    return W.last_n(t("conversations"), "conv_id", [F.col("turn").desc(), F.col("role"), F.col("text")], 3).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, role FROM conversations c WHERE turn < (SELECT max(turn) FROM conversations x WHERE x.conv_id=c.conv_id AND x.role='user')""")
def history_before_last_user(t: Tables) -> DataFrame:
    return W.before_last(t("conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role")


@query("""SELECT p_partkey, CASE WHEN r>1 THEN p_name||' ('||r||')' ELSE p_name END AS nav_title FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)""")
def occurrence_suffix(t: Tables) -> DataFrame:
    return W.numbered_duplicates(t("part"), "p_name", [F.col("p_partkey")], "nav_title").select("p_partkey", "nav_title")


_D = "d AS (SELECT source, doc_id, ceil(length(text)/4.0)::BIGINT AS cost, lang='en' AS cut, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL)"


def _costed(t: Tables) -> DataFrame:
    """Documents by source, the hot one among them, in order of their ids."""
    d = t("documents").where("text is not null")
    return d.select("source", "doc_id", F.ceil(F.length("text") / 4.0).alias("cost"), (F.col("lang") == "en").alias("cut"))


@query(f"""WITH RECURSIVE {_D},
f AS (SELECT source, r, doc_id, cost AS used, true AS kept FROM d WHERE r=1 UNION ALL
SELECT d.source, d.r, d.doc_id, CASE WHEN f.used+d.cost<=20000 THEN f.used+d.cost ELSE f.used END, f.used+d.cost<=20000 FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.r=f.r+1)
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY r)-1)::INT AS position FROM f WHERE kept""")
def greedy_token_budget(t: Tables) -> DataFrame:
    return W.budget(_costed(t), "source", ["doc_id"], "cost", "doc_id", 20_000).select("source", "doc_id", "position")


@query(f"""WITH RECURSIVE {_D},
f AS (SELECT source, r, doc_id, 30000::BIGINT AS before, cost, cut, CASE WHEN cost<=30000 THEN cost WHEN cut THEN 30000 ELSE 0 END::BIGINT AS tokens FROM d WHERE r=1 UNION ALL
SELECT d.source, d.r, d.doc_id, f.before-f.tokens, d.cost, d.cut, CASE WHEN f.before-f.tokens<=0 THEN 0 WHEN d.cost<=f.before-f.tokens THEN d.cost WHEN d.cut AND f.before-f.tokens>100 THEN f.before-f.tokens ELSE 0 END::BIGINT FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.r=f.r+1)
SELECT source, doc_id, tokens, CASE WHEN cost<=before THEN 'taken' WHEN cut AND before>100 THEN 'cut' ELSE 'dropped' END AS action FROM f WHERE before>0""")
def priority_packing(t: Tables) -> DataFrame:
    return W.pack(_costed(t), "source", ["doc_id"], "cost", "doc_id", 30_000, "cut").select("source", "doc_id", "tokens", "action")


@query(f"""WITH RECURSIVE {_D},
f AS (SELECT source, r, doc_id, cost AS used, 1 AS batch_no FROM d WHERE r=1 UNION ALL
SELECT d.source, d.r, d.doc_id, CASE WHEN f.used>0 AND (f.used+d.cost>2000 OR f.used>=1600) THEN d.cost ELSE f.used+d.cost END, CASE WHEN f.used>0 AND (f.used+d.cost>2000 OR f.used>=1600) THEN f.batch_no+1 ELSE f.batch_no END FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.r=f.r+1)
SELECT source, doc_id, batch_no FROM f""")
def greedy_batches(t: Tables) -> DataFrame:
    return W.batches(_costed(t), "source", ["doc_id"], "cost", "doc_id", 2000).select("source", "doc_id", "batch_no")


@query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') AS ws FROM benchmark), s AS (SELECT item_id, ws, unnest(range(0, greatest(0, ceil((len(ws)-20)/15.0)::INT*15)+1, 15)) AS i FROM w WHERE len(ws)>0)
SELECT item_id, (i/15)::INT AS chunk, array_to_string(ws[i+1:i+20],' ') AS text FROM s""")
def sliding_word_chunks(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.posexplode(tokens.word_windows("text", 20, 5)).alias("chunk", "text"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text)-1000)/800.0)::INT*800)+1, 800)) AS i FROM documents WHERE length(text)>0)
SELECT doc_id, (i/800)::INT AS chunk, substring(text, i+1, 1000) AS chunk_text FROM s""")
def sliding_char_chunks(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(tokens.char_windows("text", 1000, 200)).alias("chunk", "chunk_text"))


@query("""WITH l AS (SELECT doc_id, string_split(text,chr(10)) AS ls FROM documents), s AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls)-10)/10.0)::INT*10)+1, 10)) AS i FROM l)
SELECT doc_id, i+1 AS start_line, least(i+10,len(ls)) AS end_line, length(array_to_string(ls[i+1:i+10],chr(10))) AS n_chars FROM s""")
def line_chunks(t: Tables) -> DataFrame:
    chunks = t("documents").select("doc_id", F.posexplode(tokens.line_windows("text", 10, 0)).alias("i", "c"))
    return chunks.select("doc_id", (F.col("i") * 10 + 1).cast("long").alias("start_line"), (F.col("i") * 10 + F.size(F.split("c", "\n"))).cast("long").alias("end_line"), F.length("c").cast("long").alias("n_chars"))


@query("""SELECT o_orderstatus, batch_no, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)-1)//250 AS batch_no FROM orders) GROUP BY 1,2""")
def fixed_batches(t: Tables) -> DataFrame:
    return W.fixed_batches(t("orders"), "o_orderstatus", [F.col("o_orderkey")], 250).groupBy("o_orderstatus", "batch_no").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents WHERE text IS NOT NULL) WHERE s<=50000""")
def char_budget_prefix(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null").select("source", "doc_id", F.length("text").alias("n"))
    return W.prefix_within(d, "source", [F.col("doc_id")], F.col("n"), 50_000).select("source", "doc_id")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r<=2""")
def capped_per_group(t: Tables) -> DataFrame:
    return W.cap(t("lineitem"), "l_orderkey", [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")], 2).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS position FROM lineitem""")
def row_ordinals(t: Tables) -> DataFrame:
    return W.ordinal(t("lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]).select("l_orderkey", "l_partkey", "l_suppkey", "position")


@query("""WITH x AS (SELECT p_brand, p_partkey, p_size<10 AS low FROM part), k AS (SELECT *, CASE WHEN low THEN row_number() OVER (PARTITION BY p_brand, low ORDER BY p_partkey) END AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM x),
s AS (SELECT p_brand, count(*) AS n, greatest(0, count(*) FILTER (WHERE low)-1) AS save FROM x GROUP BY 1),
q AS (SELECT p_brand, greatest(0, least(save, sum(n) OVER ()-(SELECT count(*)-100 FROM part)-coalesce(sum(save) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))) AS quota FROM s)
SELECT p_partkey, CASE WHEN low AND quota>0 AND k<=quota+1 THEN 0 ELSE r END::INT AS bucket FROM k JOIN q USING (p_brand)""")
def merged_least_pages(t: Tables) -> DataFrame:
    p = t("part").select("p_brand", "p_partkey", "p_size")
    return W.merge_least(p, "p_brand", [F.col("p_partkey")], F.col("p_size") < 10, p.count() - 100).select("p_partkey", "bucket")
