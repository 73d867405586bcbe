"""SQL (DuckDB) for the operators that SQL can express. The others are tested against brute force."""

#: Base counts, then the histogram sketch: bucket = seven leading bits of the share in parts per million. Verdict: the share less four standard errors against the group's cutoff.
OP4 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text,'') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x<>'') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w)-1)) AS i, w FROM w WHERE len(w)>=3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM g) WHERE n>1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM r) GROUP BY 1),
c AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w,''))::BIGINT AS word_chars, (length(t)-length(regexp_replace(t,'[#*$%&|<>]','','g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l)-len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rw.n,0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed FROM c),
s AS (SELECT doc_id, lang, source, base_failed, unnest([{'share': 'symbols', 'a': n_symbols, 'b': word_chars, 'g': 1}, {'share': 'dup_lines', 'a': n_dup_lines, 'b': n_lines, 'g': 1}, {'share': 'repeats', 'a': n_repeat_words, 'b': n_words, 'g': 3}], recursive := true) FROM b),
v AS (SELECT *, CASE WHEN b>0 THEN least(1000000, a*1000000//b) ELSE 0 END::BIGINT AS v, least(1.0::DOUBLE, a::DOUBLE/b::DOUBLE) AS p FROM s),
k AS (SELECT *, CASE WHEN b>0 THEN (p-4*sqrt(p*(1-p)*g/b))*1000000 ELSE 0 END AS sure, CASE WHEN v<128 THEN v ELSE (v >> (floor(log2(v))::INT-6)) << (floor(log2(v))::INT-6) END AS bucket FROM v),
h AS (SELECT 2 AS level, lang, source, share, bucket, count(*) AS n FROM k WHERE NOT base_failed GROUP BY ALL UNION ALL SELECT 1, lang, NULL, share, bucket, count(*) FROM k WHERE NOT base_failed GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, share, bucket, count(*) FROM k WHERE NOT base_failed GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, share ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, share) AS size FROM h),
q AS (SELECT level, lang, source, share, max(size) AS size, min(bucket) FILTER (WHERE upto*100>=size*50) AS q50, min(bucket) FILTER (WHERE upto*100>=size*75) AS q75 FROM u GROUP BY ALL),
t AS (SELECT level, lang, source, share, size, q75+4*(q75-q50) AS cutoff FROM q),
p AS (SELECT k.doc_id, bool_and(k.sure <= CASE WHEN t2.size>=100 THEN t2.cutoff WHEN t1.size>=100 THEN t1.cutoff ELSE t0.cutoff END) AS ok FROM k
LEFT JOIN (SELECT * FROM t WHERE level=2) t2 ON t2.share=k.share AND t2.lang IS NOT DISTINCT FROM k.lang AND t2.source IS NOT DISTINCT FROM k.source
LEFT JOIN (SELECT * FROM t WHERE level=1) t1 ON t1.share=k.share AND t1.lang IS NOT DISTINCT FROM k.lang LEFT JOIN (SELECT * FROM t WHERE level=0) t0 ON t0.share=k.share GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept FROM b JOIN p USING (doc_id)"""

OP8 = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.k, a.i AS i1, b.i AS i2, first_value((a.doc_id, a.k)) OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.k) AS f FROM n a JOIN n b ON a.doc_id=b.doc_id AND b.k=a.k+1),
g AS (SELECT DISTINCT doc_id, unnest([i1, i2]) AS i FROM w WHERE f <> (doc_id, k)),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed FROM l LEFT JOIN g ON g.doc_id=l.doc_id AND g.i=l.i GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM n WHERE n.doc_id=d.doc_id) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id=d.doc_id"""

#: Every line but the first of its kind goes, alone or in a run.
OP8_EVERY_LINE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE w.k IS NULL OR w.k = 1) AS kept, count(w.k) AS n_lines, count(w.k) FILTER (WHERE w.k > 1) AS n_removed FROM l LEFT JOIN w ON w.doc_id=l.doc_id AND w.i=l.i GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id=d.doc_id"""

#: Each window of 50 words keyed by its words; repeats are those that also start in a smaller document.
OP9 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x<>'') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w)-48)) AS i FROM w WHERE len(w)>=50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM s) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS j FROM w),
m AS (SELECT x.doc_id, x.word, x.j, max(r.i) OVER (PARTITION BY x.doc_id ORDER BY x.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM x LEFT JOIN r ON r.doc_id=x.doc_id AND r.i=x.j),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS n_removed FROM m GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed,0)::BIGINT AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
