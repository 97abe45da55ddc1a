"""The same queries in SQL."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what the tokeniser must agree with, stated here anew
_SOLID = r"[:word:]./\\\x{80}-\x{10FFFF}"
RUN = rf"[{_SOLID}-][{_SOLID}:-]*"
NUMBER = r"^-?(\d+[.]?\d*|[.]\d+)$"
IDENTIFIER = r"[-_.:]|[[:lower:]\d][[:upper:]]|[[:upper:]]{2}[[:lower:]]"

_BOW = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{u}', '{l}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2)".format(u=UPPER, l=LOWER)
_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"


def _standard(source: str, keys: str) -> str:
    """CTEs std(keys, text, kind): tokens of a table's column ``text``."""
    return f"""
runs AS (SELECT {keys}, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM {source}),
kinds AS (SELECT *, CASE WHEN regexp_matches(run, '[/\\\\]') THEN 'path' WHEN regexp_matches(run, '{NUMBER}') THEN 'number'
  WHEN regexp_matches(run, '{IDENTIFIER}') THEN 'identifier' ELSE 'word' END AS kind FROM runs),
bodies AS (SELECT *, CASE WHEN kind = 'number' THEN run ELSE regexp_replace(run, '[.:]+$', '') END AS body FROM kinds),
cut AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(body, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
  '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.: ]+'), lambda p: p <> '') AS pieces FROM bodies WHERE kind = 'identifier' AND NOT regexp_matches(body, '^-[^0-9]') AND body <> ''),
inner_parts AS (SELECT {keys}, unnest(pieces) AS piece FROM cut WHERE NOT (len(pieces) = 1 AND pieces[1] = body)),
std AS (SELECT {keys}, {_LOW.format("body")} AS text, kind FROM bodies WHERE body <> ''
  UNION ALL SELECT {keys}, {_LOW.format("piece")}, CASE WHEN regexp_matches(piece, '{NUMBER}') THEN 'number' ELSE 'word' END FROM inner_parts)
"""


_DOC_TERMS = f"dt AS (SELECT doc_id, unnest({_BOW}) AS term FROM documents)"
_QUERY_TERMS = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_BOW}) AS term FROM benchmark) GROUP BY ALL)"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL)"
_LEXICAL = f"{_DOC_TERMS}, {_POST}, {_QUERY_TERMS}"


def _ranked(scored: str, k: int = 10, digits: int = 6, key: str = "doc_id") -> str:
    return f"""SELECT query_id, {key}, CAST(rank AS INTEGER) AS rank, round(score, {digits}) + 0.0 AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM ({scored})) WHERE rank <= {k}"""


def _bm25_scored(k1: float = 1.5, b: float = 0.75, where: str = "") -> str:
    return f"""SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / (total / n)))) AS score
FROM post JOIN qt USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) USING (term)
JOIN (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1) USING (doc_id)
CROSS JOIN (SELECT count(*)::DOUBLE AS n, (SELECT sum(tf) FROM post)::DOUBLE AS total FROM documents) {where} GROUP BY query_id, doc_id"""


_OVERLAP = "SELECT query_id, doc_id, count(DISTINCT term)::DOUBLE AS score FROM post JOIN qt USING (term) GROUP BY 1, 2"
_STD_LEXICAL = f"""d0 AS (SELECT doc_id, 'd' AS side, text FROM documents UNION ALL SELECT item_id, 'q', text FROM benchmark), {_standard("d0", "doc_id, side")},
post AS (SELECT doc_id, text AS term, count(*) AS tf FROM std WHERE side = 'd' GROUP BY ALL),
qt AS (SELECT doc_id AS query_id, text AS term, count(*) AS qtf FROM std WHERE side = 'q' GROUP BY ALL)"""

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_S = """s AS (SELECT id, e, label, CASE WHEN h >= 9223372036854775808 THEN (h - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS w FROM
(SELECT *, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN e[i + 1] > 0 THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT AS h FROM v))"""
_COS = "list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e)))"


def _pairs(score: str, where: str = "true", table: str = "v") -> str:
    return f"SELECT q.id AS query_id, d.id AS doc_id, {score} AS score FROM {table} q CROSS JOIN {table} d WHERE {where}"


_DIST = "SELECT q.id AS query_id, d.id AS doc_id, bit_count(xor(q.w, d.w))::BIGINT AS distance FROM s q CROSS JOIN s d WHERE q.id <> d.id"
_EXACT = f"exact AS ({_ranked(_pairs(_COS, 'q.id <> d.id'))})"
_CAND = f"cand AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS r FROM ({_DIST})) WHERE r <= 64)"
_BITS = "bits AS (SELECT id, label, b, CASE WHEN e[b + 1] > 0 THEN 1 ELSE 0 END AS x FROM v CROSS JOIN (SELECT unnest(range(0, 64)) AS b))"
_HEALTH = """h AS (SELECT b, p, CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END AS entropy FROM (SELECT b, avg(x) AS p FROM bits GROUP BY b))"""
_PROBE = """met AS (SELECT q.id AS query_id, d.id AS doc_id, t, bit_count(xor((q.w >> (8 * t)) & 255, (d.w >> (8 * t)) & 255))::INT AS r
FROM s q CROSS JOIN s d CROSS JOIN (SELECT unnest(range(0, 8))::INT AS t)),
near AS (SELECT * FROM met WHERE r <= 1),
pairs AS (SELECT query_id, doc_id, min(r) AS r FROM near GROUP BY ALL),
cum AS (SELECT query_id, r, sum(count(*)) OVER (PARTITION BY query_id ORDER BY r) AS c FROM pairs GROUP BY query_id, r),
reach AS (SELECT id AS query_id, coalesce((SELECT min(r) FROM cum WHERE cum.query_id = s.id AND c >= (SELECT least(count(*), 640) FROM s)), 1) AS reach FROM s)"""


def _word(test: str) -> str:
    """Signed word of the bits b that pass."""
    h = f"sum(CASE WHEN {test} THEN (1::HUGEINT << b::INT) ELSE 0::HUGEINT END)"
    return f"CASE WHEN {h} >= 9223372036854775808 THEN ({h} - 18446744073709551616)::BIGINT ELSE ({h})::BIGINT END"


_TOKEN_COUNTS = "SELECT doc_id, coalesce(len(t), 0)::BIGINT AS n_tokens, coalesce(len(list_distinct(t)), 0)::BIGINT AS n_distinct FROM"

SQL: dict[str, str] = {
    "tokens_bow": f"{_TOKEN_COUNTS} (SELECT doc_id, {_BOW} AS t FROM documents)",
    "tokens_standard": f"WITH {_standard('documents', 'doc_id')} SELECT doc_id, count(std.text) AS n_tokens, count(DISTINCT std.text) AS n_distinct FROM documents LEFT JOIN std USING (doc_id) GROUP BY doc_id",
    "token_kind_counts": f"WITH {_standard('documents', 'lang')} SELECT lang, kind, count(*) AS n_tokens FROM std GROUP BY ALL",
    "url_tokens": f"WITH u AS (SELECT url AS text FROM pages), {_standard('u', '1 AS one').replace('SELECT 1 AS one, ', 'SELECT ')} SELECT text AS term, kind, count(*) AS n FROM std GROUP BY ALL",
    "token_dictionary": f"WITH {_DOC_TERMS}, {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "postings_positions": f"""WITH p AS (SELECT doc_id, unnest({_BOW}) AS term, generate_subscripts({_BOW}, 1) - 1 AS pos FROM documents)
SELECT doc_id, term, count(*) AS tf, min(pos)::INTEGER AS first_position, max(pos)::INTEGER AS last_position FROM p GROUP BY ALL""",
    "chunk_stats": f"""WITH {_standard('documents', 'doc_id')}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT text) AS u FROM std GROUP BY doc_id)
SELECT (SELECT count(*) FROM documents) AS n_chunks, sum(n)::BIGINT AS total_tokens, sum(u)::BIGINT AS total_unique, max(n)::INTEGER AS longest, round(sum(n) / (SELECT count(*) FROM documents), 6) AS avgdl FROM c""",
    "corpus_stats_oov": f"""WITH {_DOC_TERMS}, q AS (SELECT unnest({_BOW}) AS term FROM benchmark)
SELECT (SELECT count(*) FROM documents) AS n_docs, round((SELECT count(*) FROM dt) / (SELECT count(*) FROM documents), 6) AS mean_length, (SELECT count(DISTINCT term) FROM dt) AS vocabulary,
(SELECT count(*) FROM q) AS query_tokens, (SELECT count(*) FROM q WHERE term NOT IN (SELECT term FROM dt)) AS oov""",
    "token_trigrams": f"""WITH {_DOC_TERMS}, t AS (SELECT DISTINCT term FROM dt)
SELECT gram, count(*) AS n_terms FROM (SELECT DISTINCT term, unnest(CASE WHEN length(term) < 3 THEN [term] ELSE list_transform(range(1, length(term) - 1), lambda i: substr(term, i, 3)) END) AS gram FROM t) GROUP BY gram""",
    "sliding_chunks": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 50) / 206.0)::BIGINT - 1) + 1)) AS chunk FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, chunk, w[chunk * 206 + 1 : chunk * 206 + 256] AS part FROM c)
SELECT doc_id, chunk, len(part)::BIGINT AS n_words, md5(array_to_string(part, ' ')) AS digest FROM p""",
    "bm25_topk": f"WITH {_LEXICAL} {_ranked(_bm25_scored())}",
    "bm25_override": f"WITH {_LEXICAL} {_ranked(_bm25_scored(0.9, 0.4))}",
    "bm25_filtered": f"WITH {_LEXICAL} {_ranked(_bm25_scored(where=chr(87) + 'HERE doc_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')'))}",
    "bm25_standard": f"WITH {_STD_LEXICAL} {_ranked(_bm25_scored())}",
    "retrieval_facade": f"WITH {_STD_LEXICAL} SELECT r.*, source, lang FROM ({_ranked(_bm25_scored())}) r JOIN documents USING (doc_id)",
    "keyword_overlap_topk": f"WITH {_LEXICAL} SELECT query_id, doc_id, rank, score::BIGINT AS score FROM ({_ranked(_OVERLAP)})",
    "bow_cosine_topk": f"""WITH {_LEXICAL}, known AS (SELECT * FROM qt WHERE term IN (SELECT term FROM post)),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM post GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS qn FROM known GROUP BY 1),
dots AS (SELECT query_id, doc_id, sum(tf * qtf) AS d FROM post JOIN known USING (term) GROUP BY 1, 2)
{_ranked("SELECT qn.query_id, documents.doc_id, coalesce(d / (dn * qn), 0.0) AS score FROM qn CROSS JOIN documents LEFT JOIN dn USING (doc_id) LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.doc_id = documents.doc_id")}""",
    "rrf_fusion": f"""WITH {_LEXICAL}, a AS ({_ranked(_bm25_scored())}), b AS ({_ranked(_OVERLAP)}),
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM b)
{_ranked("SELECT query_id, doc_id, sum(part) AS score FROM u GROUP BY 1, 2")}""",
    "vector_cosine_topk": f"WITH {_V} {_ranked(_pairs(_COS))}",
    "vector_dot_topk": f"WITH {_V} {_ranked(_pairs('list_dot_product(q.e, d.e)'))}",
    "vector_l2_topk": f"WITH {_V} {_ranked(_pairs('-(list_distance(q.e, d.e) ^ 2)'))}",
    "vector_filtered": f"WITH {_V} {_ranked(_pairs(_COS, 'q.id <> d.id AND q.label = d.label'))}",
    "object_max_chunk": f"""WITH {_V}, hits AS ({_pairs('list_dot_product(q.e, d.e)')})
{_ranked("SELECT query_id, label AS object_id, max(score) AS score FROM hits JOIN v ON doc_id = id GROUP BY 1, 2", 3, key="object_id")}""",
    "sign_signature": f"WITH {_V}, {_S} SELECT id AS vec_id, w AS signature FROM s",
    "hamming_topk": f"WITH {_V}, {_S} SELECT query_id, doc_id, rank::INTEGER AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM ({_DIST})) WHERE rank <= 10",
    "two_stage_rerank": f"WITH {_V}, {_S}, {_CAND} {_ranked(f'SELECT query_id, doc_id, {_COS} AS score FROM cand JOIN v q ON q.id = query_id JOIN v d ON d.id = doc_id')}",
    "candidate_coverage": f"""WITH {_V}, {_S}, {_EXACT}, {_CAND}, j AS (SELECT query_id, rank, CASE WHEN (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM cand) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM exact)
SELECT count(*) AS n_queries, round(avg(c), 6) AS coverage, round(avg(t), 6) AS top1 FROM (SELECT query_id, avg(hit) AS c, max(CASE WHEN rank = 1 THEN hit END) AS t FROM j GROUP BY 1)""",
    "multiprobe_topk": f"""WITH {_V}, {_S}, {_PROBE}, c AS (SELECT query_id, doc_id, bit_count(xor(q.w, d.w))::BIGINT AS distance FROM pairs JOIN reach USING (query_id) JOIN s q ON q.id = query_id JOIN s d ON d.id = doc_id WHERE r <= reach)
SELECT query_id, doc_id, rank::INTEGER AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM c) WHERE rank <= 10""",
    "multiprobe_diagnostics": f"""WITH {_V}, {_S}, {_PROBE} SELECT query_id, reach::INTEGER AS radius, (CASE WHEN reach = 0 THEN 8 ELSE 72 END)::BIGINT AS probed,
(SELECT count(*) FROM near WHERE near.query_id = reach.query_id AND r <= reach) AS visited, (SELECT count(*) FROM pairs WHERE pairs.query_id = reach.query_id AND r <= reach) AS candidates FROM reach""",
    "aggregate_signatures": f"""WITH {_V}, {_BITS}, c AS (SELECT label, b, sum(x) AS c, count(*) AS n FROM bits GROUP BY 1, 2)
SELECT label, max(n) AS n, {_word("c > 0")} AS any_signature, {_word("c = n")} AS all_signature, {_word("c * 2 >= n")} AS majority_signature, {_word("c >= 0.6 * n")} AS threshold_signature FROM c GROUP BY label""",
    "bit_health": f"WITH {_V}, {_BITS}, {_HEALTH} SELECT b::INTEGER AS bit, round(p, 6) AS occupancy, round(entropy, 6) AS entropy FROM h",
    "code_health": f"""WITH {_V}, {_S}, {_BITS}, {_HEALTH}, g AS (SELECT w, count(*) AS n FROM s GROUP BY w)
SELECT sum(n)::BIGINT AS signatures, count(*) AS distinct_signatures, max(n) AS largest_bucket, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_rate,
(SELECT round(avg(p), 6) FROM h) AS mean_occupancy, (SELECT round(avg(CASE WHEN p IN (0, 1) THEN 1.0 ELSE 0.0 END), 6) FROM h) AS constant_bit_fraction,
(SELECT round(min(entropy), 6) FROM h) AS min_entropy, (SELECT round(avg(entropy), 6) FROM h) AS mean_entropy, (SELECT round(max(entropy), 6) FROM h) AS max_entropy FROM g""",
    "pairwise_hamming": f"""WITH {_V}, {_S}, r AS (SELECT w, row_number() OVER (ORDER BY id) - 1 AS n FROM s), t AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS total FROM s),
st AS (SELECT n, total, (SELECT min(x) FROM (SELECT unnest(range(greatest(1099511628211 % total, 1), greatest(1099511628211 % total, 1) + 1000)) AS x) WHERE gcd(x, total) = 1) AS stride FROM t),
o AS (SELECT CASE WHEN total <= 4096 THEN k ELSE ((1469598103934665603 % total) + k * stride) % total END AS ord, n FROM st, (SELECT unnest(range(0, 4096)) AS k) WHERE k < total),
ij AS (SELECT r.n AS i, r.n + 1 + ord - r.n * (2 * o.n - r.n - 1) // 2 AS j FROM o JOIN r ON r.n * (2 * o.n - r.n - 1) // 2 <= ord AND ord < (r.n + 1) * (2 * o.n - r.n - 2) // 2)
SELECT count(*) AS pairs, round(avg(bit_count(xor(a.w, b.w))), 6) AS mean_distance FROM ij JOIN r a ON a.n = i JOIN r b ON b.n = j""",
    "evaluate_run": f"""WITH {_V}, exact AS ({_ranked(_pairs(_COS, 'q.id <> d.id'), 50)}), m AS (SELECT query_id, rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel FROM exact JOIN v a ON a.id = query_id JOIN v b ON b.id = doc_id),
p AS (SELECT id AS query_id, (SELECT count(*) - 1 FROM v x WHERE x.label = v.label) AS pos FROM v),
i AS (SELECT query_id, pos, (SELECT sum(1 / log2(k + 1)) FROM (SELECT unnest(range(1, 11)) AS k) WHERE k <= pos) AS ideal FROM p),
f AS (SELECT i.query_id, pos, coalesce(sum(CASE WHEN rank <= 1 THEN rel END), 0) / nullif(pos, 0) AS r1, coalesce(sum(CASE WHEN rank <= 5 THEN rel END), 0) / nullif(pos, 0) AS r5, coalesce(sum(CASE WHEN rank <= 10 THEN rel END), 0) / nullif(pos, 0) AS r10, coalesce(sum(rel), 0) / nullif(pos, 0) AS r50,
coalesce(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END), 0) / nullif(ideal, 0) AS nd, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr FROM i LEFT JOIN m USING (query_id) GROUP BY i.query_id, pos, ideal)
SELECT count(*) AS judged, round(avg(coalesce(r1, 0)), 6) AS recall_1, round(avg(coalesce(r5, 0)), 6) AS recall_5, round(avg(coalesce(r10, 0)), 6) AS recall_10, round(avg(coalesce(r50, 0)), 6) AS recall_50,
round(avg(coalesce(nd, 0)), 6) AS ndcg_10, round(avg(rr), 6) AS mrr, 0.0 AS no_answer_accuracy, 0.0 AS empty_result_fraction FROM f""",
    "evaluate_graded": """WITH g AS (SELECT source AS query_id, doc_id, quality * 2 + toxic AS grade FROM documents JOIN labels USING (doc_id)),
r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
i AS (SELECT query_id, count(*) AS pos, sum(CASE WHEN n <= 10 THEN (2.0 ^ grade - 1) / log2(n + 1) ELSE 0 END) AS ideal FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g WHERE grade > 0) GROUP BY 1),
f AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN rank <= 10 THEN (2.0 ^ grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) AS best
  FROM r JOIN g USING (query_id, doc_id) WHERE grade > 0 GROUP BY 1)
SELECT q.query_id, round(coalesce(a / pos, 0), 6) AS recall_5, round(coalesce(b / pos, 0), 6) AS recall_50, round(coalesce(dcg / ideal, 0), 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / best, 0), 6) AS rr
FROM (SELECT DISTINCT source AS query_id FROM documents) q LEFT JOIN i USING (query_id) LEFT JOIN f USING (query_id)""",
    "latency_percentiles": """SELECT count(value) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(quantile_disc(value, 0.5), 4) AS p50, round(quantile_disc(value, 0.95), 4) AS p95, round(quantile_disc(value, 0.99), 4) AS p99 FROM events""",
    "dataset_violations": """WITH i AS (SELECT doc_id::VARCHAR AS id, text FROM documents), q AS (SELECT source AS id FROM documents), j AS (SELECT doc_id::VARCHAR AS id, quality - toxic AS grade FROM labels)
SELECT 'item id repeated' AS rule, id AS key FROM i GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'query id repeated', id FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'item text empty', id FROM i WHERE length(trim(coalesce(text, ''))) = 0
UNION ALL SELECT 'grade negative', 'src0/' || id FROM j WHERE grade < 0
UNION ALL SELECT 'judgment repeated', 'src0/' || id FROM j GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'item unknown', id FROM j WHERE id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'judged query has no positive', id FROM q WHERE NOT (id = 'src0' AND EXISTS (SELECT 1 FROM j WHERE grade > 0))""",
    "thread_reconstruct": "SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "record_validity": """SELECT role, CASE WHEN turn % 2 = 0 THEN 'chunk' ELSE 'graph' END AS kind, count(*) AS n,
sum(CASE WHEN length(text) > 0 AND ((turn % 2 = 0) = (role = 'user')) THEN 1 ELSE 0 END)::BIGINT AS valid FROM conversations GROUP BY ALL""",
    "token_ids": f"""WITH p AS (SELECT doc_id, unnest({_BOW}) AS term, generate_subscripts({_BOW}, 1) AS pos FROM documents),
f AS (SELECT term, min((doc_id, pos)) AS seen, count(DISTINCT doc_id) AS df FROM p GROUP BY term)
SELECT row_number() OVER (ORDER BY seen) AS token_id, term, df FROM f""",
    "message_validity": """SELECT role, count(*) AS n, sum(CASE WHEN length(trim(text)) > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS valid,
sum(CASE WHEN role IN ('user', 'assistant', 'system', 'tool', 'other') THEN 1 ELSE 0 END)::BIGINT AS known_role FROM conversations GROUP BY role""",
    "upsert_replace": "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'xx' ELSE lang END AS lang, source, md5(CASE WHEN lang = 'fr' THEN 'new ' || text ELSE text END) AS digest FROM documents",
    "erase_resource": "SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)",
    "erased_counts": "SELECT source, count(*) AS erased FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY source",
    "reindex_resource": """WITH k AS (SELECT source AS resource_id, doc_id AS chunk_id, lang, CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END AS generation FROM documents WHERE source NOT IN ('src1', 'src2') OR lang = 'en')
SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY chunk_id) - 1 AS ordinal FROM k""",
    "decay_scores": "SELECT user_id, count(*) AS n, round(sum(value * exp(-((epoch_us(m) - epoch_us(ts)) / 3.6e9) / 24.0)), 4) AS score FROM events CROSS JOIN (SELECT max(ts) AS m FROM events) GROUP BY user_id",
    "metadata_filtered": "SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') AND lang <> 'fr' GROUP BY lang",
    "range_tag_filters": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000 AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') GROUP BY 1",
    "revision_match": "SELECT lang, count(*) AS n, sum(CASE WHEN lang = 'fr' THEN 0 ELSE 1 END)::BIGINT AS same FROM documents GROUP BY lang",
    "unchanged_resources": "SELECT doc_id AS resource_id FROM documents WHERE lang <> 'fr'",
    "zero_query_empty": f"WITH {_V} {_ranked(_pairs(_COS, 'q.id % 3 <> 0'))}",
    "fact_object_validity": """SELECT kind, count(*) AS n, sum(CASE WHEN url IS NOT NULL AND length(url) > 0 AND (kind = 'page' OR (length(host) > 0 AND (kind = 'document' OR length(path) > 0))) THEN 1 ELSE 0 END)::BIGINT AS objects,
sum(CASE WHEN length(host) > 0 AND length(path) > 0 THEN 1 ELSE 0 END)::BIGINT AS facts FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'section' ELSE 'page' END AS kind,
regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract(url, '//[^/]*/(.+)$', 1) AS path FROM pages) GROUP BY kind""",
    "phrase_search": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_BOW}, ' ') || ' ' AS t FROM documents), q AS (SELECT item_id AS query_id, ' ' || array_to_string({_BOW}, ' ') || ' ' AS p FROM benchmark WHERE len({_BOW}) > 0)
SELECT query_id, doc_id, ((length(t) - length(replace(t, p, ''))) // length(p))::BIGINT AS n FROM q JOIN d ON contains(t, p)""",
    "embedding_coverage": """SELECT 'missing' AS problem, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'unknown', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'not normalized', vec_id FROM embeddings WHERE abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) > 0.001""",
    "json_dataset": "SELECT 'items' AS part, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'queries', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'qrels', count(*), sum(doc_id)::BIGINT FROM labels",
    "request_cap": f"WITH {_LEXICAL}, r AS ({_ranked(_OVERLAP, 50)}) SELECT query_id, doc_id AS item_id, rank FROM r WHERE rank <= 1 + query_id % 7",
    "bm25_per_query": f"""WITH {_LEXICAL} {_ranked(_bm25_scored("(CASE WHEN query_id % 2 = 0 THEN 0.9 ELSE 1.5 END)", "(CASE WHEN query_id % 2 = 0 THEN 0.4 ELSE 0.75 END)"))}""",
    "bm25f_fields": f"""WITH {_QUERY_TERMS}, f AS (SELECT page_id, 'u' AS f, url AS text FROM pages UNION ALL SELECT page_id, 'h', regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages),
t AS (SELECT page_id, f, unnest({_BOW}) AS term FROM f), l AS (SELECT f.page_id, f.f, len({_BOW}) AS len FROM f), a AS (SELECT f, avg(len) AS mean FROM l GROUP BY f),
w AS (SELECT page_id, term, sum((CASE f WHEN 'u' THEN 2.0 ELSE 1.0 END) * tf / (CASE f WHEN 'u' THEN 0.5 + 0.5 * len / mean ELSE 0.25 + 0.75 * len / mean END)) AS w
FROM (SELECT page_id, f, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL) JOIN l USING (page_id, f) JOIN a USING (f) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM w GROUP BY 1), s AS (SELECT query_id, page_id AS doc_id, sum(qtf * ln(1 + ((SELECT count(*) FROM pages) - df + 0.5) / (df + 0.5)) * w / (1.5 + w)) AS score FROM w JOIN qt USING (term) JOIN df USING (term) GROUP BY 1, 2)
{_ranked("SELECT * FROM s")}""",
    "boolean_search": f"""WITH {_LEXICAL}, c AS (SELECT query_id, term, CASE length(term) % 5 WHEN 0 THEN 'must' WHEN 1 THEN CASE WHEN length(term) > 10 THEN 'must_not' ELSE 'should' END ELSE 'should' END AS clause FROM qt),
m AS (SELECT query_id, doc_id, sum((clause = 'must')::INT) AS m, sum((clause = 'should')::INT) AS s, sum((clause = 'must_not')::INT) AS x FROM c JOIN post USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, (m + s)::BIGINT AS n FROM m JOIN (SELECT query_id, sum((clause = 'must')::INT) AS musts FROM c GROUP BY 1) USING (query_id) WHERE x = 0 AND m = musts AND m + s > 0""",
    "fuzzy_vocabulary": f"WITH {_LEXICAL}, v AS (SELECT DISTINCT term AS match FROM dt) SELECT query_id, term, match, levenshtein(term, match)::INTEGER AS distance FROM qt JOIN v ON abs(length(term) - length(match)) <= 1 AND levenshtein(term, match) <= 1",
    "cooldown": """WITH u AS (SELECT user_id, event_type, max(ts) AS last, max(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS own FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events),
h AS (SELECT c_custkey AS asker, event_type FROM customer, (SELECT DISTINCT event_type FROM events))
SELECT asker, h.event_type AS item_id FROM h LEFT JOIN u ON asker = user_id AND h.event_type = u.event_type CROSS JOIN n WHERE (last IS NULL OR epoch_us(now) - epoch_us(last) >= 86400000000) AND coalesce(own, 0) = 0""",
    "graph_expansion": """WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents UNION SELECT doc_id // 3, doc_id FROM documents),
r AS (SELECT doc_id AS seed, doc_id AS node, 0 AS hops FROM documents WHERE lang = 'fr' UNION SELECT seed, dst, hops + 1 FROM r JOIN e ON node = src WHERE hops < 3)
SELECT seed, node, min(hops)::INTEGER AS hops FROM r GROUP BY 1, 2""",
    "bucket_sizes": f"WITH {_V}, {_S} SELECT size, count(*) AS buckets FROM (SELECT count(*) AS size FROM s GROUP BY w) GROUP BY size",
    "changed_aggregates": f"""WITH {_V}, {_BITS}, c AS (SELECT label, b, sum(CASE WHEN id % 4 <> 1 THEN x ELSE 0 END) AS c, sum((id % 4 <> 1)::INT) AS n FROM bits GROUP BY 1, 2)
SELECT label, max(n)::BIGINT AS n, {_word("n > 0 AND c * 2 >= n")} AS majority_signature, {_word("n > 0 AND c >= 0.7 * n")} AS threshold_signature FROM c GROUP BY label""",
    "multiprobe_filtered": f"""WITH {_V}, {_S}, {_PROBE.replace("near AS (SELECT * FROM met WHERE r <= 1),", "near AS (SELECT * FROM met WHERE r <= 1),").replace("pairs AS (SELECT query_id, doc_id, min(r) AS r FROM near GROUP BY ALL)", "pairs AS (SELECT query_id, doc_id, min(r) AS r FROM near JOIN v ON doc_id = id WHERE label % 2 = 0 GROUP BY ALL)")},
c AS (SELECT query_id, doc_id, bit_count(xor(q.w, d.w))::BIGINT AS distance FROM pairs JOIN reach USING (query_id) JOIN s q ON q.id = query_id JOIN s d ON d.id = doc_id WHERE r <= reach)
SELECT query_id, doc_id, rank::INTEGER AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM c) WHERE rank <= 10""",
    "latency_median": "SELECT count(value) AS n, round(median(value), 6) AS median FROM events",
    "run_violations": """WITH h AS (SELECT CASE WHEN event_type IN (SELECT event_type FROM events WHERE user_id % 2 = 0) THEN user_id ELSE -1 END AS q, event_id AS i, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 40 END AS rank FROM events)
SELECT 'rank not positive' AS rule, q || '/' || i AS key FROM h WHERE rank < 1 UNION ALL SELECT 'rank repeated', q || '/' || rank FROM h WHERE rank IS NOT NULL GROUP BY q, rank HAVING count(*) > 1
UNION ALL SELECT 'ranks mixed with none', q::VARCHAR FROM h GROUP BY q HAVING count(rank) > 0 AND count(rank) < count(*) UNION ALL SELECT DISTINCT 'query unknown', q::VARCHAR FROM h WHERE q NOT IN (SELECT c_custkey FROM customer)""",
    "hashed_embeddings": """WITH RECURSIVE k AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark),
f AS (SELECT item_id, 'tok:' || unnest(t) AS f FROM k UNION ALL SELECT item_id, 'tri:' || w[i:i + 2] FROM (SELECT item_id, w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT item_id, unnest(t) AS w FROM k) WHERE length(w) >= 4)
  UNION ALL SELECT item_id, 'bigram:' || t[i] || '_' || t[i + 1] FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM k)),
h AS (SELECT item_id, 1 + ln(count(*)) AS w, sha256('external-hash-embedding-32d-v1|' || f) AS h FROM f GROUP BY item_id, f),
b AS (SELECT item_id, ('0x' || h[1:2])::INT % 32 AS bucket, sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 1 THEN -w ELSE w END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY 1)
SELECT n.item_id, x::INTEGER AS bucket, round(coalesce(v, 0) / norm, 6) + 0.0 AS value FROM n CROSS JOIN (SELECT unnest(range(0, 32)) AS x) LEFT JOIN b ON b.item_id = n.item_id AND bucket = x""",
    "stored_chunks": """SELECT source AS document_id, doc_id::VARCHAR AS chunk_id, CASE WHEN lang = 'en' AND source = 'src1' THEN 'new' ELSE lang END AS text FROM documents WHERE NOT (source = 'src1' AND lang <> 'en') AND lang <> 'fr'""",
    "manifest_erasure": """SELECT source AS resource_id, count(*) AS chunks FROM documents WHERE source NOT IN ('src1', 'src3') GROUP BY source""",
}
