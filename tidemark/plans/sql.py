"""SQL of the queries, and reply texts that both sides make up from the tables."""

# Replies as a model could give them; both engines read these expressions.
QA_REPLY = (
    "concat('Sure. [{\"question\": \"q', CAST(doc_id AS STRING), '\", \"ground_truth\": \"', CAST(n_chars AS STRING), '\"}, "
    "{\"question\": \"', CASE WHEN doc_id % 5 = 0 THEN 'broken ] here' ELSE 'lang' END, '\", \"ground truth\": \"', lang, '\",}, ] done')"
)
JUDGE_REPLY = (
    "concat(' Answer Relevance: 0.', CAST(turn % 10 AS STRING), CASE WHEN conv_id % 7 = 0 THEN '' ELSE concat(' Accuracy: 1.0 Completeness: 0.', "
    "CAST(conv_id % 10 AS STRING), ' Clarity: 0.5 Semantic Similarity Score: ', CAST(conv_id % 101 AS STRING), '%') END, ' Fine. ')"
)
PLAN_REPLY = (
    "CASE WHEN turn % 3 = 0 THEN concat('{\"tool_calls\": [{\"name\": \"t', CAST(conv_id AS STRING), '\", \"arguments\": {\"a\": 1}}, {\"name\": \"u\"}]}') "
    "WHEN turn % 3 = 1 THEN concat('{\"final_answer\": \"', role, '\"}') ELSE concat('plain ', role) END"
)

KNN_L2 = """
SELECT e.vec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1),
       lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))), 6) AS distance
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY distance, vec_id LIMIT 5
"""

_NEAR = """near AS (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS ord
  FROM (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(q.embedding) + 1),
               lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))) AS distance
        FROM embeddings e, embeddings q WHERE {asked})
  QUALIFY ord <= 5
)"""

KNN_L2_BATCH = f"WITH {_NEAR.format(asked='q.vec_id % 25 = 0')} SELECT query_id, vec_id, round(distance, 6) AS distance, ord FROM near"

SPLIT_TEXT = r"""
WITH RECURSIVE ends AS (
  SELECT doc_id, text, 0 AS chunk_id, 0::BIGINT AS start, length(text) AS n FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, chunk_id + 1, CASE WHEN e - 100 > start THEN e - 100 ELSE start + 1000 END, n
  FROM (SELECT *, CASE WHEN start + 1000 >= n THEN n
                       WHEN run = 1000 THEN start + 1000 ELSE start + 1000 - run END AS e
        FROM (SELECT *, length(regexp_extract(substring(text, start + 2, 1000), '[^ \n\t]*$')) AS run FROM ends))
  WHERE CASE WHEN e - 100 > start THEN e - 100 ELSE start + 1000 END < n
)
SELECT doc_id, chunk_id, CASE WHEN start + 1000 >= n THEN substring(text, start + 1, n - start)
  ELSE substring(text, start + 1, CASE WHEN run = 1000 THEN 1000 ELSE 1000 - run END) END AS content
FROM (SELECT *, length(regexp_extract(substring(text, start + 2, 1000), '[^ \n\t]*$')) AS run FROM ends)
"""

CHUNK_DOCUMENT = """
SELECT doc_id, i::INT AS chunk_id, substring(text, i * 450 + 1, 500) AS content
FROM documents, unnest(range(0, CASE WHEN length(text) > 0 THEN (length(text) - 1) // 450 + 1 ELSE 0 END)) AS t(i)
"""

CHUNK_CORPUS = r"""
WITH whole AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents)
SELECT i AS chunk_id, substring(body, i * 450 + 1, 500) AS content
FROM whole, unnest(range(0, (length(body) - 1) // 450 + 1)) AS t(i)
"""

CSV_LINEARIZE = """
SELECT n_nationkey, concat_ws(' | ', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR) AS content FROM nation
"""

NONBLANK_WITH_ID = r"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id, length(text) AS n
FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\s*')
"""

UPSERT_BATCH_NUMBERS = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS batch FROM documents"

UPSERT_BY_KEY = """
SELECT doc_id, CASE WHEN lang = 'en' THEN -n_chars ELSE n_chars END AS n_chars, lang FROM documents
UNION ALL SELECT -1 - doc_id, n_chars, lang FROM documents WHERE lang <> 'en'
"""

HEAD_LIMIT = "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 7"

STRIP_TOKENIZE = r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM documents"

TEMPLATE_FILL = r"""
SELECT item_id, concat('Write question and answer pairs that the text below answers. Reply with a JSON array only, like', chr(10),
  '[{"question": "...", "ground_truth": "..."}]', chr(10), chr(10), 'Text:', chr(10), text) AS prompt FROM benchmark
"""

HASH_EMBED = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM terms GROUP BY ALL
)
SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM counts
"""

_BM25 = r"""texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS terms FROM documents
), size AS (
  SELECT count(*) AS n, avg(len(terms)) AS mean FROM texts
), counts AS (
  SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM texts
), tf AS (
  SELECT doc_id, length, term, count(*) AS tf FROM counts GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
           / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL
), hits AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS ord
  FROM scored QUALIFY ord <= 5
)"""

BM25_TOPK = f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, ord FROM hits"

FUSE_HYBRID = f"""
WITH {_NEAR.format(asked='q.vec_id IN (SELECT item_id FROM benchmark)')}, {_BM25}, semantic AS (
  SELECT query_id, text AS content, arg_max(distance, ord) AS s, min(ord) AS s_ord
  FROM near JOIN documents ON vec_id = doc_id GROUP BY ALL
), keyword AS (
  SELECT item_id AS query_id, text AS content, sum(score) AS w, min(ord) AS w_ord
  FROM hits JOIN documents USING (doc_id) GROUP BY ALL
), fused AS (
  SELECT query_id, content, 0.5::DOUBLE * coalesce(s, 0) + 0.5::DOUBLE * coalesce(w, 0) AS score,
         coalesce(s_ord, w_ord + 4294967296) AS place
  FROM semantic FULL JOIN keyword USING (query_id, content)
)
SELECT query_id, md5(content) AS content_md5, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS ord
FROM fused QUALIFY ord <= 5
"""

_BATCHES = r"""lined AS (
  SELECT doc_id, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS n,
         row_number() OVER (ORDER BY doc_id) AS place
  FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\s*')
), walk AS (
  SELECT place, doc_id, n, n AS held, 0::BIGINT AS batch FROM lined WHERE place = 1
  UNION ALL
  SELECT r.place, r.doc_id, r.n, CASE WHEN w.held + r.n > 10000 THEN r.n ELSE w.held + r.n END,
         w.batch + CASE WHEN w.held + r.n > 10000 THEN 1 ELSE 0 END
  FROM walk w JOIN lined r ON r.place = w.place + 1
)"""

GREEDY_BATCHES = f"WITH RECURSIVE {_BATCHES} SELECT doc_id, batch FROM walk"

BATCH_SIZES = f"WITH RECURSIVE {_BATCHES} SELECT batch, count(*) AS n, sum(n)::BIGINT AS n_chars FROM walk GROUP BY batch"

_PAIRS = rf"""found AS (
  SELECT doc_id AS batch, regexp_replace(regexp_extract({QA_REPLY}, '(?s)\[.*?\]'), ',(\s*[\]}}])', '\1', 'g') AS body FROM documents
), pairs AS (
  SELECT batch, i - 1 AS pos, json_extract(body, '$[' || (i - 1) || ']') AS pair
  FROM (SELECT batch, body FROM found WHERE json_valid(body)), unnest(range(1, json_array_length(body)::BIGINT + 1)) AS t(i)
)"""

QA_EXTRACT = f"""
WITH {_PAIRS}
SELECT batch, pos, pair->>'question' AS question, coalesce(pair->>'ground_truth', pair->>'ground truth') AS "ground truth" FROM pairs
"""

QA_CAP = f"""
WITH {_PAIRS}
SELECT pair->>'question' AS question, coalesce(pair->>'ground_truth', pair->>'ground truth') AS "ground truth"
FROM pairs ORDER BY batch, pos LIMIT 50
"""

_TURNS = """turns AS (
  SELECT conv_id, turn, text AS truth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations
  QUALIFY answer IS NOT NULL
)"""

BLEU4 = rf"""
WITH {_TURNS}, tokens AS (
  SELECT conv_id, turn, regexp_extract_all(truth, '\S+') AS r, regexp_extract_all(answer, '\S+') AS c FROM turns
), grams AS (
  SELECT conv_id, turn, o, side, list_aggregate(ts[i:i + o - 1], 'string_agg', ' ') AS gram
  FROM (SELECT conv_id, turn, 'c' AS side, c AS ts FROM tokens UNION ALL SELECT conv_id, turn, 'r', r FROM tokens),
       unnest([1, 2, 3, 4]) AS a(o), unnest(range(1, len(ts) - o + 2)) AS b(i)
), counts AS (
  SELECT conv_id, turn, o, gram, count(*) FILTER (side = 'c') AS x, count(*) FILTER (side = 'r') AS y FROM grams GROUP BY ALL
), hits AS (
  SELECT conv_id, turn, o, sum(least(x, y))::DOUBLE AS m FROM counts GROUP BY ALL
), orders AS (
  SELECT conv_id, turn, o, len(c)::DOUBLE AS nc, len(r)::DOUBLE AS nr, coalesce(m, 0) AS m,
         greatest(1, len(c) - o + 1)::DOUBLE AS size,
         sum(CASE WHEN coalesce(m, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY o) AS v
  FROM tokens CROSS JOIN unnest([1, 2, 3, 4]) AS a(o) LEFT JOIN hits USING (conv_id, turn, o)
)
SELECT conv_id, turn, round(CASE WHEN max(m) FILTER (o = 1) > 0
  THEN (CASE WHEN nc > nr THEN 1 WHEN nc > 0 THEN exp(1 - nr / nc) ELSE 0 END)
       * exp(sum(0.25::DOUBLE * CASE WHEN m > 0 THEN ln(m / size) WHEN nc > 1 THEN ln(ln(nc) / (5 * pow(2, v)) / size) ELSE 0 END))
  ELSE 0 END, 6) AS bleu
FROM orders GROUP BY conv_id, turn, nc, nr
"""

_SCORES = rf"""{_TURNS}, replies AS (SELECT conv_id, turn, truth, answer, {JUDGE_REPLY} AS reply FROM turns),
lines AS (
  SELECT *, nullif(regexp_extract(reply, 'Answer Relevance:\s*([0-1](?:\.\d+)?)', 1), '')::DOUBLE AS a,
    nullif(regexp_extract(reply, 'Accuracy:\s*([0-1](?:\.\d+)?)', 1), '')::DOUBLE AS b,
    nullif(regexp_extract(reply, 'Completeness:\s*([0-1](?:\.\d+)?)', 1), '')::DOUBLE AS c,
    nullif(regexp_extract(reply, 'Clarity:\s*([0-1](?:\.\d+)?)', 1), '')::DOUBLE AS d,
    nullif(regexp_extract(reply, 'Semantic Similarity Score:\s*(\d{{1,3}})%', 1), '')::DOUBLE AS e FROM replies
), scores AS (
  SELECT conv_id, turn, coalesce(a, 0) AS answer_relevance, CASE WHEN a + b IS NULL THEN 0 ELSE b END AS accuracy,
    CASE WHEN a + b + c IS NULL THEN 0 ELSE c END AS completeness, CASE WHEN a + b + c + d IS NULL THEN 0 ELSE d END AS clarity,
    CASE WHEN a + b + c + d + e IS NULL THEN 0 ELSE e END AS semantic_similarity, trim(reply) AS explanation FROM lines
)"""

JUDGE_SCORES = f"WITH {_SCORES} SELECT * FROM scores"

EVAL_METRICS = f"""
WITH {_SCORES}, bleus AS ({BLEU4.strip().replace('round(', '(').replace(', 6) AS bleu', ') AS bleu')}), one AS (
  SELECT avg(bleu) AS avg_bleu, avg(answer_relevance) AS avg_answer_relevance, avg(accuracy) AS avg_accuracy,
    avg(completeness) AS avg_completeness, avg(clarity) AS avg_clarity, avg(semantic_similarity) AS avg_semantic_similarity,
    max(CASE WHEN semantic_similarity >= 80 THEN 1 ELSE 0 END)::DOUBLE AS precision,
    avg(CASE WHEN semantic_similarity >= 80 THEN 1 ELSE 0 END) AS recall
  FROM scores JOIN bleus USING (conv_id, turn)
)
SELECT round(avg_bleu, 6) AS avg_bleu, round(avg_answer_relevance, 6) AS avg_answer_relevance, round(avg_accuracy, 6) AS avg_accuracy,
  round(avg_completeness, 6) AS avg_completeness, round(avg_clarity, 6) AS avg_clarity,
  round(avg_semantic_similarity, 6) AS avg_semantic_similarity, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN recall > 0 THEN 2 * recall / (1 + recall) WHEN recall = 0 THEN 0 END, 6) AS f1_score
FROM one
"""

TOOL_PLAN_PARSE = f"""
WITH replies AS (SELECT conv_id, turn, {PLAN_REPLY} AS reply FROM conversations),
plans AS (SELECT *, CASE WHEN json_valid(reply) THEN reply END AS plan FROM replies)
SELECT conv_id, turn,
  CASE WHEN json_exists(plan, '$.tool_calls') THEN NULL ELSE coalesce(json_extract_string(plan, '$.final_answer'), reply) END AS final,
  coalesce(json_array_length(plan, '$.tool_calls')::BIGINT, 0) AS n_calls,
  json_extract_string(plan, '$.tool_calls[0].name') AS first_name,
  CASE WHEN json_exists(plan, '$.tool_calls') THEN coalesce(json_extract(plan, '$.tool_calls[0].arguments')::VARCHAR, '{{}}') END AS first_arguments,
  CASE WHEN json_exists(plan, '$.tool_calls') THEN coalesce(json_extract(plan, '$.tool_calls[1].arguments')::VARCHAR, '{{}}') END AS second_arguments
FROM plans
"""

AGENT_LOOP = r"""
SELECT conv_id, len(regexp_extract_all(arg_min(text, turn), '\S+'))::VARCHAR AS answer, count(*) + 1 AS n_messages
FROM conversations GROUP BY conv_id
"""

# Unit vectors of hashed terms, dense, in single precision as an index holds them.
_HASHED = r"""{name}_counts AS (
  SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
  FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS term FROM {table}) GROUP BY ALL
), {name}_unit AS (
  SELECT id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT AS w FROM {name}_counts
), {name} AS (
  SELECT ids.id, list(coalesce(w, 0)::DOUBLE ORDER BY s) AS v
  FROM (SELECT {id} AS id FROM {table}) ids CROSS JOIN unnest(range(64)) AS r(s) LEFT JOIN {name}_unit u ON u.id = ids.id AND u.slot = s
  GROUP BY ids.id
)"""

_DOCS_HASHED = _HASHED.format(name="doc_vectors", id="doc_id", text="text", table="documents")
_NEAR_HASHED = """near AS (
  SELECT q.id AS query_id, d.id AS doc_id,
         list_sum(list_transform(range(1, 65), lambda i: pow(d.v[i] - q.v[i], 2))) AS distance,
         row_number() OVER (PARTITION BY q.id ORDER BY distance, d.id) AS ord
  FROM doc_vectors d, asked_vectors q QUALIFY ord <= 5
), semantic AS (
  SELECT query_id, text AS content, distance AS score, ord FROM near JOIN documents USING (doc_id)
)"""

_ANSWERED = r"""
SELECT item_id AS query_id, count(content) AS n_docs, md5(coalesce(string_agg(content, chr(10) ORDER BY ord), '')) AS docs_md5,
       substr(concat('Context:', chr(10), coalesce(string_agg(trim(regexp_replace(content, '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY ord), ''),
                     chr(10), chr(10), 'Question: ', benchmark.text), 1, 256) AS answer
FROM benchmark LEFT JOIN {hits} ON query_id = item_id GROUP BY item_id, benchmark.text
"""


def _asked(text: str) -> str:
    return _HASHED.format(name="asked_vectors", id="item_id", text=text, table="benchmark")


RAG_STANDARD = f"WITH {_DOCS_HASHED}, {_asked('text')}, {_NEAR_HASHED} {_ANSWERED.format(hits='semantic')}"

# the passage that the stub makes up is the question's beginning
RAG_HYDE = f"WITH {_DOCS_HASHED}, {_asked('substr(text, 1, 256)')}, {_NEAR_HASHED} {_ANSWERED.format(hits='semantic')}"

RAG_HYBRID = f"""
WITH {_DOCS_HASHED}, {_asked('text')}, {_NEAR_HASHED}, {_BM25}, by_text AS (
  SELECT query_id, content, arg_max(score, ord) AS s, min(ord) AS s_ord FROM semantic GROUP BY ALL
), keyword AS (
  SELECT item_id AS query_id, text AS content, sum(score) AS w, min(ord) AS w_ord FROM hits JOIN documents USING (doc_id) GROUP BY ALL
), fused AS (
  SELECT query_id, content, row_number() OVER (PARTITION BY query_id
           ORDER BY 0.5::DOUBLE * coalesce(s, 0) + 0.5::DOUBLE * coalesce(w, 0) DESC, coalesce(s_ord, w_ord + 4294967296)) AS ord
  FROM by_text FULL JOIN keyword USING (query_id, content) QUALIFY ord <= 5
)
{_ANSWERED.format(hits='fused')}
"""

QA_GENERATE = rf"""
WITH RECURSIVE {_BATCHES}, texts AS (
  SELECT batch, string_agg(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), ' ' ORDER BY place) AS t
  FROM walk JOIN documents USING (doc_id) GROUP BY batch
)
SELECT substr(t, 1, 40) AS question, length(t)::VARCHAR AS "ground truth" FROM texts
UNION ALL SELECT right(t, 40), md5(t) FROM texts
"""

FIXED_JUDGE = "Answer Relevance: 0.75 Accuracy: 1.0 Completeness: 0.5 Clarity: 0.25 Semantic Similarity Score: 90%"

EVALUATE_ANSWERS = f"""
WITH bleus AS ({BLEU4.strip().replace('round(', '(').replace(', 6) AS bleu', ') AS bleu')})
SELECT round(avg(bleu), 6) AS avg_bleu, 0.75::DOUBLE AS avg_answer_relevance, 1.0::DOUBLE AS avg_accuracy, 0.5::DOUBLE AS avg_completeness,
  0.25::DOUBLE AS avg_clarity, 90.0::DOUBLE AS avg_semantic_similarity, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score,
  count(*) AS evaluation_size FROM bleus
"""

LOAD_FOLDER_CSV = "SELECT concat_ws(' | ', s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR) AS content FROM supplier"

LOAD_RANGED_CSV = """
WITH loaded AS (SELECT concat_ws(' | ', doc_id::VARCHAR, lang, NULLIF(text, ''), n_chars::VARCHAR) AS content FROM documents)
SELECT md5(content) AS content_md5, length(content)::BIGINT AS n, NULL::VARCHAR AS error FROM loaded
"""

LOAD_SINGLE_CSV = r"""
SELECT 0::BIGINT AS chunk_id, string_agg(concat_ws(' | ', r_regionkey::VARCHAR, r_name), chr(10) ORDER BY r_regionkey) AS content FROM region
"""

LOAD_PDF_PAGES = r"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), pages AS (
  SELECT doc_id, i::BIGINT AS page, lines[40 * i + 1:40 * i + 40] AS shown FROM docs, unnest(range((len(lines) - 1) // 40 + 1)) AS t(i)
), texts AS (
  SELECT doc_id, page, trim(array_to_string(list_transform(list_filter(shown, lambda x: trim(x, ' ') <> ''), lambda x: rtrim(x, ' ')), chr(10)), ' ') AS content FROM pages
)
SELECT doc_id, page, md5(content) AS content_md5, length(content)::BIGINT AS n_chars FROM texts
"""

MANAGED_INDEX_UPSERTS = """
SELECT doc_id AS id, md5(CASE lang WHEN 'de' THEN reverse(text) WHEN 'en' THEN 'en' ELSE text END) AS content_md5, lang FROM documents
UNION ALL SELECT -1 - doc_id, md5(text), lang FROM documents WHERE lang = 'fr'
"""

BM25_STORED = BM25_TOPK

BRACKET_REPLY = (
    """concat('Sure: ', to_json(array(named_struct('question', substring(text, 1, 60), 'ground_truth',"""
    """ concat('] [', substring(text, 1, 200), ' " ]')))), ' and [more].')"""
)
QA_LENIENT = """
SELECT doc_id AS batch, substring(text, 1, 60) AS question, '] [' || substring(text, 1, 200) || ' " ]' AS "ground truth" FROM documents
"""

EVENT_SESSIONS = """
WITH after AS (
  SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM after
)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS n, round(sum(value), 4) AS total
FROM numbered GROUP BY user_id, s
"""

EVENT_WINDOWS = """
WITH placed AS (
  SELECT event_type, value, epoch_us(ts) // 7200000000 * 7200000000 - k * 7200000000 AS start
  FROM events, unnest([0, 1, 2]) AS t(k) WHERE ts IS NOT NULL AND event_type IS NOT NULL
)
SELECT event_type, start, start + 21600000000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM placed GROUP BY event_type, start
"""

KEPT_REPLIES = """
WITH asked AS (
  SELECT item_id AS id, text AS prompt FROM benchmark
  UNION ALL SELECT -1 - doc_id, split_part(text, chr(10), 1) FROM documents
)
SELECT id, md5(substring(prompt, 1, 100)) AS reply_md5, (SELECT count(DISTINCT prompt) FROM asked WHERE prompt IS NOT NULL) AS calls FROM asked
"""

SHORTEN_TEXT = r"""
WITH flat AS (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract(substr(t, 1, 795), '^(.*) ', 1) AS kept FROM flat
), shorts AS (
  SELECT doc_id, CASE WHEN length(t) <= 800 THEN t WHEN kept = '' THEN '[...]' ELSE kept || ' [...]' END AS short FROM cut
)
SELECT doc_id, md5(short) AS short_md5, length(short)::BIGINT AS n_chars FROM shorts
"""

_CHUNKS_NEAR = f"""chunks AS MATERIALIZED ({CHUNK_CORPUS}), {_HASHED.format(name="chunk_vectors", id="chunk_id", text="content", table="chunks")}, {_asked("text")},
near AS (
  SELECT q.id AS query_id, d.id AS chunk_id,
         list_sum(list_transform(range(1, 65), lambda i: pow(d.v[i] - q.v[i], 2))) AS distance,
         row_number() OVER (PARTITION BY q.id ORDER BY distance, d.id) AS ord
  FROM chunk_vectors d, asked_vectors q QUALIFY ord <= 5
), found AS (
  SELECT query_id, content, ord FROM near JOIN chunks USING (chunk_id)
)"""
_CONTEXT = r"""concat('Context:', chr(10), coalesce(string_agg(trim(regexp_replace(content, '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY ord), ''),
  chr(10), chr(10), 'Question: ', benchmark.text)"""

INDEX_THEN_INFER = f"""
WITH {_CHUNKS_NEAR}
SELECT item_id AS query_id, md5(coalesce(string_agg(content, chr(10) ORDER BY ord), '')) AS docs_md5, md5(substr({_CONTEXT}, 1, 4000)) AS answer_md5
FROM benchmark LEFT JOIN found ON query_id = item_id GROUP BY item_id, benchmark.text
"""

RUN_RAG_ANSWERS = f"""
WITH {_CHUNKS_NEAR}
SELECT item_id, benchmark.text AS question, substr({_CONTEXT}, 1, 256) AS answer
FROM benchmark LEFT JOIN found ON query_id = item_id AND ord <= 3 GROUP BY item_id, benchmark.text
"""

AGENT_ROUNDS = AGENT_LOOP

KNN_RINGS = KNN_L2_BATCH
