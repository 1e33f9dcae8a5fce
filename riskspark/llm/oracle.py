"""SQL over the same tables for the operators that it can express."""

CONTROL = "<|im_end|><|im_start|>assistant ok"

OP2 = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
sized AS (SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
  + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM given),
placed AS (SELECT *, sum(n) OVER o AS upto, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS last FROM sized
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = last) AS n_examples
FROM placed GROUP BY conv_id
"""

OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A table of CRC-32 by its bits, and the CRC-32 of the UTF-8 bytes of a text by that table.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"""


def _crc(text: str) -> str:
    code = f"hex(encode({text}))"
    each = f"list_transform(range(CAST(length({code}) // 2 AS BIGINT)), lambda k: CAST('0x' || substr({code}, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {each}), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"


OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc("concat(doc_id, ':', run)")} AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY 1),
form AS (SELECT a, min(b) AS b FROM pairs JOIN best USING (a) WHERE n = top GROUP BY 1),
found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN form.b END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM words LEFT JOIN best ON best.a = word LEFT JOIN form ON form.a = word),
way AS (
  SELECT word, word AS root, form AS next FROM found
  UNION ALL SELECT way.word, way.next, found.form FROM way JOIN found ON found.word = way.next)
SELECT found.word, form, way.root, n, n_near, form_n FROM found JOIN way ON way.word = found.word AND way.next IS NULL
"""

OP12 = rf"""
WITH {_CRC_TABLE},
given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
placed AS (SELECT doc_id, ws, len(ws) AS n, h, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM given),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws
  FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed)),
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM docs WHERE n > 0),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
blocks AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS block FROM same) GROUP BY doc_id, q, block),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM blocks WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM runs) WHERE k = 1),
texts AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM docs LEFT JOIN texts USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_ITEM_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws"

OP13 = f"""
WITH docs AS (SELECT doc_id, {_ITEM_WORDS} FROM documents),
items AS (SELECT item_id, {_ITEM_WORDS} FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0)),
places AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM phrases) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN phrases USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": OP2, "op7_warc": OP7, "op8_ngram_join": OP8, "op10_embeddings": OP10, "op11_spelling": OP11, "op12_periodic": OP12,
        "op13_decontaminate": OP13,
    }
