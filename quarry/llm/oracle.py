"""The same results in SQL, for the operators that SQL can express. Components come from recursive queries."""

from __future__ import annotations

#: Lines with their quote level, passages (runs of one level), their paragraphs and lines, normalised; then links and threads.
QUOTES = r"""WITH RECURSIVE messages AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
lines AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM messages WHERE text IS NOT NULL)),
split AS (SELECT id, n, line, regexp_extract(line, '^[ \t]*((?:[>|][ \t]?)+)', 1) AS marks, regexp_replace(line, '^[ \t]*(?:[>|][ \t]?)+', '') AS rest FROM lines),
levels_of AS (SELECT id, n, CASE WHEN contains(marks, '|') AND contains(rest, '|') THEN 0 ELSE length(regexp_replace(marks, '[^>|]', '', 'g')) END AS level, CASE WHEN contains(marks, '|') AND contains(rest, '|') THEN line ELSE rest END AS line FROM split),
following AS (SELECT *, regexp_matches(lower(line), '^[ \t]*(?:on|le|am|el)[ \t].*(?:wrote|a écrit|schrieb|escribió)[^:]*:[ \t\r]*$') AND level < first_value(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) <> '' THEN level END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS names FROM levels_of),
named AS (SELECT *, sum(CASE WHEN coalesce(names, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS before FROM following),
marked AS (SELECT id, n, level, line, before FROM named WHERE NOT coalesce(names, false)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY n) IS DISTINCT FROM level OR lag(before) OVER (PARTITION BY id ORDER BY n) <> before THEN 1 ELSE 0 END AS new FROM marked)),
paragraphs AS (SELECT *, sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id, run ORDER BY n) AS para FROM runs),
said AS (SELECT id, run, level, true AS whole, string_agg(line, chr(10) ORDER BY n) AS words FROM paragraphs GROUP BY ALL
  UNION ALL SELECT id, run, level, false, string_agg(line, chr(10) ORDER BY n) FROM paragraphs GROUP BY id, run, level, para UNION ALL SELECT id, run, level, false, line FROM paragraphs),
units AS (SELECT id, level, words, bool_or(whole) AS whole FROM (SELECT id, run, level, whole, trim(regexp_replace(lower(words), '\s+', ' ', 'g')) AS words FROM said) WHERE words <> '' GROUP BY id, level, words),
own AS (SELECT DISTINCT conv_id, turn, level, words, whole FROM units JOIN messages USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
near AS (SELECT conv_id, words, min(turn) AS near FROM own WHERE level = 0 GROUP BY 1, 2),
far AS (SELECT q.conv_id, q.words, min(o.conv_id) AS far_conv, arg_min(o.near, o.conv_id) AS far_turn FROM (SELECT DISTINCT conv_id, words FROM own WHERE level > 0) q JOIN near o ON o.words = q.words AND o.conv_id <> q.conv_id GROUP BY 1, 2),
links AS (SELECT q.conv_id, q.turn, level, q.words, whole, CASE WHEN near < q.turn THEN q.conv_id ELSE far_conv END AS to_conv, CASE WHEN near < q.turn THEN near ELSE far_turn END AS to_turn
  FROM own q LEFT JOIN near ON near.conv_id = q.conv_id AND near.words = q.words LEFT JOIN far ON far.conv_id = q.conv_id AND far.words = q.words WHERE level > 0),
replies AS (SELECT conv_id, turn, max(to_turn) AS reply_to FROM links WHERE to_conv = conv_id AND level = 1 GROUP BY 1, 2),
walk AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM replies UNION ALL SELECT w.conv_id, w.turn, r.reply_to, depth + 1 FROM walk w JOIN replies r ON r.conv_id = w.conv_id AND r.turn = w.root),
threads AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY 1, 2),
counts AS (SELECT conv_id, turn, count(DISTINCT CASE WHEN whole THEN level || ' ' || words END) AS n_linked FROM links WHERE to_conv IS NOT NULL GROUP BY 1, 2),
quoted AS (SELECT id, level, run FROM paragraphs WHERE level > 0 GROUP BY ALL HAVING bool_or(trim(line, ' ' || chr(9) || chr(13)) <> '')),
levels AS (SELECT id, CAST(count(*) AS INTEGER) AS n_quotes, CAST(max(level) AS INTEGER) AS max_level FROM quoted GROUP BY 1),
plain AS (SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS words FROM paragraphs GROUP BY 1),
told AS (SELECT m.conv_id, m.turn, role, CASE WHEN n_quotes > 0 THEN plain.words ELSE text END AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_level, 0) AS max_level, coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(root, m.turn) AS thread, coalesce(CAST(depth AS INTEGER), 0) AS depth
FROM messages m LEFT JOIN levels USING (id) LEFT JOIN plain USING (id) LEFT JOIN counts c ON c.conv_id = m.conv_id AND c.turn = m.turn LEFT JOIN replies r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn),
ordered AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, conv_id IS NOT NULL AND turn IS NOT NULL ORDER BY thread, turn, role, text NULLS FIRST) - 1 END AS position FROM told),
parts AS (SELECT conv_id, position // 1000 AS part, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY position) AS conversation FROM ordered WHERE position IS NOT NULL GROUP BY 1, 2)
SELECT ordered.*, parts.conversation FROM ordered LEFT JOIN parts ON parts.conv_id = ordered.conv_id AND parts.part * 1000 = ordered.position"""

#: Twenty bits of the digest at a time become four base32 letters.
PACKAGES = """WITH own AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY sha) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY sha) THEN max(page_id) OVER (PARTITION BY sha) END AS refers_to FROM own"""

COMPONENTS = """reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
lowest AS (SELECT node, min(seen) AS low FROM reach GROUP BY 1)"""

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM rows x JOIN rows y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN lowest ON node = doc_id"""

NEAR = f"""WITH RECURSIVE own AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM own x JOIN own y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.98),
{COMPONENTS}, counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM own LEFT JOIN lowest ON node = vec_id LEFT JOIN counts ON a = vec_id"""

TOP = """WITH own AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM own q JOIN own c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs) WHERE place <= 5"""

#: crc32 of a number's digits bit by bit; of each rebuilt conversation every prefix as one digest.
TRIE = r"""WITH ordered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS heads FROM (SELECT DISTINCT conv_id FROM ordered)),
parts AS (SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN ordered r ON r.conv_id = c.base AND place < heads UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN ordered r ON r.conv_id = c.conv_id AND place >= heads),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(length(role) || ':' || role || text) AS key, length(text) AS size FROM parts),
paths AS (SELECT conv_id, depth, size, sha256(string_agg(key, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS path, depth = count(*) OVER (PARTITION BY conv_id) AS last FROM turns
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM convs),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM paths),
nodes AS (SELECT node, depth, count(*) AS n_convs, min(size) AS size, sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM named GROUP BY 1, 2),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
leaves AS (SELECT l.* FROM linked l LEFT JOIN children c USING (node, depth) WHERE n_children IS NULL),
leaf_counts AS (SELECT a.node, a.depth, count(*) AS n_leaves FROM leaves l JOIN named a ON a.conv_id = l.node AND a.depth <= l.depth GROUP BY 1, 2),
saved AS (SELECT a.node, a.depth, CAST(sum((n.n_convs - 1) * n.size) AS BIGINT) AS saved_tokens FROM nodes n JOIN named a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY 1, 2)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256 FROM linked LEFT JOIN children USING (node, depth) JOIN leaf_counts USING (node, depth) JOIN saved USING (node, depth)"""

RANKED = r"""WITH doc_words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT row, doc_id, CAST(len(t) AS BIGINT) AS n FROM doc_words),
totals AS (SELECT count(*) FILTER (n > 0) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
entries AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM doc_words) GROUP BY 1, 2),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(min(coalesce(text, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM entries, totals GROUP BY term, n_docs),
scores AS (SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN entries USING (term) JOIN sizes USING (row), totals WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

ORACLE_SQL = {"op1_quotation_links": QUOTES, "op3_warc_packages": PACKAGES, "op6_ngram_jaccard_join": JACCARD, "op7_projection_forest": NEAR, "op9_exact_top_k": TOP, "op12_prefix_trie": TRIE, "op13_ranked_search": RANKED}
