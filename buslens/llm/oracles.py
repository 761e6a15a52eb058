"""SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Length of the fixed marks: '<|im_start|>' 12, 'assistant' 9, 'system' 6, 'user name=' 10, line ends 1, '<|im_end|>' 10.
ORACLES["op10_perspectives"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), views AS (
  SELECT t.*, s.speaker,
    '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.speaker THEN 'assistant'
      ELSE 'user name=' || t.role END || chr(10) AS header
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS segment,
    row_number() OVER w - 1 AS position,
    coalesce(sum(length(header) + length(text) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM views WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, speaker, turn, position,
  CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS chat_role,
  CASE WHEN role <> 'system' AND role <> speaker THEN role END AS name,
  segment, CAST(start AS BIGINT) AS start,
  CASE WHEN role = speaker THEN CAST(start + length(header) AS BIGINT) END AS mask_start,
  CASE WHEN role = speaker THEN CAST(start + length(segment) AS BIGINT) END AS mask_end,
  role = speaker AS in_loss
FROM placed
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op4_repeats"] = f"""
WITH docs AS (
  SELECT doc_id, {WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM docs WHERE len(words) >= 20)
), firsts AS (
  SELECT passage, min((doc_id, start)) AS earliest FROM windows GROUP BY passage
), repeated AS (
  SELECT doc_id, list(DISTINCT gone) AS gone
  FROM (SELECT w.doc_id, unnest(range(w.start, w.start + 20)) AS gone
        FROM windows w JOIN firsts f ON w.passage = f.passage AND (w.doc_id, w.start) <> f.earliest)
  GROUP BY doc_id
), outcome AS (
  SELECT d.doc_id, d.words, coalesce(r.gone, []) AS gone FROM docs d LEFT JOIN repeated r ON d.doc_id = r.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN words
    ELSE [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM outcome
"""

ORACLES["op8_near_duplicates"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS} AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])) END AS shingles
  FROM docs WHERE len(words) > 0
), classes AS (
  SELECT row_number() OVER () AS class, shingles, min(doc_id) AS first, count(*) AS copies FROM sets GROUP BY shingles
), members AS (
  SELECT class, unnest(shingles) AS shingle FROM classes
), common AS (
  SELECT a.class AS x, b.class AS y, count(*) AS n
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.class < b.class GROUP BY ALL
), near AS (
  SELECT x, y FROM common JOIN classes a ON a.class = x JOIN classes b ON b.class = y
  WHERE n * 5 >= 4 * (len(a.shingles) + len(b.shingles) - n)
), links AS (
  SELECT x, y FROM near UNION ALL SELECT y, x FROM near
), reached AS (
  SELECT class AS x, class AS y FROM classes
  UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), groups AS (
  SELECT r.x AS class, min(c.first) AS class_id FROM reached r JOIN classes c ON c.class = r.y GROUP BY r.x
), counted AS (
  SELECT c.class, c.shingles, c.copies - 1 + coalesce(sum(o.copies), 0) AS n_links
  FROM classes c LEFT JOIN links l ON l.x = c.class LEFT JOIN classes o ON o.class = l.y
  GROUP BY c.class, c.shingles, c.copies
)
SELECT s.doc_id, g.class_id, CAST(k.n_links AS BIGINT) AS n_links
FROM sets s JOIN counted k ON s.shingles = k.shingles JOIN groups g ON g.class = k.class
UNION ALL SELECT doc_id, doc_id, 0 FROM docs WHERE len(words) = 0
"""

ORACLES["op2_cover_tree"] = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Lloyd rounds with full scans: each part meets every entry of its position."""
    distance = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v)"
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT row_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS r(p)
), book0 AS (
  SELECT p, row_id - 1 AS entry, v FROM parts WHERE row_id <= {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f""", near{k} AS MATERIALIZED (
  SELECT x.row_id, x.p, min(({distance}, c.entry)) AS best FROM parts x JOIN book{k} c ON x.p = c.p GROUP BY x.row_id, x.p
)""")
        if k < rounds:
            steps.append(f""", means{k} AS (
  SELECT p, entry, list(floor(total / many) ORDER BY place) AS v FROM (
    SELECT n.p, n.best[2] AS entry, place, sum(x.v[place]) AS total, count(*) AS many
    FROM near{k} n JOIN parts x ON n.row_id = x.row_id AND n.p = x.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS place)
    GROUP BY n.p, n.best[2], place)
  GROUP BY p, entry
), book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.entry = m.entry
)""")
    steps.append(f""", final AS (
  SELECT row_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM near{rounds} GROUP BY row_id
), digest AS (
  SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN v], ','), ',' ORDER BY p, entry)) AS codebooks_sha256
  FROM book{rounds}
)
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN final f ON k.row_id = f.row_id, digest d
""")
    return "".join(steps)


ORACLES["op12_vector_codes"] = _codes_sql()

# CRC-32 of a word from its bytes, with the table of the reversed polynomial 0xEDB88320.
ORACLES["op13_resampling"] = r"""
WITH crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
  FROM range(256) AS r(n)
), words AS (
  SELECT 'document' AS kind, doc_id AS id, WORDS AS words FROM documents
  UNION ALL SELECT 'target', item_id, WORDS FROM benchmark
), each AS (
  SELECT kind, id, unnest(words) AS word FROM words
), distinct_words AS (
  SELECT DISTINCT word, hex(encode(word)) AS digits FROM each
), buckets AS (
  SELECT word, xor(list_reduce(
      list_concat([4294967295], [CAST('0x' || digits[2 * k + 1 : 2 * k + 2] AS BIGINT) FOR k IN range(len(digits) // 2)]),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc
), counts AS (
  SELECT bucket, count(*) FILTER (kind = 'document') AS s, count(*) FILTER (kind = 'target') AS t
  FROM each JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts, totals
), weighed AS (
  SELECT id, sum(gain) AS weight FROM each JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 'document' GROUP BY id
), scored AS (
  SELECT d.doc_id, len(w.words) AS n_features, coalesce(g.weight, 0) AS weight,
    coalesce(g.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d JOIN words w ON w.kind = 'document' AND w.id = d.doc_id LEFT JOIN weighed g ON g.id = d.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank
FROM placed
""".replace("WORDS", r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""")
