"""DuckDB SQL for the corpus queries whose rows SQL can state."""

# Size classes, shares and odds are computed in the order of the DataFrame code, so that doubles agree.
MIXING = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w,
         2 * source_size::DOUBLE AS most FROM sizes
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size::DOUBLE) OVER ()
    - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), goal AS (
  SELECT source, source_size, coalesce(least(most, w * max(CASE WHEN level * w <= most THEN level END) OVER ()), most) AS target FROM l
), classes AS (
  SELECT source, pow(2.0::DOUBLE, length(bin(size)) // 2) AS class, sum(size)::DOUBLE AS words FROM base WHERE size > 0 GROUP BY 1, 2
), f AS (
  SELECT c.source, class, (target
    - 2 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(class * words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
), factors AS (
  SELECT source, max(CASE WHEN f * class <= 2 THEN f END) AS factor FROM f GROUP BY source
), e AS (
  SELECT b.*, source_size, target,
    CASE WHEN size > 0 THEN coalesce(least(2.0::DOUBLE, factor * pow(2.0::DOUBLE, length(bin(size)) // 2)), 2.0) ELSE 0.0 END::DOUBLE AS copies,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source LEFT JOIN factors x ON b.source IS NOT DISTINCT FROM x.source
), q AS (
  SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS odds FROM e
), r AS (
  SELECT *, CASE WHEN odds > 0 THEN (u / (1 - u)) * ((1 - odds) / odds) END AS q FROM q
), ranked AS (
  SELECT *, q / (1 + q) AS rank FROM r
), cut AS (
  SELECT source, target - sum(whole * size) AS open FROM ranked GROUP BY source, target
), keys AS (
  SELECT source, rank, doc_id, size, sum(size) AS words FROM ranked WHERE rank IS NOT NULL GROUP BY ALL
), mids AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) - words + words / 2.0::DOUBLE AS mid FROM keys
), more AS (
  SELECT m.source, rank, doc_id, size FROM mids m JOIN cut c ON m.source IS NOT DISTINCT FROM c.source WHERE mid <= open
)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(r.size * (r.whole + CASE WHEN m.rank IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM ranked r LEFT JOIN more m ON r.source IS NOT DISTINCT FROM m.source AND r.rank = m.rank
  AND r.doc_id IS NOT DISTINCT FROM m.doc_id AND r.size = m.size
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM shingles GROUP BY doc_id
), both_sides AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_sides x JOIN sets p ON p.doc_id = x.a JOIN sets q ON q.doc_id = x.b WHERE 100 * x.n >= 85 * (p.n + q.n - x.n)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id JOIN least l ON l.node = d.doc_id
"""

PASSAGES = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT p.doc_id, p.size, p.i, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.s = p.s
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

#: op13: every turn is <|im_start|> role \n content <|im_end|> \n, with `\` doubled and `<|` as `<\|`
#: (and a newline in a role as `\n`); the loss mask covers assistant contents.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
