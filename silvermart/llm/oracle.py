"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

# Every word sequence of 35 words is written out and counted.
SUBSTRING_DEDUP = f"""
WITH split AS MATERIALIZED (
    SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents
), win AS MATERIALIZED (
    SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s
    FROM split, unnest(generate_series(1, len(words) - 34)) AS t(i)
), gone AS MATERIALIZED (
    SELECT DISTINCT doc_id, i + k AS p
    FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s),
      generate_series(0, 34) AS t(k)
), removed AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(words[p], ' ' ORDER BY p) AS text
    FROM (SELECT doc_id, words, p FROM split, unnest(generate_series(1, len(words))) AS t(p))
    ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Every pair that shares a shingle is counted, then every link is followed.
JACCARD_JOIN = f"""
WITH RECURSIVE split AS MATERIALIZED (
    SELECT doc_id, {WORDS.format(
        text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz')"
    )} AS words FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
    FROM split, unnest(generate_series(1, greatest(len(words) - 3, least(len(words), 1)))) AS t(i)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT x, y FROM (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
    ) JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, least) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT y, least FROM reach JOIN links ON x = reach.doc_id WHERE least < y
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(least) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

TREE_DEDUP = """
WITH texts AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)"""

# crc32 byte by byte and bit by bit, of a text of ASCII characters.
CRC32 = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(value: str) -> str:
    written = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({written}) || ':' || {written} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# Levels of the trees of all languages, of the tree over their roots, and every leaf's way up.
MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf('n_chars')} AS leaf,
      CASE WHEN {CRC32.format(text='CAST(doc_id AS VARCHAR)')} % 7 = 0
        THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS changed
    FROM documents
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS p FROM leaves
), tree(g, level, p, h, n) AS (
    SELECT g, 0, p, leaf, count(*) OVER (PARTITION BY g) FROM placed
    UNION ALL
    SELECT g, any_value(level) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)),
      any_value(n + 1) // 2
    FROM tree WHERE n > 1 GROUP BY g, p // 2
), groups AS MATERIALIZED (
    SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p
    FROM tree WHERE n = 1
), upper_tree(level, p, h, n) AS (
    SELECT 0, p, subroot, count(*) OVER () FROM groups
    UNION ALL
    SELECT any_value(level) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value(n + 1) // 2
    FROM upper_tree WHERE n > 1 GROUP BY p // 2
), nodes AS MATERIALIZED (
    SELECT g, level, p, h FROM tree
    UNION ALL
    SELECT NULL, level, p, h FROM upper_tree
), root AS (
    SELECT max(level) AS height, max_by(h, level) AS root FROM upper_tree
), way AS MATERIALIZED (
    SELECT doc_id, leaf, 1 AS part, g, level, placed.p >> level AS p
    FROM placed JOIN groups USING (g), unnest(generate_series(0, height - 1)) AS t(level)
    UNION ALL
    SELECT doc_id, leaf, 2, NULL, level, groups.p >> level
    FROM placed JOIN groups USING (g), root, unnest(generate_series(0, root.height - 1)) AS t(level)
), steps AS MATERIALIZED (
    SELECT doc_id, leaf, way.p % 2 = 1 AS on_left, coalesce(h, '') AS sibling,
      row_number() OVER (PARTITION BY doc_id, leaf ORDER BY part, way.level) AS i
    FROM way LEFT JOIN nodes
      ON nodes.g IS NOT DISTINCT FROM way.g AND nodes.level = way.level AND nodes.p = xor(way.p, 1)
), folded(doc_id, leaf, i, h) AS (
    SELECT doc_id, leaf, 0, changed FROM leaves
    UNION ALL
    SELECT doc_id, leaf, steps.i, sha256(CASE WHEN on_left THEN sibling || h ELSE h || sibling END)
    FROM folded JOIN steps USING (doc_id, leaf) WHERE steps.i = folded.i + 1
), proofs AS (
    SELECT doc_id, leaf, sha256(string_agg(sibling, '' ORDER BY i)) AS proof_sha256
    FROM steps GROUP BY doc_id, leaf
), tops AS (
    SELECT doc_id, leaf, max_by(h, i) AS folded_root FROM folded GROUP BY doc_id, leaf
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM placed JOIN groups USING (g) JOIN tops USING (doc_id, leaf) LEFT JOIN proofs USING (doc_id, leaf),
  root"""

# One layer of the cheapest edits per row, for all conversations at once.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE known AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {CRC32.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}
        % 20 AS fault
    FROM conversations
), damaged AS MATERIALIZED (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
      CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM known, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(copy)
), placed AS MATERIALIZED (
    SELECT *, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS words,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        role, sha256(strlen(role) || ':' || role || text)) AS i
    FROM damaged
), judged AS MATERIALIZED (
    SELECT conv_id, turn, role, text, i, role[1] AS initial,
      CASE WHEN words = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN words[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), facts AS (
    SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated
    FROM judged GROUP BY conv_id
), pairs AS (
    SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (
      SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged
    ) GROUP BY conv_id
), inserts(s, t, cost, edits) AS (
    VALUES ('0', '0', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''),
      ('0', 'u', 5, 'I'), ('s', 'u', 5, 'I'), ('a', 'u', 5, 'I'), ('u', 'a', 5, 'I'),
      ('0', 'a', 10, 'II'), ('s', 'a', 10, 'II')
), steps(s, role) AS (
    VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')
), edits AS MATERIALIZED (
    SELECT conv_id, i, s, s AS t, 2 AS cost, 'D' AS edit
    FROM judged, (VALUES ('0'), ('s'), ('u'), ('a')) AS t(s)
    UNION ALL
    SELECT conv_id, i, s, steps.role,
      (CASE WHEN steps.role = initial THEN 0 ELSE 1 END) + (CASE fault WHEN 'truncated' THEN 5 ELSE 0 END),
      CASE WHEN steps.role = initial THEN 'K' ELSE 'R' END
    FROM judged JOIN steps ON fault NOT IN ('blank', 'duplicate')
      AND (steps.role = initial OR steps.role <> 's')
), layers(conv_id, i, s, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, '0', {{'cost': 0, 'edits': ''}} FROM judged
    UNION ALL
    SELECT layers.conv_id, any_value(edits.i), edits.t, min({{
        'cost': layers.best.cost + inserts.cost + edits.cost,
        'edits': layers.best.edits || inserts.edits || edits.edit}})
    FROM layers JOIN inserts USING (s) JOIN edits
      ON edits.conv_id IS NOT DISTINCT FROM layers.conv_id AND edits.i = layers.i + 1
      AND edits.s = inserts.t
    GROUP BY layers.conv_id, edits.t
), best AS MATERIALIZED (
    SELECT conv_id, min({{'cost': best.cost + inserts.cost, 'edits': best.edits || inserts.edits}}) AS best
    FROM layers JOIN facts USING (conv_id) JOIN inserts USING (s)
    WHERE i = n AND inserts.t IN ('0', 'a') GROUP BY conv_id
), audits AS (
    SELECT conv_id, edit, k, count(*) FILTER (edit <> 'I') OVER upto AS i,
      count(*) FILTER (edit <> 'D') OVER upto AS place
    FROM (SELECT conv_id, best.edits[k] AS edit, k
      FROM best, unnest(generate_series(1, length(best.edits))) AS t(k))
    WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
), written AS MATERIALIZED (
    SELECT conv_id, k, place, CASE edit WHEN 'I' THEN '' ELSE text END AS text,
      CASE edit WHEN 'K' THEN role END AS kept_role
    FROM audits LEFT JOIN judged USING (conv_id, i) WHERE edit <> 'D'
), leads AS (
    SELECT conv_id, count(*) AS shift FROM written WHERE place = 1 AND kept_role[1] = 's' GROUP BY conv_id
), repaired AS (
    SELECT conv_id, sha256(string_agg(coalesce(kept_role,
      CASE (place + coalesce(shift, 0)) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text,
      chr(10) ORDER BY k)) AS repaired_sha256
    FROM written LEFT JOIN leads USING (conv_id) GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.edits, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN facts USING (conv_id)
  LEFT JOIN pairs USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)"""
