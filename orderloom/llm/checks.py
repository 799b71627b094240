"""SQL of the queries that SQL can express, in the checking engine's dialect."""

from orderloom.llm.license_texts import KNOWN, SPELLINGS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x20\x09-\x0D]+"

SHINGLE_COMPONENTS = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id FROM words LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) r ON r.doc_id = words.doc_id
"""

KEPT_WORDS = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
starts AS (SELECT p.doc_id, p.i, p.word, max(g.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS latest
           FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE i < latest + 50) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE latest IS NULL OR i >= latest + 50), '') AS t
         FROM starts GROUP BY 1)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE array_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept FROM v
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY 1) c ON c.x = v.vec_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) r ON r.x = v.vec_id
"""


def _signatures(source: str, name: str, column: str) -> str:
    """CTEs that end in ``name`` (doc_id, sigs): the sorted distinct hashes of a text column."""
    return f"""
{name}_w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x : x <> '') AS w FROM {source}),
{name}_p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {name}_w),
{name}_c AS (SELECT doc_id, i, w[i] AS x, i = 1 OR length(w[i - 1]) <= 3 OR length(w[i - 1]) = 7 AS starts FROM {name}_p
             WHERE length(w[i]) > 3),
{name}_s AS (SELECT doc_id, starts, x || ' ' || coalesce(lead(x) OVER q, '') || ' ' || coalesce(lead(x, 2) OVER q, '') AS chain
             FROM {name}_c WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
{name} AS (SELECT {source}.doc_id, coalesce(list_sort(list(DISTINCT left(md5(chain), 8)) FILTER (WHERE starts)), []) AS sigs
           FROM {source} LEFT JOIN {name}_s ON {name}_s.doc_id = {source}.doc_id GROUP BY 1)"""


def _likeness(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / "
            f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


SPOT_SIGNATURES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER q, first(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d
      WINDOW q AS (ORDER BY doc_id DESC)),
e AS (SELECT n.doc_id, n.next_id, length(n.text) AS n_chars,
             left(n.text, length(n.text) - length(n.text) // 2) || left(m.text, length(n.text) // 2) AS edited
      FROM n JOIN d m ON m.doc_id = n.next_id),
{_signatures("d", "own", "text")},
{_signatures("e", "alt", "edited")}
SELECT e.doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own.sigs, '') AS fingerprint,
       array_to_string(alt.sigs, '') AS edited_fingerprint, {_likeness("own.sigs", "alt.sigs")} AS near_edited,
       {_likeness("own.sigs", "nxt.sigs")} AS near_next
FROM e JOIN own USING (doc_id) JOIN alt USING (doc_id) JOIN own nxt ON nxt.doc_id = e.next_id
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    line = r"(?m)^[^\p{L}\p{N}\n]*(?:©|\(c\)|copyright\s+(?:©|\(c\)|[0-9]|holder:)|all rights reserved)[^\n]*$"
    out = f"regexp_replace(lower({column}), {_text(line)}, ' ', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for kept, other in SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {kept.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _blocks(column: str) -> str:
    between = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
    return f"list_filter(list_transform(string_split_regex({column}, '{between}'), lambda b : {_canonical('b')}), lambda b : b <> '')"


LICENSES = f"""
WITH texts AS (SELECT name, t FROM (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in KNOWN.items())}) k(name, t)),
known AS (SELECT name, sha256({_canonical("t")}) AS h FROM texts),
known_blocks AS (SELECT name, len(b) AS size, unnest(b) AS block, generate_subscripts(b, 1) AS k FROM (SELECT name, {_blocks("t")} AS b FROM texts)),
units AS (SELECT doc_id, true AS whole, coalesce(text, '') AS u FROM documents
          UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
doc_blocks AS (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) AS place FROM (SELECT doc_id, {_blocks("text")} AS b FROM documents
               WHERE text IS NOT NULL)),
runs AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, name, place - k AS start FROM doc_blocks JOIN known_blocks USING (block)
         GROUP BY doc_id, name, size, place - k HAVING count(DISTINCT k) = size)),
hits AS (SELECT doc_id, whole, name FROM (SELECT doc_id, whole, sha256({_canonical("u")}) AS h FROM units
         WHERE regexp_matches(lower(u), 'licen|permi|software|redistribut|warrant|copyright')) JOIN known USING (h)
         UNION ALL SELECT doc_id, false, name FROM runs),
found AS (SELECT doc_id, min(name) FILTER (WHERE whole) AS license,
                 array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE NOT whole)), ',') AS notices FROM hits GROUP BY 1)
SELECT d.doc_id, license, coalesce(notices, '') AS notices FROM documents d LEFT JOIN found ON found.doc_id = d.doc_id
"""

# Cyclic redundancy codes by table; ids and turns are ASCII.
_CRC = """
tab AS (SELECT list_transform(range(256), lambda i : list_reduce(range(8), lambda c, k :
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""

TURN_REPAIR = rf"""
WITH RECURSIVE {_CRC},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x : ascii(x)::BIGINT),
            lambda c, b : xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) % 20 AS d FROM conversations, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM keyed, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) WHERE d <> 0),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM damaged),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                 CASE WHEN NOT regexp_matches(text, '{WORDS}') THEN 1 WHEN copy > 1 THEN 2
                      WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
          FROM copies),
convs AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, r.*, count(*) OVER (PARTITION BY c) AS n, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair
             FROM rows_ r JOIN convs ON r.conv_id IS NOT DISTINCT FROM convs.conv_id),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(q, s, p)),
inserts AS (SELECT * FROM (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']),
              (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']),
              (1, 3, 'II', ['user:', 'assistant:'])) v(q, p, letters, lines)),
edits AS (
  SELECT c, i, 2 AS cost, 'D' AS letter, q, q AS p, []::VARCHAR[] AS lines FROM numbered, range(4) t(q)
  UNION ALL SELECT c, i, CASE fault WHEN 3 THEN 5 ELSE 0 END, 'K', q, p, [role || ':' || text] FROM numbered JOIN moves ON s = left(role, 1)
  WHERE fault IN (0, 3)
  UNION ALL SELECT c, i, CASE fault WHEN 3 THEN 6 ELSE 1 END, 'R', q, p, [CASE s WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM numbered, moves WHERE fault IN (0, 3) AND s IN ('u', 'a')),
steps AS (SELECT e.c, e.i, a.q, e.p, e.cost + 5 * len(a.letters) AS cost, a.letters || e.letter AS letters, a.lines || e.lines AS lines
          FROM edits e JOIN inserts a ON a.p = e.q),
reach AS (
  SELECT c, 0 AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM convs
  UNION ALL
  SELECT c, i, p, m.cost, m.audit, m.lines FROM (
    SELECT r.c, s.i::INTEGER AS i, s.p, arg_min({{cost: (r.cost + s.cost)::INTEGER, audit: r.audit || s.letters, lines: r.lines || s.lines}},
                                     {{cost: (r.cost + s.cost)::INTEGER, audit: r.audit || s.letters}}) AS m
    FROM reach r JOIN steps s ON s.c = r.c AND s.i = r.i + 1 AND s.q = r.q GROUP BY 1, 2, 3)),
ends AS (SELECT c, arg_min({{cost: cost, audit: audit, lines: lines}}, {{cost: cost, audit: audit}}) AS m FROM (
           SELECT r.c, r.cost + 5 * len(a.letters) AS cost, r.audit || a.letters AS audit, r.lines || a.lines AS lines
           FROM reach r JOIN inserts a ON a.q = r.q JOIN (SELECT c, max(n) AS n FROM numbered GROUP BY 1
             UNION ALL SELECT c, 0 FROM convs WHERE c NOT IN (SELECT c FROM numbered)) t ON t.c = r.c AND t.n = r.i
           WHERE a.p IN (0, 3)) GROUP BY 1),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
                  count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
                  count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM numbered GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, m.cost::BIGINT AS cost, m.audit AS audit,
       sha256(array_to_string(m.lines, chr(10))) AS repaired_sha256
FROM convs JOIN ends USING (c) LEFT JOIN counts USING (c)
"""
