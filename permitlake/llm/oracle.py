"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

# The CRC-32 of a decimal number, bit by bit; DuckDB has no function for it.
_CRC32 = """xor(list_reduce(
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
    lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), range(8)),
        lambda bits, turn: xor(bits >> 1, 3988292384 * (bits & 1))
    ),
    4294967295::BIGINT
), 4294967295::BIGINT)"""

CONVERSATION_TRIE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, {_CRC32} % 6 AS h,
        list(struct_pack(role := role, text := text)
             ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS turns
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT o.conv_id, list_concat(
        coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))
    ) AS path
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), members AS (
    SELECT conv_id, len(path) AS turns, d AS depth, list_slice(path, 1, d) AS prefix
    FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN turns = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), ''))
            AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[depth].text) END AS saved
    FROM members GROUP BY prefix, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
        (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND list_slice(c.prefix, 1, n.depth) = n.prefix)
            AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
), upwards AS (
    SELECT list_slice(prefix, 1, d) AS prefix, d AS depth,
        count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM linked) GROUP BY ALL
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, l.n_children, u.n_leaves,
    u.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN upwards u ON u.depth = l.depth AND u.prefix = l.prefix
"""

COLLOCATIONS = """
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]'
        )) AS piece FROM documents
    )
), places AS (
    SELECT lang, words[i] AS a, words[i + 1] AS b, words[i + 2] AS x
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM pieces)
), totals AS (
    SELECT lang, count(*) AS n FROM places GROUP BY lang
), ones AS (
    SELECT lang, a, count(*) AS f FROM places GROUP BY ALL
), twos AS (
    SELECT lang, a, b, count(*) AS f FROM places WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), threes AS (
    SELECT lang, a, b, x, count(*) AS f FROM places WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, a, b, max(f) AS f FROM (
        SELECT lang, a, b, f FROM threes UNION ALL SELECT lang, b AS a, x AS b, f FROM threes
    ) GROUP BY ALL
), cuts AS (
    SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
    FROM twos t JOIN ones l ON l.lang = t.lang AND l.a = t.a JOIN ones r ON r.lang = t.lang AND r.a = t.b
    LEFT JOIN longer g ON g.lang = t.lang AND g.a = t.a AND g.b = t.b
    WHERE 100 * coalesce(g.f, 0) < 50 * t.f
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.x, t.f, 1, l.f, r.f
    FROM threes t JOIN ones l ON l.lang = t.lang AND l.a = t.a
    JOIN twos r ON r.lang = t.lang AND r.a = t.b AND r.b = t.x
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.x, t.f, 2, l.f, r.f
    FROM threes t JOIN twos l ON l.lang = t.lang AND l.a = t.a AND l.b = t.b
    JOIN ones r ON r.lang = t.lang AND r.a = t.x
), scored AS (
    SELECT *, (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
    SELECT * FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
