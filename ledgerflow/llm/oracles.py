"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

#: The table of crc32 by its rule, and the crc32 (unsigned) of a text's UTF-8 bytes by that table.
CRC_TABLE = """
crc AS (SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
          CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY b) AS t
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))"""


def crc32(text: str) -> str:
    """SQL of the crc32 of the text expression ``text``, where ``t`` is the list of ``crc``."""
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(1, CAST(2 * strlen({text}) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))),
        lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])))"""


OP11 = f"""
WITH {CRC_TABLE},
  raw AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
  ids AS (SELECT row_number() OVER () AS r, * FROM raw),
  words AS (SELECT r, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM ids),
  distinct_words AS (SELECT w, {crc32('w')} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc),
  f AS (SELECT r, side, bucket, count(*) AS c FROM words JOIN distinct_words USING (w) GROUP BY ALL),
  per AS (SELECT bucket, sum(CASE WHEN side = 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN c ELSE 0 END) AS t
          FROM f GROUP BY bucket),
  total AS (SELECT CAST(sum(s) AS DOUBLE) AS bs, CAST(sum(t) AS DOUBLE) AS bt FROM per),
  gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (bs + 10000) / ((s + 1) * (bt + 10000)))) AS BIGINT) AS g FROM per, total),
  weight AS (SELECT r, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * g) AS BIGINT) AS total FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
  d AS (SELECT ids.r, doc_id, coalesce(n, 0) AS n_features,
               CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
               CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
        FROM ids LEFT JOIN weight USING (r) WHERE side = 0),
  scored AS (SELECT r, doc_id, n_features, weight,
                    weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
  ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS k, count(*) OVER () AS n
             FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


def _encoded(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN '-' ELSE strlen(CAST({text} AS VARCHAR)) || ':' || CAST({text} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_encoded(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


#: One more height of a list of nodes.
_UP = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))"
#: The nodes of a run before and after the one at ``i`` with a mark between them.
_RUN = "array_to_string(nodes[i - i % 3 + 1:i], '') || '*' || array_to_string(nodes[i + 2:i - i % 3 + 3], '')"

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
  docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS g, {_leaf('text')} AS leaf,
                  CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other
           FROM documents, crc),
  placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
  up AS (SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY g
         UNION ALL SELECT g, level + 1, {_UP} FROM up WHERE len(nodes) > 1),
  subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM up WHERE len(nodes) = 1),
  top AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
          UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1),
  runs AS (SELECT g, level, run, nodes[3 * run + 1:3 * run + 3] AS nodes
           FROM (SELECT *, unnest(range(0, (len(nodes) + 2) // 3)) AS run FROM up WHERE len(nodes) > 1)),
  top_runs AS (SELECT level, run, nodes[3 * run + 1:3 * run + 3] AS nodes
               FROM (SELECT *, unnest(range(0, (len(nodes) + 2) // 3)) AS run FROM top WHERE len(nodes) > 1)),
  top_path AS (SELECT g, list({_RUN} ORDER BY level) AS path
               FROM (SELECT g, level, nodes, (pos // CAST(3 ** level AS BIGINT)) % 3 AS i FROM subroots JOIN top_runs ON run = pos // CAST(3 ** (level + 1) AS BIGINT))
               GROUP BY g),
  path AS (SELECT r, list({_RUN} ORDER BY level) AS path
           FROM (SELECT r, level, nodes, (pos // CAST(3 ** level AS BIGINT)) % 3 AS i
                 FROM placed JOIN runs ON placed.g = runs.g AND run = pos // CAST(3 ** (level + 1) AS BIGINT))
           GROUP BY r),
  whole AS (SELECT placed.*, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
                   list_concat(coalesce(path.path, []), coalesce(top_path.path, [])) AS way
            FROM placed JOIN subroots ON placed.g = subroots.g LEFT JOIN path USING (r) LEFT JOIN top_path ON placed.g = top_path.g),
  ended AS (SELECT *, list_reduce(list_prepend(coalesce(other, leaf), way), lambda a, b: sha256(replace(b, '*', a))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '*', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM ended
"""
