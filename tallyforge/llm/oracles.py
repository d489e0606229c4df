"""DuckDB SQL with the same rows, for the queries that SQL can express: plain comparisons of all pairs or all strings.

Ids are taken to be unique and not null, as they are in the driver's tables.
"""

#: Links in ``links (a, b)`` with a < b, and all nodes in ``nodes (id)``: the smallest id that reaches each node.
#: A root is only handed to larger ids, which every node of its component is if the root is the smallest.
_COMPONENTS = """
reach(id, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT e.y, r.root
  FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links) e ON e.x = r.id
  WHERE r.root < e.y
),
components AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
),
nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN components k ON k.id = d.doc_id
"""

SUFFIX_DEDUP = """
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS string FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY string) AS c FROM starts) WHERE c > 1),
marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM again),
runs AS (SELECT doc_id, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS b, max(i) + 400 AS e FROM runs GROUP BY doc_id, run),
ends AS (
  SELECT doc_id, b AS until, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since FROM spans
  UNION ALL
  SELECT t.doc_id, t.n, coalesce(max(s.e), 0) FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id, t.n
),
kept AS (
  SELECT t.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since) AS h
  FROM ends JOIN texts t ON t.doc_id = ends.doc_id GROUP BY t.doc_id
),
removed AS (SELECT doc_id, sum(e - b) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       coalesce(r.spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN removed r ON r.doc_id = t.doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
raw AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scaled AS (
  SELECT vec_id, label, [x / top FOR x IN v] AS v
  FROM (SELECT vec_id, label, v, list_max([abs(x) FOR x IN v]) AS top FROM raw) WHERE top > 0
),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM scaled x JOIN scaled y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93
),
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
{_COMPONENTS}
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.id = e.vec_id JOIN components k ON k.id = e.vec_id
"""

#: The table of crc32 by byte, and the crc32 of a list of bytes by it.
_CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(256) AS bytes(b)
)
"""


def _crc32(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, crc_table.t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Seven levels hold two million rows of a language, or as many languages.
_LEVELS = 7


def _tree(name: str, leaves: str) -> str:
    """CTEs name0 .. name7 (g, i, d, n): a group's nodes at each level; n = 1 at and after its root."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(1, _LEVELS + 1):
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT g, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (any_value(n) + 7) // 8 AS n "
            f"FROM {name}{k - 1} WHERE n > 1 GROUP BY g, i // 8 UNION ALL SELECT g, i, d, n FROM {name}{k - 1} WHERE n = 1)"
        )
    return ",\n".join(out)


def _path(name: str, start: str) -> str:
    """CTEs name_p0 .. name_p7: start (g, i, proof, fold, more) with the siblings of each level added and folded."""
    out = [f"{name}_p0 AS ({start})"]
    for k in range(_LEVELS):
        side = f"SELECT x.g, x.i, string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i) AS l, string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i) AS r FROM {name}{k} x JOIN {name}{k} y ON y.g = x.g AND y.i // 8 = x.i // 8 AND x.n > 1 GROUP BY x.g, x.i"
        out.append(
            f"{name}_p{k + 1} AS MATERIALIZED (SELECT p.g, CASE WHEN s.g IS NULL THEN p.i ELSE p.i // 8 END AS i, p.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof, "
            f"CASE WHEN s.g IS NULL THEN p.fold ELSE sha256(coalesce(s.l, '') || p.fold || coalesce(s.r, '')) END AS fold, p.more FROM {name}_p{k} p LEFT JOIN ({side}) s ON s.g = p.g AND s.i = p.i)"
        )
    return ",\n".join(out)


MERKLE = f"""
WITH {_CRC_TABLE},
rows AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS d,
         CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)")} % 3 = 0 THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS changed
  FROM documents, crc_table
),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows),
{_tree("lang", "SELECT g, i, d, n FROM placed")},
{_tree("top", f"SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, d, count(*) OVER () AS n, g AS lang FROM lang{_LEVELS}")},
{_path("lang", "SELECT g, i, '' AS proof, changed AS fold, {'id': doc_id, 'leaf': d} AS more FROM placed")},
{_path("top", f"SELECT t.g, t.i, p.proof, p.fold, {{'id': p.more.id, 'leaf': p.more.leaf, 'subroot': t.d}} AS more FROM lang_p{_LEVELS} p JOIN top0 t ON t.lang = p.g")}
SELECT p.more.id AS doc_id, p.more.leaf AS leaf, p.more.subroot AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = r.d AS verified
FROM top_p{_LEVELS} p, top{_LEVELS} r
"""

_OCTETS = "flatten(list_transform(string_split(id_run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END))"

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
grouped AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id_run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32(_OCTETS)} AS h FROM grouped, crc_table),
observed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM observed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS MATERIALIZED (
  SELECT x.word, y.word AS near FROM places x JOIN places y ON x.i = y.i AND x.short = y.short AND x.word <> y.word
  UNION
  SELECT p.word, w.word FROM places p JOIN words w ON w.word = p.short
  UNION
  SELECT w.word, p.word FROM places p JOIN words w ON w.word = p.short
),
ranked AS (
  SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS place
  FROM pairs p JOIN words w ON w.word = p.near
),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chain(word, last, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""

ORACLES = {
    "op5_minhash_dedup": MINHASH_DEDUP,
    "op8_suffix_dedup": SUFFIX_DEDUP,
    "op9_embedding_dedup": EMBEDDING_DEDUP,
    "op12_merkle_manifest": MERKLE,
    "op13_spelling_variants": SPELLING,
}
