"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {}

ORACLES["op10_source_mix"] = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 12))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM base GROUP BY source
), l AS (
  SELECT *, source_size::DOUBLE / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / sum(w) OVER (ORDER BY source_size::DOUBLE / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level,
    row_number() OVER (ORDER BY source_size::DOUBLE / w, r) AS place
  FROM s
), e AS (
  SELECT min(place) AS ends, arg_min(level, place) AS level FROM l WHERE level * w <= 2 * source_size
), t AS (
  SELECT source, source_size, CASE WHEN e.ends IS NULL OR place < e.ends THEN (2 * source_size)::DOUBLE ELSE e.level * w END AS target
  FROM l, e
), u AS (
  SELECT source, k, sum(size)::BIGINT AS size FROM base GROUP BY source, k
), c AS (
  SELECT source, k, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before, size AS unit FROM u
)
SELECT b.doc_id, b.size, t.source_size, t.target,
  (b.size * (CASE WHEN t.target >= t.source_size THEN 1 ELSE 0 END
    + CASE WHEN c.before + c.unit / 2.0::DOUBLE <= t.target - CASE WHEN t.target >= t.source_size THEN t.source_size ELSE 0 END THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.k = c.k
"""

ORACLES["op4_decontamination"] = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS x(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM g), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), m AS (
  SELECT row, i, n, w[i:i + n - 1] AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), f AS (SELECT m.row, m.i, m.n, g.item_id FROM m JOIN g ON m.n = g.n AND m.g = g.g), hits AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM f) GROUP BY row
), items AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM f WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""

ORACLES["op2_bit_sliced_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64::DOUBLE * x::DOUBLE)) AS q, row_number() OVER (PARTITION BY vec_id, embedding) AS copy
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id AS query_id, q, row_number() OVER (PARTITION BY vec_id) AS place FROM v WHERE vec_id % 20 = 0 AND copy = 1
), s AS (
  SELECT query_id, place, vec_id, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM a JOIN v ON len(a.q) = len(v.q) AND NOT (a.query_id IS NOT DISTINCT FROM v.vec_id AND a.q = v.q AND copy = 1)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op8_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), x AS (
  SELECT row, id, i, array_to_string(w[i:i + 19], ' ') AS words FROM (SELECT row, id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), f AS (
  SELECT row, i FROM (SELECT row, i, id, min(id) OVER (PARTITION BY words) AS least, min(i) OVER (PARTITION BY words, row) AS first FROM x) WHERE id > least OR i > first
), g AS (
  SELECT row, list(p) AS gone FROM (SELECT DISTINCT row, unnest(range(i, i + 20)) AS p FROM f) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (row)
"""

ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT row, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT row, count(*) AS n FROM s GROUP BY row), both_ways AS (
  SELECT a.row AS a, b.row AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.row <> b.row GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ways JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach AS (
  SELECT row, row AS other FROM d UNION SELECT reach.row, b FROM reach JOIN links ON other = a
), least AS (SELECT reach.row, min(doc_id) AS component_id FROM reach JOIN d ON d.row = other GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (row) JOIN least USING (row)
"""

#: A table for crc32 by bytes, made from its polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)
  )
)"""


def _crc(text: str) -> str:
    """crc32 of the UTF-8 of a text that is not null, next to ``crc_table``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _hash(k: int) -> str:
    return _crc(f"'{k}:' || coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '')")


#: The first attempt that delivers, if any.
_TRIED = "list_filter(range(1, 7), lambda a: NOT faulty OR (tried + 20 * ((1 << (a - 1)) - 1) >= 7 * p + repair AND NOT fails[a]))[1]"

ORACLES["op11_cascading_release"] = f"""
WITH RECURSIVE {_CRC_TABLE}, f AS (
  SELECT conv_id, turn, {_crc("coalesce(text, '')")} AS crc, {_hash(0)} % 5 AS d, {_hash(1)} % 101 < 50 AS faulty, {_hash(2)} % 101 AS repair,
    [{", ".join(f"{_hash(a + 2)} % 3 = 0" for a in range(1, 7))}] AS fails
  FROM conversations, crc_table
), b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, crc) - 1 AS p FROM f
), o AS (
  SELECT *, {_TRIED} AS a, false AS blocked FROM (SELECT *, 7 * p AS tried FROM b WHERE d = 0 OR p < d)
  UNION ALL
  SELECT * EXCLUDE (stopped), {_TRIED} AS a, stopped FROM (
    SELECT b.*, greatest(7 * b.p, o.tried + 20 * ((1 << (coalesce(o.a, 1) - 1)) - 1)) AS tried, o.a IS NULL OR o.blocked AS stopped
    FROM b JOIN o ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.p - b.d = o.p WHERE b.d > 0
  ) AS c (conv_id, turn, crc, d, faulty, repair, fails, p, tried, stopped)
), r AS (
  SELECT *, CASE WHEN blocked THEN 'blocked' WHEN a IS NULL THEN 'dead' ELSE 'delivered' END AS status,
    tried + 20 * ((1 << (coalesce(a, 6) - 1)) - 1) AS last
  FROM o
), n AS (
  SELECT *, row_number() OVER w AS release_no FROM r WHERE status = 'delivered' WINDOW w AS (PARTITION BY conv_id ORDER BY last, turn NULLS FIRST, p)
), s AS (
  SELECT conv_id, p, release_no, sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no)::BIGINT AS state FROM n
)
SELECT r.conv_id, r.turn, r.status, CASE WHEN r.blocked THEN 0 ELSE coalesce(r.a, 6) END::INT AS attempts,
  CASE WHEN NOT r.blocked THEN r.tried END::BIGINT AS first_at, CASE WHEN NOT r.blocked THEN r.last END::BIGINT AS last_at, s.release_no, s.state
FROM r LEFT JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.p = s.p
"""

ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
), h AS (
  SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run), crc_table
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h)
  GROUP BY word HAVING len(word) >= 5 AND sum(n) >= 3
), x AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.less = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.less = v.word
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM p JOIN v ON v.word = b GROUP BY a
), f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON a = word
), walk AS (
  SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f AS e ON e.word = walk.root AND e.form IS NULL
"""


def _levels() -> str:
    """A level of the tree after the other: nodes are split across their widest dimension."""
    out = ["l0 AS (SELECT *, 0 AS shard FROM c)"]
    for k, left in enumerate((8, 4, 2, 1)):
        out.append(f"""w{k} AS (
  SELECT *, max(c0) OVER s - min(c0) OVER s AS w0, max(c1) OVER s - min(c1) OVER s AS w1, max(c2) OVER s - min(c2) OVER s AS w2, sum(size) OVER s AS total
  FROM l{k} WINDOW s AS (PARTITION BY shard)
), o{k} AS (
  SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY CASE WHEN w0 >= w1 AND w0 >= w2 THEN c0 WHEN w1 >= w2 THEN c1 ELSE c2 END, tie ROWS UNBOUNDED PRECEDING) AS upto FROM w{k}
), l{k + 1} AS (
  SELECT doc_id, size, text_crc32, tie, c0, c1, c2, shard + CASE WHEN upto - size / 2.0::DOUBLE <= total / 2.0::DOUBLE THEN 0 ELSE {left} END AS shard FROM o{k}
)""")
    return ", ".join(out)


def _place(x: str) -> str:
    ends = f"(SELECT min({x}) FROM x)", f"(SELECT max({x}) FROM x)"
    return f"coalesce(CASE WHEN {ends[1]} > {ends[0]} THEN floor(({x} - {ends[0]}) / ({ends[1]} - {ends[0]}) * 16777214::DOUBLE) + 1 WHEN {x} IS NOT NULL THEN 1 END, 0)::BIGINT"


def _prefix(x: str) -> str:
    return f"('0x' || rpad(substr(hex(encode({x})), 1, 12), 12, '0'))::BIGINT::DOUBLE"


ORACLES["op13_kd_shards"] = f"""
WITH {_CRC_TABLE}, x AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32,
    {_prefix("source")} AS x0, {_prefix("lang")} AS x1, n_chars::DOUBLE AS x2
  FROM documents, crc_table
), c AS (
  SELECT doc_id, size, text_crc32, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR), 1, 6) AS tie, {_place("x0")} AS c0, {_place("x1")} AS c1, {_place("x2")} AS c2 FROM x
), {_levels()}
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY tie) - 1 AS slot, NULL::INT AS grown_shard FROM l4
"""
