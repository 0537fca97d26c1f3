"""DuckDB SQL of the queries that SQL can express."""

# crc32 is not a DuckDB function: the table follows from its polynomial, then bytes are folded in.
_CRC = """
crc_table AS (
  WITH RECURSIVE step(n, c, k) AS (
    SELECT range, range::BIGINT, 0 FROM range(256)
    UNION ALL
    SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8)
  SELECT list(c ORDER BY n) AS tab FROM step WHERE k = 8)
"""

OP7 = f"""
WITH {_CRC},
text_crc AS (
  SELECT text, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                                      lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table),
keyed AS (
  SELECT d.doc_id, d.source, strlen(coalesce(d.text, '')) + 8 AS size, crc AS text_crc32,
         md5('0:' || coalesce(d.doc_id::VARCHAR, '') || ':' || crc) AS key
  FROM documents d JOIN text_crc t ON t.text = coalesce(d.text, '')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size) AS rank,
         count(*) OVER (PARTITION BY source) AS n_source FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n_source)::DOUBLE,
                               CASE WHEN source IS NULL THEN '-' ELSE '+' || source END, rank) - 1 AS pos,
         count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 24 // total)::INTEGER AS shard,
       (pos - ((pos * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard,
       source, rank::BIGINT AS rank
FROM placed
"""

ORACLE_SQL = {"op7_interleave": OP7}

OP6 = r"""
WITH RECURSIVE
words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3),
                             lambda i: concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]))) END AS s
  FROM words),
classes AS (SELECT min(rid) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
grams AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.c AS x, b.c AS y FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT c, c FROM classes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
comp AS (SELECT x AS c, min(y) AS comp FROM reach GROUP BY x),
member AS (SELECT s.doc_id, len(s.s) AS n, p.comp FROM sets s
           LEFT JOIN classes k ON k.s = list_sort(s.s) LEFT JOIN comp p USING (c))
SELECT doc_id, n::BIGINT AS n_shingles,
       CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY comp) END AS component_id
FROM member
"""

ORACLE_SQL["op6_partenum"] = OP6

OP4 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts),
grams AS (SELECT rid, i, x, lag(x) OVER w AS v, lag(x, 2) OVER w AS u FROM words WINDOW w AS (PARTITION BY rid ORDER BY i)),
size AS (SELECT count(*) AS n FROM words),
one AS (SELECT rid, x, count(*) AS own, sum(count(*)) OVER (PARTITION BY x) AS total FROM grams GROUP BY rid, x),
two AS (SELECT rid, v, x, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, x) AS total
        FROM grams WHERE v IS NOT NULL GROUP BY rid, v, x),
three AS (SELECT rid, u, v, x, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v, x) AS total
          FROM grams WHERE u IS NOT NULL GROUP BY rid, u, v, x),
scored AS (
  SELECT g.rid, coalesce(d.total - d.own, 0) AS c3, c.total - c.own AS cuv, coalesce(b.total - b.own, 0) AS c2,
         a.total - a.own AS c1, p.total - p.own AS cv, greatest(size.n - len(t.w), 1) AS n
  FROM grams g JOIN size ON true JOIN texts t ON t.rid = g.rid
  JOIN one a ON a.rid = g.rid AND a.x = g.x
  LEFT JOIN one p ON p.rid = g.rid AND p.x = g.v
  LEFT JOIN two b ON b.rid = g.rid AND b.v = g.v AND b.x = g.x
  LEFT JOIN two c ON c.rid = g.rid AND c.v = g.u AND c.x = g.v
  LEFT JOIN three d ON d.rid = g.rid AND d.u = g.u AND d.v = g.v AND d.x = g.x),
summed AS (
  SELECT rid, count(*) FILTER (c3 = 0 AND c2 > 0) AS n_bigrams, count(*) FILTER (c3 > 0) AS n_trigrams,
         sum(ln(CASE WHEN c3 > 0 THEN c3 / cuv WHEN c2 > 0 THEN 0.4::DOUBLE * c2 / cv
                     WHEN c1 > 0 THEN 0.4::DOUBLE * 0.4::DOUBLE * c1 / n
                     ELSE 0.4::DOUBLE * 0.4::DOUBLE * 0.4::DOUBLE / n END)) AS s
  FROM scored GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_bigrams, 0)::BIGINT AS n_bigrams,
       coalesce(n_trigrams, 0)::BIGINT AS n_trigrams,
       round(coalesce(s, 0), 4) AS log_score, round(s / nullif(len(w), 0), 6) AS mean_log
FROM texts LEFT JOIN summed USING (rid)
"""

ORACLE_SQL["op4_backoff"] = OP4

OP1 = """
WITH RECURSIVE
vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.rid AS x, b.rid AS y FROM good a JOIN good b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT rid, rid FROM vectors UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.rid)::BIGINT AS n_links,
       min(o.vec_id) AS component_id, v.vec_id IS NOT DISTINCT FROM min(o.vec_id) AS kept
FROM vectors v JOIN reach r ON r.x = v.rid JOIN vectors o ON o.rid = r.y
GROUP BY v.rid, v.vec_id
"""

ORACLE_SQL["op1_itq"] = OP1

_CONTROLS = r"INST\]|/INST\]|\+\]|/s>"

OP12 = rf"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
sized AS (
  SELECT *, i = 1 OR role IS DISTINCT FROM before AS opens,
         length(regexp_replace(text, '([\[<])(\\*)({_CONTROLS})', '\1\\\2\3', 'g')) AS body,
         coalesce(2 + length(regexp_replace(role, '([\[<])(\\*)({_CONTROLS})', '\1\\\2\3', 'g')), 0) AS named
  FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE WHEN opens THEN length('[INST][/INST]</s>') + named ELSE length('[+]') END)::BIGINT AS formatted_chars,
       (count(*) FILTER (opens))::BIGINT AS n_blocks
FROM sized GROUP BY conv_id
"""

ORACLE_SQL["op12_chat"] = OP12


def _levels(source: str, key: str, n: int) -> str:
    """CTEs {source}1 ... {source}n: each level of runs of 16, a tree of one node stays as it is; and what stands beside a node."""
    out = []
    for i in range(n):
        at = f"PARTITION BY {key}, slot // 16 ORDER BY slot ROWS BETWEEN"
        out.append(f"""
{source}{i}b AS MATERIALIZED (
  SELECT *, CASE WHEN width = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER ({at} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
         CASE WHEN width = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER ({at} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r
  FROM {source}{i}),
{source}{i + 1} AS MATERIALIZED (
  SELECT {key}, slot // 16 AS slot, (max(width) + 15) // 16 AS width,
         CASE WHEN max(width) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY slot)) END AS d
  FROM {source}{i} GROUP BY {key}, slot // 16)""")
    return ",".join(out)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_HEIGHT, _TOP = 6, 4  # levels: up to 16 ** 6 documents of a source, 16 ** 4 sources
_UP = [(f"n{i}b", f"n{i}b.s = p.s AND n{i}b.slot = p.slot // {16 ** i}") for i in range(_HEIGHT)] + \
      [(f"m{i}b", f"m{i}b.slot = p.at // {16 ** i}") for i in range(_TOP)]

OP13 = f"""
WITH {_CRC},
given AS MATERIALIZED (
  SELECT doc_id, source, coalesce('1' || source, '0') AS s,
         sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
         sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars',
                "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))}) AS lowered,
         xor(4294967295, list_reduce(
             list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
                                                             lambda b: ('0x' || b)::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, crc_table),
placed AS MATERIALIZED (
  SELECT *, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS used,
         row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot,
         count(*) OVER (PARTITION BY s) AS width FROM given),
n0 AS (SELECT s, slot, width, leaf AS d FROM placed),{_levels('n', 's', _HEIGHT)},
m0 AS (SELECT 0 AS g, s, row_number() OVER (ORDER BY s) - 1 AS slot, count(*) OVER () AS width, d FROM n{_HEIGHT}),
{_levels('m', 'g', _TOP).lstrip()},
paths AS MATERIALIZED (
  SELECT p.doc_id, p.source, p.leaf, p.used, n{_HEIGHT}.d AS subroot, m{_TOP}.d AS root,
         [{', '.join(f"{{'l': {t}.l, 'r': {t}.r, 'w': {t}.width}}" for t, _ in _UP)}] AS path
  FROM (SELECT placed.*, m0.slot AS at FROM placed JOIN m0 USING (s)) p
  {' '.join(f'JOIN {t} ON {on}' for t, on in _UP)}
  JOIN n{_HEIGHT} ON n{_HEIGHT}.s = p.s CROSS JOIN m{_TOP}),
folded AS (
  SELECT *, list_reduce(list_prepend({{'h': used, 'r': '', 'w': 0}},
                        list_transform(path, lambda x: {{'h': x.l, 'r': x.r, 'w': x.w}})),
                        lambda a, x: {{'h': CASE WHEN x.w = 1 THEN a.h ELSE sha256(x.h || a.h || x.r) END, 'r': '', 'w': 0}}).h
         AS folded_root FROM paths)
SELECT doc_id, source, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

ORACLE_SQL["op13_manifest"] = OP13


def _rounds(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """CTEs of the codebooks b0 ... and of the assignments a0 ..."""
    out = [f"""
b0 AS MATERIALIZED (
  SELECT p, i - 1 AS e, x FROM cut JOIN (
    SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS i FROM kept) USING (rid) WHERE i <= {entries})"""]
    for k in range(rounds + 1):
        out.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, p, min(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT rid, c.p, c.x, e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut c JOIN b{k} b USING (p)) GROUP BY rid, p)""")
        if k < rounds:
            out.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(floor(s::DECIMAL(38, 0) / n)::BIGINT ORDER BY j) AS x FROM (
      SELECT p, best.e AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n
      FROM a{k}, range(1, (SELECT max(len(x)) FROM cut) + 1) r(j) GROUP BY ALL) GROUP BY p, e) m USING (p, e))""")
    return ",".join(out)


OP11 = f"""
WITH finite AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (
  SELECT * FROM finite WHERE len(ints) = (SELECT len(ints) FROM finite GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
cut AS MATERIALIZED (
  SELECT rid, p, ints[p * (len(ints) // 8) + 1:(p + 1) * (len(ints) // 8)] AS x FROM kept, range(8) r(p)),{_rounds()},
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), books
"""

ORACLE_SQL["op11_codes"] = OP11
