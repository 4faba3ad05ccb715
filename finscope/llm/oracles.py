"""DuckDB SQL for those queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM d, unnest(range(1, len(ws) - 1)) AS t(i)
), rep AS (
  SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS t(k) GROUP BY r
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless,
         coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word,
         length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
         length(text) - length(regexp_replace(text, '[{{}}]', '', 'g')) AS n_braces,
         length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}\x{{2023}}]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_open_lines
  FROM d LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_letterless > 40 * n_words OR longest_word > 1000 OR 100 * n_digits > 40 * word_chars OR 100 * n_braces > 5 * word_chars
            OR 100 * n_upper > 60 * word_chars OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_open_lines > 50 * n_lines) AS kept
FROM c
"""

LINE_DEDUP = r"""
WITH d AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents
), w AS (
  SELECT DISTINCT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM d, unnest(range(1, len(ls) - 1)) AS t(i)
  WHERE regexp_matches(ls[i] || ls[i + 1] || ls[i + 2], '[^\x20\x09-\x0D]')
), later AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), cov AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM later, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(ls)::BIGINT AS n_lines, len(coalesce(gone, []))::BIGINT AS n_removed,
         coalesce(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i)), []) AS ks
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(array_to_string(ks, chr(10)), '')) AS kept_sha256 FROM kept
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(ws) - 11)) AS t(i)
), later AS (
  SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id
), cov AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 13)) AS t(k)
), kept AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS txt
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) u ANTI JOIN cov ON u.doc_id = cov.doc_id AND u.i = cov.i
  GROUP BY u.doc_id
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n_removed FROM cov GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: crc32 of the id's decimal digits, unsigned, bit by bit: of every byte the value, then eight times a shift.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

PERIODIC_RUNS = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS ws, {_CRC} AS h FROM documents
), e AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS made, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e
), w AS (
  SELECT doc_id, n, i, CASE WHEN made AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word FROM f, unnest(range(0, n)) AS t(i)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, q AS period, start, length FROM stretch s WHERE NOT EXISTS (SELECT 1 FROM stretch t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), gone AS (
  SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS t(i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)
), before AS (
  SELECT *, sum(n) OVER () AS everything, coalesce(sum(n) OVER f, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS weight
  FROM s WINDOW f AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (3 * everything - 4 * full_before)::BIGINT AS halves, weight FROM before WHERE 4 * n * weight >= (3 * everything - 4 * full_before) * w ORDER BY 2 * n / w, source NULLS LAST LIMIT 1
), goal AS (
  SELECT source, n, w, row_number() OVER (ORDER BY source NULLS LAST) AS r, CASE WHEN 4 * n * weight < halves * w THEN (2 * n)::DOUBLE ELSE (halves * w)::DOUBLE / (2 * weight)::DOUBLE END AS target FROM s, level
), b AS (
  SELECT greatest(1, least(64, floor(min(target) FILTER (target > 0) / 256)))::BIGINT AS block, sum(target) AS wanted FROM goal
), bids AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r) AS place FROM goal, b, unnest(range(0, ((2 * n + block - 1) // block)::BIGINT)) AS t(k) WHERE target > 0
), seats AS (
  SELECT source, count(*) AS seats FROM bids, b WHERE place <= round_even(wanted / block, 0) GROUP BY source
), rows AS (
  SELECT d.doc_id, d.source, size, n, target, key, ('0x' || key[1:8])::BIGINT % greatest(1, ceil(n / 1048576)::BIGINT) AS shard FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
), cells AS (
  SELECT source, shard, sum(size)::BIGINT AS words, ((2 * sum(size) + block - 1) // block)::BIGINT AS most FROM rows, b GROUP BY source, shard, block HAVING sum(size) > 0
), parts AS (
  SELECT c.source, shard, row_number() OVER (PARTITION BY c.source ORDER BY words / (2 * k + 1) DESC, shard) AS place FROM cells c, unnest(range(0, c.most)) AS t(k)
), quota AS (
  SELECT p.source, shard, count(*) AS quota FROM parts p JOIN seats s ON p.source IS NOT DISTINCT FROM s.source WHERE place <= seats GROUP BY p.source, shard
), laid AS (
  SELECT r.*, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends FROM rows r
), drawn AS (
  SELECT l.doc_id, l.size, l.n, l.target, l.ends, c.words, c.most, coalesce(q.quota, 0) AS quota, block, ('0x' || md5('42:' || coalesce(l.source, '') || ':' || l.shard)[1:8])::BIGINT % c.most AS first
  FROM laid l CROSS JOIN b LEFT JOIN cells c ON l.source IS NOT DISTINCT FROM c.source AND l.shard = c.shard LEFT JOIN quota q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard
), taken AS (
  SELECT d.*, (SELECT sum(least(ends + words * lap, block * (k + 1)) - greatest(ends - size + words * lap, block * k)) FROM (SELECT unnest([0, 1]) AS lap), unnest(range(((ends - size + words * lap) // block)::BIGINT, ((ends + words * lap + block - 1) // block)::BIGINT)) AS t(k)
    WHERE ((k + 1) * quota + first) // most > (k * quota + first) // most) AS got FROM drawn d
)
SELECT doc_id, size, n AS source_size, target, CASE WHEN size > 0 THEN coalesce(got, 0) ELSE 0 END::BIGINT AS taken FROM taken
"""


def _marked(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"


def _merkle(levels: int = 14) -> str:
    """Levels over the leaves of each source, then over the sources, one query each; `levels` holds for 3 ** levels leaves of a source and as many sources."""
    leaf = lambda text: "sha256(" + " || ".join(map(_marked, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {leaf('replace(text, chr(10), chr(32)[:0])')} ELSE {leaf('text')} END AS found FROM documents)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "n0 AS (SELECT source AS tree, place, leaf AS node, n FROM l0)",
    ]
    for k in range(levels):
        grown = "SELECT tree, place // 3 AS place, CASE WHEN min(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node, (min(n) + 2) // 3 AS n, list(node ORDER BY place) AS kids"
        parts.append(f"n{k + 1} AS ({grown} FROM n{k} GROUP BY tree, place // 3)")
    parts.append(f"m0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place, node, count(*) OVER () AS n, tree AS of FROM n{levels})")
    for k in range(levels):
        parts.append(f"m{k + 1} AS (SELECT tree, place // 3 AS place, CASE WHEN min(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node, (min(n) + 2) // 3 AS n, list(node ORDER BY place) AS kids FROM m{k} GROUP BY tree, place // 3)")
    parts.append("f0 AS (SELECT doc_id, source, leaf, found, place, n, '' AS proof FROM l0)")
    step = """SELECT f.doc_id, f.source, f.leaf, CASE WHEN f.n = 1 THEN f.found ELSE sha256(array_to_string(list_transform(kids, lambda x, i: CASE WHEN i = f.place % 3 + 1 THEN f.found ELSE x END), '')) END AS found, f.place // 3 AS place, (f.n + 2) // 3 AS n,
 f.proof || CASE WHEN f.n = 1 THEN '' ELSE array_to_string(list_filter(kids, lambda x, i: i <> f.place % 3 + 1), '') END AS proof"""
    for k in range(levels):
        parts.append(f"f{k + 1} AS ({step} FROM f{k} f JOIN n{k + 1} p ON f.source IS NOT DISTINCT FROM p.tree AND f.place // 3 = p.place)")
    parts.append(f"g0 AS (SELECT f.doc_id, f.source, f.leaf, f.found, m.place, m.n, f.proof FROM f{levels} f JOIN m0 m ON f.source IS NOT DISTINCT FROM m.of)")
    for k in range(levels):
        parts.append(f"g{k + 1} AS ({step} FROM g{k} f JOIN m{k + 1} p ON f.place // 3 = p.place)")
    made = ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return f"WITH {made} SELECT doc_id, leaf, m0.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, found AS folded_root, found = r.node AS verified FROM g{levels} g JOIN m0 ON g.source IS NOT DISTINCT FROM m0.of CROSS JOIN m{levels} r"


MERKLE_MANIFEST = _merkle()
