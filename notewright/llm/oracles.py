"""SQL for the operators that SQL can express, on the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLANTED = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '#', '\h'), '<', '\l')"

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
), turns AS (
  SELECT *, length({_ESCAPED.format('text')}) + length(replace(replace({_ESCAPED.format('role')}, ':', '\\c'), chr(10), '\\n')) + length('### ') + length(':') + 1 + length('</turn>') + 1 AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
 b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
 i AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS u(p)),
 x AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS u(p)),
 h AS (SELECT doc_id, x.k, p, item_id FROM x JOIN i ON x.k = i.k AND x.s = i.s),
 hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + o AS at FROM h, unnest(range(0, k)) AS u(o)) GROUP BY 1),
 item AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, coalesce(item.x, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS x FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(p) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common.n >= 80 * (na.n + nb.n - common.n)),
 reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""


_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _count(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


#: Character classes in order; punctuation without the symbols, which come before it, and all else are counted below.
_KINDS = (_SPACE, "[#*$%&|<>]", r"\p{Ll}", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}]", r"\p{M}", r"\p{N}")
_TERM = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS c FROM d, unnest(range(1, len(w) - 1)) AS u(p)),
 rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM tri, unnest([0, 1, 2]) AS v(o) WHERE c > 1 GROUP BY 1),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 base AS (SELECT doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, length(text) AS size, [{', '.join(_count(k) for k in _KINDS)}] AS c, {_count(r'[\p{P}]')} - ({_count('[#*%&]')}) AS punctuation,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
 full_ AS (SELECT * EXCLUDE (c), list_concat(c, [punctuation, size - punctuation - list_sum(c)]) AS c, c[2] AS n_symbols, size - c[1] AS word_chars FROM base),
 good AS (SELECT CASE WHEN pool OR lang IS NULL THEN 'all' ELSE 'l:' || lang END AS k, w, c FROM full_, unnest([true, false]) AS x(pool) WHERE NOT base_failed AND (pool OR lang IS NOT NULL)),
 cw AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(list_transform(w, lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS word FROM good) GROUP BY 1, 2),
 tot AS (SELECT k, sum(n) AS t FROM cw GROUP BY 1),
 top AS (SELECT k, word, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, word) AS r FROM cw QUALIFY r <= 64),
 slots AS (SELECT k, r, n / t AS q FROM top JOIN tot USING (k) UNION ALL SELECT k, 0, (t - sum(n)) / t FROM top JOIN tot USING (k) GROUP BY k, t),
 cc AS (SELECT k, i, sum(c[i]) AS n FROM good, unnest(range(1, 10)) AS u(i) GROUP BY 1, 2),
 cs AS (SELECT k, i, n / sum(n) OVER (PARTITION BY k) AS q FROM cc),
 doc AS (SELECT f.*, coalesce(t.k, 'all') AS k FROM full_ f LEFT JOIN tot t ON t.k = 'l:' || f.lang),
 hist AS (SELECT doc_id, coalesce(r, 0) AS r, count(*) AS n FROM (SELECT doc_id, k, unnest(list_transform(w, lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS word FROM doc) LEFT JOIN top USING (k, word) GROUP BY 1, 2),
 wd AS (SELECT doc_id, sqrt(greatest(0, least(1, sum({_TERM}) / 2))) AS v FROM (SELECT doc_id, q, coalesce(hist.n, 0) / n_words AS p FROM doc JOIN slots USING (k) LEFT JOIN hist USING (doc_id, r) WHERE n_words > 0) GROUP BY 1),
 cd AS (SELECT doc_id, sqrt(greatest(0, least(1, sum({_TERM}) / 2))) AS v FROM (SELECT doc_id, q, c[i] / size AS p FROM doc JOIN cs USING (k) WHERE size > 0) GROUP BY 1)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND coalesce(cd.v, 1) <= 0.2 AND coalesce(wd.v, 1) <= 0.5 AS kept, round(coalesce(cd.v, 1), 6) AS class_distance, round(coalesce(wd.v, 1), 6) AS word_distance
FROM doc LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
"""

#: For texts without wide stops and scripts without blanks, as those of the test tables are.
SUBSTRING = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract(coalesce(text, ''), '^{_SPACE}*') AS head,
  regexp_extract_all(coalesce(text, ''), '[.!?]{_SPACE}+|[^\x20\x09-\x0D](?s:.)*?(?:[.!?]{_SPACE}+|{_SPACE}*\n{_SPACE}*|{_SPACE}*$)') AS s FROM documents),
 s AS (SELECT doc_id, i, s[i] AS raw, regexp_extract_all(translate(s[i], '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM d, unnest(range(1, len(s) + 1)) AS u(i)),
 c AS (SELECT doc_id, i, raw, array_to_string(w, ' ') AS t, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e, max(i) OVER (PARTITION BY doc_id) AS m FROM s),
 f AS (SELECT a.doc_id, a.i AS a, greatest(b.i, a.i + 1) AS b FROM (SELECT *, e - n + 20 AS least_ FROM c) a ASOF JOIN c b ON a.doc_id = b.doc_id AND b.e >= a.least_ WHERE greatest(b.i, a.i + 1) <= a.m),
 g AS (SELECT b.doc_id, least(a.i, b.i - 1) AS a, b.i AS b FROM (SELECT *, e - 20 AS most FROM c) b ASOF JOIN (SELECT *, e - n AS begin_ FROM c) a ON a.doc_id = b.doc_id AND a.begin_ <= b.most WHERE least(a.i, b.i - 1) >= 1),
 r AS (SELECT * FROM f UNION SELECT * FROM g UNION SELECT doc_id, i, i FROM c WHERE n >= 40),
 l AS (SELECT doc_id, list(t ORDER BY i) AS t FROM c GROUP BY 1),
 k AS (SELECT r.*, array_to_string(l.t[a:b], ' ') AS key FROM r JOIN l USING (doc_id)),
 z AS (SELECT doc_id, a, b FROM (SELECT *, first_value(doc_id) OVER w AS d0, first_value(a) OVER w AS a0 FROM k WINDOW w AS (PARTITION BY key ORDER BY doc_id, a, b)) WHERE doc_id <> d0 OR a <> a0),
 gone AS (SELECT DISTINCT doc_id, i FROM z, unnest(range(a, b + 1)) AS u(i)),
 o AS (SELECT c.doc_id, count(*) AS n, count(gone.i) AS x, string_agg(raw, '' ORDER BY c.i) FILTER (gone.i IS NULL) AS stay FROM c LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(x, 0) = 0 THEN text WHEN stay IS NULL THEN '' ELSE head || stay END AS text, coalesce(n, 0) AS n_sentences, coalesce(x, 0) AS n_removed, coalesce(x, 0) > 0 AS cut FROM d LEFT JOIN o USING (doc_id)
"""


def _centroids(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds one after another, each a pair of tables: who is nearest, and the floors of the means."""
    square = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    nearest = f"SELECT x.r, min([{square}, c.k]) AS m FROM x, c{{i}} c GROUP BY x.r"
    out = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v, embedding AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS k, v FROM x ORDER BY sha256('2:' || vec_id) NULLS LAST, e LIMIT {k}),"""
    for i in range(rounds):
        out += f"""
 a{i} AS MATERIALIZED ({nearest.format(i=i)}),
 m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT m[2] AS k, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN x USING (r), unnest(range(1, {dims + 1})) AS u(j) GROUP BY 1, 2) GROUP BY k),
 c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(CAST(m.v AS BIGINT[]), c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k)),"""
    return f"""{out}
 z AS MATERIALIZED ({nearest.format(i=rounds)})
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM z JOIN x USING (r) JOIN c{rounds} c ON c.k = m[2]
"""


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
#: Equal words q apart, as islands by q; of one stretch the smallest q is its period.
RUNS = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, xor({_CRC}, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, len(w) AS n, 3 + (h // 10) % 8 AS k FROM d),
 p AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS w FROM s),
 t AS MATERIALIZED (SELECT r, n, i, w[i + 1] AS x FROM p, unnest(range(0, n)) AS u(i)),
 e AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.x = y.x AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
 g AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
 z AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM g GROUP BY r, start, length),
 b AS (SELECT * FROM z x WHERE NOT EXISTS (FROM z y WHERE x.r = y.r AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))),
 l AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM z GROUP BY 1),
 gone AS (SELECT DISTINCT r, i FROM z, unnest(range(start + period, start + length)) AS u(i)),
 o AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS stay FROM t ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(stay, '')) AS collapsed_sha256
FROM p LEFT JOIN l USING (r) LEFT JOIN b USING (r) LEFT JOIN o USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op6_chat_format": CHAT, "op7_decontaminate": DECONTAMINATE, "op8_substring_dedup": SUBSTRING, "op9_jaccard_join": NEAR, "op10_quality_rules": QUALITY, "op11_centroids": _centroids(), "op12_periodic_runs": RUNS}
