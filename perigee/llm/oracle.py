"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from perigee.llm import decontam, fim, quality, ranking, sharding
from perigee.llm.common import UPPER

WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
FIVE = " || ' ' || ".join(["ws[i]", *[f"ws[i + {k}]" for k in range(1, 5)]])
SHINGLES = (
    "CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] "
    f"ELSE list_transform(range(1, len(ws) - 3), lambda i: {FIVE}) END"
)

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct({SHINGLES}) AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
      WHERE 100 * p.i >= 85 * (len(sa.sh) + len(sb.sh) - p.i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS d, doc_id AS r FROM s UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.d),
c AS (SELECT d, MIN(r) AS component_id FROM reach GROUP BY d)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.d = s.doc_id"""

LEAKS = f"""
WITH dw AS (SELECT doc_id, {WORDS.format(t=LOWER)} AS ws FROM documents),
d AS (SELECT doc_id, {SHINGLES} AS sh FROM dw),
iw AS (SELECT DISTINCT item_id, {WORDS.format(t=LOWER)} AS ws FROM benchmark),
it AS (SELECT item_id, len(ws) AS size, greatest(len(ws) - 4, 1) AS k, {SHINGLES} AS sh FROM iw WHERE len(ws) > 0),
di AS (SELECT doc_id, unnest(sh) AS h, unnest(range(len(sh))) AS pos, len(sh) AS total FROM d),
ii AS (SELECT item_id, size, k, unnest(sh) AS h, unnest(range(len(sh))) AS place FROM it),
st AS (SELECT DISTINCT doc_id, size, k, total, greatest(0, least(pos - place, total - k)) AS start FROM di JOIN ii ON di.h = ii.h),
wc AS (SELECT st.doc_id, size, k, st.total, start, di.h, COUNT(*) AS c
       FROM st JOIN di ON di.doc_id = st.doc_id AND di.pos >= start AND di.pos < start + k GROUP BY ALL),
ic AS (SELECT item_id, size, h, COUNT(*) AS c FROM ii GROUP BY ALL),
m AS (SELECT doc_id, item_id, start, SUM(least(wc.c, ic.c)) AS i, any_value(least(k, total)) + any_value(k) AS both_sizes
      FROM wc JOIN ic ON wc.size = ic.size AND wc.h = ic.h GROUP BY doc_id, item_id, start),
v AS (SELECT doc_id, item_id, start, CAST(i AS DOUBLE) / CAST(both_sizes - i AS DOUBLE) AS similarity
      FROM m WHERE 100 * i >= {decontam.SIMILARITY_PCT} * (both_sizes - i))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, similarity FROM v
QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

_PPM = "CAST(floor(1000000 * {a} / greatest({b}, 1)) AS BIGINT)"
_RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}
_STACK = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, base_failed, '{k}' AS ratio, {quality.MARGINS[k]} AS margin, {_PPM.format(a=a, b=b)} AS v FROM c"
    for k, (a, b) in _RATIOS.items()
)

QUALITY = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS.format(t="coalesce(text, '')")} AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w3 AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS h,
       unnest(range(1, len(ws) - 1)) AS pos FROM t WHERE len(ws) > 2),
twice AS (SELECT doc_id, pos FROM w3 QUALIFY COUNT(*) OVER (PARTITION BY doc_id, h) > 1),
cover AS (SELECT doc_id, COUNT(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
      len(ls) AS n_lines, length(text) - length(translate(text, '{UPPER}', '')) AS n_capitals
      FROM t LEFT JOIN cover ON cover.doc_id = t.doc_id),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
r AS ({_STACK}),
k AS (SELECT *, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS bucket FROM r),
g AS (SELECT lang, source, ratio, margin, bucket, COUNT(*) AS n, GROUPING(lang) + GROUPING(source) AS level FROM k
      WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, ratio, margin, bucket), (lang, ratio, margin, bucket), (ratio, margin, bucket))),
u AS (SELECT *, SUM(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto,
      SUM(n) OVER (PARTITION BY level, lang, source, ratio) AS docs FROM g),
q AS (SELECT level, lang, source, ratio, any_value(margin) AS margin, any_value(docs) AS docs,
      MIN(bucket) FILTER (WHERE 4 * upto >= docs) AS q25, MIN(bucket) FILTER (WHERE 4 * upto >= 3 * docs) AS q75 FROM u GROUP BY 1, 2, 3, 4),
m AS (SELECT *, greatest({quality.REACH} * (q75 - q25), q75 >> 3, margin) AS span FROM q WHERE level = 2 OR docs >= {quality.MIN_GROUP}),
j AS (SELECT r.doc_id, bool_and(r.v BETWEEN x.q25 - x.span AND x.q75 + x.span) AS inside
      FROM (SELECT r.*, coalesce(m0.level, m1.level, 2) AS level FROM r
            LEFT JOIN m m0 ON m0.level = 0 AND m0.lang = r.lang AND m0.source = r.source AND m0.ratio = r.ratio
            LEFT JOIN m m1 ON m1.level = 1 AND m1.lang = r.lang AND m1.ratio = r.ratio) r
      JOIN m x ON x.level = r.level AND x.ratio = r.ratio AND (x.level = 2 OR x.lang = r.lang) AND (x.level > 0 OR x.source = r.source)
      GROUP BY r.doc_id)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(j.inside, false) AS kept
FROM c LEFT JOIN j ON j.doc_id = c.doc_id"""


def _pass(x: str) -> str:
    """One pass of the keyed network over the number ``x``, rounds 0 to 7."""
    f = "CAST('0x' || substr(md5('0|' || i || '|' || {h}), 1, 15) AS BIGINT)"
    rounds = ", ".join(f"CAST({i} AS BIGINT)" for i in range(sharding.ROUNDS))
    return (
        f"list_reduce([{x}, {rounds}], lambda s, i: CASE WHEN i % 2 = 0 "
        f"THEN (s % a + {f.format(h='(s // a)')}) % a + (s // a) * a "
        f"ELSE s % a + ((s // a + {f.format(h='(s % a)')}) % b) * a END)"
    )


SHARDS = f"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
       lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
h AS (SELECT doc_id, hex(coalesce(text, '')) AS hx FROM documents),
y AS (SELECT doc_id, list_transform(range(0, length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM h),
d AS (SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
      xor(list_reduce(list_concat([4294967295], bytes), lambda c, z: xor(c >> 8, crc[(xor(c, z) & 255) + 1])), 4294967295) AS text_crc32
      FROM y, tbl),
k AS (SELECT *, CAST('0x' || substr(md5('{{"doc_id":' || doc_id || ',"size":' || size || ',"text_crc32":' || text_crc32 || '}}'), 1, 8) AS BIGINT) % 4096 AS bucket FROM d),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY bucket, doc_id, size, text_crc32) - 1 AS row_no, COUNT(*) OVER () AS n FROM k),
ab AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM o),
walk AS (SELECT row_no, n, a, b, {_pass('row_no')} AS place FROM ab
         UNION ALL SELECT row_no, n, a, b, {_pass('place')} FROM walk WHERE place >= n)
SELECT ab.doc_id, ab.size, ab.text_crc32, 'rows' AS law, CAST(place % 8 AS INTEGER) AS shard, CAST(place // 8 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, ab.row_no
FROM ab JOIN walk ON walk.row_no = ab.row_no AND walk.place < ab.n"""

_H = "CAST('0x' || substr(digest, {i}, 8) AS BIGINT)"
FILL_IN_MIDDLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('{fim.KEY}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_H.format(i=1)} % (len(u) + 1) AS x, {_H.format(i=9)} % (len(u) + 1) AS y,
      {_H.format(i=17)} AS h3, {_H.format(i=25)} AS h4 FROM t),
c AS (SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {fim.PLAIN_FROM} THEN 'plain'
      WHEN h4 % 100 < {fim.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(x, y)], '') AS p,
      array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
g AS (SELECT COUNT(*) FILTER (WHERE len(ts) > 0) AS docs, CAST(SUM(len(ts)) AS BIGINT) AS total FROM d),
m AS (SELECT doc_id, {ranking.M_BASE} + ({ranking.M_SLOPE} * len(ts) * docs) // total AS m FROM d, g),
x AS (SELECT doc_id, unnest(ts) AS t FROM d),
tf AS (SELECT doc_id, t, COUNT(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT t, COUNT(*) AS df FROM tf GROUP BY t),
i AS (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, t, COUNT(*) AS c FROM i GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, g),
s AS (SELECT item_id, tf.doc_id, CAST(SUM(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {ranking.TOP}"""

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": SHARDS,
    "op6_minhash_neardup": NEAR_DUPLICATES,
    "op8_quality_rules": QUALITY,
    "op9_decontamination": LEAKS,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_ranked_search": RANKED_SEARCH,
}
