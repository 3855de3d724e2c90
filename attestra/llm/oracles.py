"""SQL for the corpus queries that it can express, computed another way than the operators do."""

from __future__ import annotations

from . import licenses, quality, secrets, url_templates
from .common import SPACES, WORDS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(xs: list[str]) -> str:
    return ", ".join(map(quoted, xs))


#: Windows are rows here, grouped by their text; covered words are counted as distinct positions.
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORDS}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT r, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM t WHERE len(ws) >= {quality.WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM w) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS n_shouts,
    len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({names(quality.STOP_WORDS)}))) AS n_stop FROM t LEFT JOIN cover c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 15.0 AND n_symbols::DOUBLE / n_words <= 0.3 AND n_shouts::DOUBLE / n_words <= 0.4 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5 AND n_stop::DOUBLE / n_words >= 0.01 AS kept FROM f"""


def found(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the k-th match starts after the first k gaps and the k - 1 matches before it."""
    p = quoted(pattern)
    return f"""(SELECT r, {order} AS kind, start, start + length(hit) AS stop, val FROM (SELECT r, hits[k] AS hit, vals[k] AS val,
        (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0))::BIGINT AS start
        FROM (SELECT r, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT r, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p}))))
        WHERE length(val) >= {least})"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
base AS ({' UNION ALL '.join(found(kind, i, *rule) for i, (kind, rule) in enumerate(secrets.KINDS.items()))}),
wide AS (SELECT w.* FROM {found(secrets.OWNED, len(secrets.KINDS), secrets.CANDIDATE, 0, 20)} w
    WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.start < w.stop AND w.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
freq AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM every JOIN d USING (r) GROUP BY val),
judged AS (SELECT e.*, owners <= 1 AND repos <= 2 AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS shown FROM every e JOIN freq USING (val)),
s AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN s USING (r)"""

#: Base 32 of a digest: forty hexadecimal digits are thirty-two groups of five bits.
BITS = "array_to_string(list_transform(string_split(sha1(html), ''), lambda h: right('000' || bin(strpos('0123456789abcdef', h) - 1), 4)), '')"
DIGEST = f"array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: substr({BITS}, 5 * i + k, 1)::INT * (16 >> (k - 1))))::BIGINT, 1)), '')"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS winner FROM p),
h AS (SELECT page_id, winner, html, {BITS} AS bits FROM w)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {DIGEST.replace(BITS, 'bits')} AS payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to FROM h"""

#: Links by an inverted index of shingles, components by repeated minimum.
NEAR = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS v FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.v = b.v AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM d LEFT JOIN n USING (r) JOIN least USING (r)"""



def word_list(phrase: str) -> str:
    return "[" + names(phrase.split()) + "]"


def licence_sql() -> str:
    """Alignments as groups of (row, template, offset) over unnested words joined with the templates' words, spelled out as rows."""
    index = licenses.Index()
    words = ", ".join(f"({t}, {p}, {quoted(w)})" for t, ws in enumerate(index.words) for p, w in enumerate(ws))
    in_place = " AND ".join(
        f"(template <> {t} OR ({' AND '.join(f'off + {at} >= 0 AND ws[off + {at} + 1:off + {at + len(index.phrases[p].split())}] = {word_list(index.phrases[p])}' for p, at in keys)}))" for t, keys in enumerate(index.places)
    )
    label_of = "CASE template " + " ".join(f"WHEN {t} THEN {quoted(x.label)}" for t, x in enumerate(index.templates)) + " END"
    # The three phrases, spelled out here.
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    leads = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, 4))
    stands = lambda p: " AND ".join(f"w{i or ''} = {quoted(x)}" for i, x in enumerate(p.split()))
    base_of = "CASE " + " ".join(f"WHEN {stands(p)} THEN {quoted(label)}" for label, p in phrases.items()) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {quoted(licenses.WORD)}) AS ws FROM documents),
e AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT base) AS base FROM (SELECT r, pos, {base_of} AS base FROM (SELECT *, {leads} FROM e WINDOW o AS (PARTITION BY r ORDER BY pos))) WHERE base IS NOT NULL GROUP BY r),
words(template, p, w) AS (VALUES {words}),
t AS (SELECT * FROM e WHERE w IN (SELECT w FROM words)),
seen AS (SELECT w, count(DISTINCT r) AS df FROM t GROUP BY w),
v AS (SELECT template, p, w, coalesce(df, 0) AS df, ln(1 + ((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM words LEFT JOIN seen USING (w)),
rare AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY template ORDER BY df, w, p) <= {licenses.RAREST}),
whole AS (SELECT template, sum(idf) AS total, least(count(*), {licenses.RAREST}) AS k FROM v GROUP BY template),
near AS (SELECT r, template, pos - p AS off, any_value(k) AS k FROM t JOIN rare USING (w) JOIN whole USING (template) GROUP BY r, template, pos - p HAVING count(*) >= (any_value(k) + 1) // 2),
sure AS (SELECT r, template, off FROM near JOIN d USING (r) WHERE {in_place}),
good AS (SELECT s.r, s.template, {label_of.replace("CASE template", "CASE s.template")} AS label, sum(idf) / any_value(total) AS share FROM sure s JOIN whole ON whole.template = s.template JOIN v ON v.template = s.template JOIN t ON t.r = s.r AND t.w = v.w AND t.pos = s.off + v.p GROUP BY s.r, s.template, s.off HAVING share >= 0.75),
m AS (SELECT r, list(DISTINCT label) AS own, round(least(max(share), 1), 6) AS score FROM good GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(own, []))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


def url_sql() -> str:
    """The tree level by level as a recursion over distinct shaped paths; counts of nodes, branches and pools are windows, groups a fold."""
    rules = sorted(url_templates.RULES, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2]), reverse=True)
    fits = lambda h, p: f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {quoted(pick(v, h, p))}" for v, h, p in rules) + " END"
    stem = r"regexp_extract(s, '^(.*?)(\.[A-Za-z0-9]{1,5})?$', 1)"
    mark = f"CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{16,}}$') THEN '{{id}}' WHEN regexp_matches({stem}, '[0-9]{{3,}}') THEN regexp_replace({stem}, '[0-9]+', '{{n}}', 'g') ELSE {stem} END"
    last, new = "xs[len(xs)]", "ys[1]"
    share = f"(({last}.b + {new}.b) / nullif({last}.n + {new}.n, 0))"
    alike = f"coalesce(abs({last}.b / nullif({last}.n, 0) - {new}.b / nullif({new}.n, 0)) <= 2 * sqrt({share} * (1 - {share}) * (1 / nullif({last}.n, 0) + 1 / nullif({new}.n, 0))), true)"
    both = f"{{'top': {new}.top, 'rest': {last}.rest OR {new}.rest, 'n': {last}.n + {new}.n, 'b': {last}.b + {new}.b, 'segs': {last}.segs + {new}.segs}}"
    shape = f"{mark} || regexp_extract(s, '^(.*?)(\\.[A-Za-z0-9]{{1,5}})?$', 2)".replace("\\\\", "\\")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, url, contains(url, '://') AS there, regexp_replace(url, '(?s)^.*?://', '') AS rest FROM pages),
h AS (SELECT page_id, coalesce(CASE WHEN there THEN translate(regexp_extract(rest, '(?s)^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END, '') AS host,
    coalesce(CASE WHEN there THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END, '') AS path FROM u),
k AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
p AS (SELECT page_id, host, path, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape}) AS segs, (bad IS NOT NULL)::BIGINT AS n_labels, coalesce(bad::BIGINT, 0) AS n_bad FROM h LEFT JOIN k USING (page_id)),
g AS (SELECT host, segs, sum(n_labels)::DOUBLE AS n_labels, sum(n_bad)::DOUBLE AS n_bad, '' AS template, len(segs) > 0 AS open, 0 AS level FROM p GROUP BY host, segs
    UNION ALL
    SELECT host, segs, n_labels, n_bad, template || '/' || CASE WHEN paths = 1 THEN array_to_string(segs[level + 1:], '/') WHEN gs[spot].segs = 1 THEN seg
        WHEN gs[spot].rest OR (spot = 1 AND len(list_filter(gs, lambda x: x.rest)) = 0) THEN '*' ELSE '*' || (spot - 1)::VARCHAR END, paths > 1 AND len(segs) > level + 1, level + 1
    FROM (SELECT *, len(list_filter(gs, lambda x: x.top < key)) + 1 AS spot FROM (SELECT *, list_reduce(list_transform(items, lambda x: [x]), lambda xs, ys: CASE WHEN {alike} THEN xs[1:len(xs) - 1] || [{both}] ELSE xs || ys END) AS gs
        FROM (SELECT *, list_sort(list(DISTINCT {{'top': key, 'rest': bin IS NULL, 'n': pool_labels, 'b': pool_bad, 'segs': pool_segs}}) OVER node) AS items
        FROM (SELECT *, coalesce(bin, (pool_bad + rate) / (pool_labels + 1) * 1000) AS key
        FROM (SELECT *, sum(n_labels) OVER pool AS pool_labels, sum(n_bad) OVER pool AS pool_bad, count(DISTINCT seg) OVER pool AS pool_segs
        FROM (SELECT *, CASE WHEN abs(own - rate) > sqrt(4 + 2 * ln(children)) * sqrt(greatest(rate * (1 - rate), own * (1 - own)) / (branch_labels + 1)) THEN floor(own * 1000) END AS bin
        FROM (SELECT *, (branch_bad + rate) / (branch_labels + 1) AS own
        FROM (SELECT *, segs[level + 1] AS seg, (sum(n_bad) OVER node + 0.5::DOUBLE) / (sum(n_labels) OVER node + 1) AS rate, count(*) OVER node AS paths, count(DISTINCT segs[level + 1]) OVER node AS children, sum(n_labels) OVER branch AS branch_labels, sum(n_bad) OVER branch AS branch_bad
        FROM g WHERE open WINDOW node AS (PARTITION BY host, template), branch AS (PARTITION BY host, template, segs[level + 1])))) WINDOW pool AS (PARTITION BY host, template, bin))) WINDOW node AS (PARTITION BY host, template))))),
e AS (SELECT *, sum(n_labels) OVER t AS t_labels, sum(n_bad) OVER t AS t_bad, sum(n_labels) OVER o AS h_labels, sum(n_bad) OVER o AS h_bad FROM g WHERE NOT open WINDOW t AS (PARTITION BY host, template), o AS (PARTITION BY host)),
s AS (SELECT (sum(n_bad) + 0.5::DOUBLE) / (sum(n_labels) + 1) AS share FROM p),
j AS (SELECT host, segs, (t_bad + 4 * (h_bad + 4 * share) / (h_labels + 4)) / (t_labels + 4) AS bad_share FROM e, s)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, coalesce({case(lambda v, h, p: v)}, CASE WHEN bad_share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN j USING (host, segs)"""


#: Tokens as a list, parts as its slices.
INFILL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*{WORDS}|{SPACES}') AS ts, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(ts)::BIGINT AS n, {', '.join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(ts[1:lo], '') AS pre, array_to_string(ts[lo + 1:hi], '') AS mid, array_to_string(ts[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


#: Sources by size a unit of weight: those before the first that its share does not exceed stop at three times their size.
MIXTURE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source) AS place FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest, sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights FROM o),
k AS (SELECT arg_min(rest, place) AS rest, arg_min(weights, place) AS weights, min(place) AS place FROM r WHERE rest * w <= 3 * source_size * weights),
t AS (SELECT source, source_size, CASE WHEN r.place < k.place THEN 3 * source_size::DOUBLE ELSE k.rest * w / k.weights END AS target FROM r, k),
f AS (SELECT *, floor(target + 0.5)::BIGINT AS flow FROM t),
b AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN flow % source_size ELSE 0 END AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM b"""


#: CRC-32 bit by bit; then the best edits of all conversations a row a round, with the lines that they give.
CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
CONVERSATIONS = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
b AS (SELECT *, {CRC} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b),
n AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS last, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (last || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM f GROUP BY conv_id),
ins(q, r, paid, edits, lines) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:' || chr(10))),
ops(edit, r, ini, t, paid) AS (VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0), ('R', 0, '', 2, 3), ('R', 1, '', 2, 3), ('R', 2, '', 3, 3), ('R', 3, '', 2, 3), ('D', 0, '', 0, 4), ('D', 1, '', 1, 4), ('D', 2, '', 2, 4), ('D', 3, '', 3, 4)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS p FROM g
    UNION ALL
    SELECT f.conv_id, f.i, ops.t, min({{'cost': (p.cost + ins.paid + ops.paid + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT, 'audit': p.audit || ins.edits || edit,
        'lines': p.lines || ins.lines || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE ops.r WHEN 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10) END}})
    FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1 JOIN ins USING (q) JOIN ops ON ops.r = ins.r AND (edit <> 'K' OR ops.ini = f.ini) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY f.conv_id, f.i, ops.t),
e AS (SELECT g.conv_id, min({{'cost': (p.cost + ins.paid)::BIGINT, 'audit': p.audit || edits, 'lines': p.lines || ins.lines}}) AS p FROM best JOIN g ON g.conv_id IS NOT DISTINCT FROM best.conv_id AND i = m JOIN ins ON ins.q = best.q AND ins.r IN (0, 3) GROUP BY g.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.p.cost, 0) AS cost, coalesce(e.p.audit, '') AS audit,
    sha256(coalesce(left(e.p.lines, length(e.p.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {"op13_edit_lattice_repair": CONVERSATIONS, "op12_flow_mixture": MIXTURE, "op11_chunked_infill": INFILL, "op2_rare_token_index": licence_sql(), "op6_path_templates": url_sql(), "op1_secret_ownership": SECRETS, "op3_warc_segments": WARC, "op8_quality_rules": QUALITY, "op9_hyperminhash": NEAR}
