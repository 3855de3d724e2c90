"""SQL of the resolution queries, step by step as named relations; each query takes the steps it needs."""

from __future__ import annotations

from ..functions import codes
from ..operators import catalog, scoring
from . import texts_sql as t
from .derived import sql

NORMAL = "regexp_replace(upper(coalesce({}, '')), '[^A-Z0-9]', '', 'g')"


def normal(c: str) -> str:
    return NORMAL.format(c)


def tier(c: str) -> str:
    return f"CASE WHEN {c} >= 0.95 THEN 'high' WHEN {c} >= 0.85 THEN 'medium' WHEN {c} >= 0.70 THEN 'low' ELSE 'unresolved' END"


def family_of(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {t.quoted(h)})' for h in hints)} THEN '{f}'" for f, hints in codes.FAMILY_HINTS) + " END"


D = "::DOUBLE"
TITLES = t.parsed("(SELECT title, brand AS hint FROM listings_raw UNION SELECT title, NULL FROM listings_raw UNION SELECT title, page_brand FROM requests_raw)")
SIZE = "CASE WHEN said <> 'unknown' THEN said " + " ".join(f"WHEN gender = '{g}' THEN '{s}'" for g, s in catalog.CHILD_SIZES.items()) + " WHEN gender IN ('men', 'women', 'unisex') THEN 'adult' ELSE '' END"
#: Listings by code with their title's fields.
PLAIN = f"""seg AS (SELECT DISTINCT l.*, {normal("regexp_replace(part, '\\([^)]*\\)', '', 'g')")} AS style_code FROM (SELECT product_id, unnest(string_split(style_id, '/')) AS part FROM listings_raw) JOIN listings_raw l USING (product_id)),
    plain AS (SELECT style_code, product_id, style_id, l.title, coalesce(nullif(p.brand, ''), l.brand) AS brand, p.model, colorway, lower(l.gender) AS gender, p.size_category AS said, release_date, retail_price, product_type, ord
        FROM seg l JOIN titled p ON p.title = l.title AND p.hint = l.brand WHERE style_code <> ''),
    base AS (SELECT style_code, arg_min(title, ord) AS title0, arg_min(colorway, ord) AS colorway0, arg_min(gender, ord) AS gender0, arg_min(said, ord) AS said0 FROM plain GROUP BY style_code)"""
SAID = lambda f: f"CASE WHEN r.title <> '' THEN p.{f} ELSE '' END"
SHOWN = lambda c: f"CASE WHEN seen THEN {c} ELSE '' END"
KNOWN = lambda a, b: f"CASE WHEN ({a}) NOT IN ('', 'unknown') THEN {a} WHEN ({b}) NOT IN ('', 'unknown') THEN {b} ELSE 'unknown' END"
BEST = lambda f, c: f"CASE WHEN seen AND {c} <> '' AND {c}_confidence >= 0.5 THEN {c} ELSE coalesce(nullif({SAID(f)}, ''), {SHOWN(c)}) END"
OBSERVED = f"""obs AS (SELECT query_id, {BEST('brand', 'v_brand')} AS brand, {BEST('model', 'v_model')} AS model,
        list_filter([{SHOWN('v_colorway')}, {SHOWN('v_official')}, page_colour, {SAID('colorway_text')}], lambda x: x <> '') AS colorways,
        {KNOWN(SAID('gender'), SHOWN('v_gender'))} AS gender, {KNOWN(SAID('size_category'), SHOWN('v_size_category'))} AS size_category, price, list_filter(string_split(labeled, ','), lambda x: x <> '') AS labeled_codes,
        {normal(SHOWN('v_style_code'))} AS tag_code, lower(trim({SHOWN('v_official')})) AS nickname, {SAID('collab')} AS collab, NOT seen OR v_consistent AS images_consistent,
        seen AND {SAID('size_category')} IN ('', 'unknown') AS size_from_photos, seen AND {SAID('model')} IN ('', 'unknown') AS model_from_photos, seen AND {SAID('brand')} IN ('', 'unknown') AS brand_from_photos,
        seen AND v_model_confidence >= 0.9 AS model_certain, seen AND v_brand_confidence >= 0.9 AS brand_certain
    FROM requests_raw r LEFT JOIN titled p ON p.title = r.title AND p.hint = r.page_brand)"""
#: Catalogue hits: all products that share a word with a text, scored by whole impacts.
SEARCH = """words_of AS (SELECT product_id, style_id, len(ws) AS size, unnest(ws) AS w FROM (SELECT product_id, style_id, list_distinct(list_filter(string_split_regex(lower(title || ' ' || colorway), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM listings_raw)),
    impacts AS (SELECT w, round(1000 * ln(1 + (SELECT count(DISTINCT product_id) FROM words_of)::DOUBLE / count(*)))::BIGINT AS impact FROM words_of GROUP BY w),
    asks AS (SELECT query_id, 0::BIGINT AS ask, title AS text FROM requests_raw WHERE title <> '' UNION ALL SELECT query_id, 1, v_brand || ' ' || v_model || ' ' || coalesce(nullif(v_official, ''), v_colorway) FROM requests_raw WHERE seen AND v_brand <> '' AND v_model <> ''),
    asked AS (SELECT DISTINCT text, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS w FROM asks),
    matched AS (SELECT text, product_id, style_id, size, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (w) JOIN words_of USING (w) GROUP BY ALL),
    hits AS (SELECT query_id, ask, product_id, style_id, score, rank FROM asks JOIN (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, size, product_id) AS rank FROM matched QUALIFY rank <= 10) USING (text)),
    once AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rn FROM (SELECT query_id, product_id, style_id, min(ask * 1000 + rank) AS ord FROM hits GROUP BY ALL)),
    listed_parts AS (SELECT query_id, rn, unnest(ps) AS shown, unnest(range(len(ps))) AS i FROM (SELECT *, list_transform(string_split(style_id, '/'), lambda x: trim(regexp_replace(x, '\\([^)]*\\)', '', 'g'))) AS ps FROM once WHERE rn <= 20))"""
#: Evidence: pages, photos (codes here are of one format, whose first half is another brand's), neighbours, web.
POOL = f"""{SEARCH},
    web AS (SELECT query_id, style_code, display, detail, trust::DOUBLE AS trust, agreement, ord, row_number() OVER (PARTITION BY query_id ORDER BY trust DESC, agreement DESC, ord) AS rn FROM signals_raw WHERE kind = 'web'),
    photo AS (SELECT query_id, unnest([v_style_code] || string_split(guesses, ',')[1:3]) AS raw, unnest(range(1 + len(string_split(guesses, ',')[1:3]))) AS i, {family_of("lower(v_brand || ' ' || v_model)")} AS hint FROM requests_raw WHERE seen),
    evidence AS (SELECT query_id, style_code, display, 'page_sku' AS kind, detail, weight::DOUBLE AS weight, NULL::DOUBLE AS similarity, ord FROM signals_raw WHERE kind = 'page_sku'
        UNION ALL SELECT query_id, CASE WHEN hint = 'adidas' THEN substr(raw, 1, 6) ELSE {normal('raw')} END, CASE WHEN hint = 'adidas' THEN substr(raw, 1, 6) ELSE raw END, CASE WHEN i = 0 THEN 'vision_tag' ELSE 'vision_guess' END, CASE WHEN i = 0 THEN 'read on a tag or box' ELSE 'recalled from photos' END, CASE WHEN i = 0 THEN 0.9::DOUBLE ELSE 0.35::DOUBLE END, NULL, 1000 + i FROM photo WHERE regexp_matches(raw, '^[A-Z]{{2}}[0-9]{{4}}-[0-9]{{3}}$') AND (hint IS NULL OR hint IN ('nike', 'adidas'))
        UNION ALL SELECT query_id, style_code, display, 'embedding', printf('cosine %.3f', similarity), similarity, similarity, 2000 + ord FROM signals_raw WHERE kind = 'embedding' AND similarity >= 0.7
        UNION ALL SELECT query_id, style_code, display, 'web', detail, least(1.0::DOUBLE, trust / 2), NULL, 3000 + rn FROM web WHERE rn <= 12
        UNION ALL SELECT query_id, {normal('shown')}, shown, 'catalog_search', 'catalog text search', 0.2::DOUBLE, NULL, 4000 + rn * 100 + i FROM listed_parts),
    edges AS (SELECT query_id, style_code, kind, detail, arg_min(weight, ord) AS weight, arg_min(display, ord) AS display, max(similarity) AS similarity, min(ord) AS ord FROM evidence GROUP BY ALL),
    pool AS (SELECT query_id, style_code, arg_min(display, ord) AS display, list({{'kind': kind, 'weight': weight}} ORDER BY ord) AS ev, string_agg(kind || ':' || detail, '|' ORDER BY ord) AS evidence, max(similarity) AS similarity, min(ord) AS ord FROM edges GROUP BY ALL)"""
RAW = ", ".join(map(sql, ("listings_raw", "requests_raw", "signals_raw", "verdicts_raw")))
#: All pairs of model texts and all colour texts that any step compares.
COMPARED = f"""named AS (SELECT DISTINCT b.style_code, b.title, p.model AS own FROM plain b JOIN titled p ON p.title = b.title AND p.hint IS NULL),
    compared AS (SELECT title0 AS a, title AS b FROM plain JOIN base USING (style_code) UNION SELECT o.model, b.model FROM pool JOIN obs o USING (query_id) JOIN plain b USING (style_code) WHERE o.model <> '' AND b.model <> ''
        UNION SELECT o.model, n.own FROM pool JOIN obs o USING (query_id) JOIN named n USING (style_code) WHERE o.model <> '' AND n.own <> '' UNION SELECT o.model, b.title FROM pool JOIN obs o USING (query_id) JOIN plain b USING (style_code)),
    {t.alike('compared')},
    painted AS (SELECT unnest(colorways) AS txt FROM obs UNION SELECT colorway FROM plain UNION SELECT colorway_text FROM titled),
    {t.tinted('painted')}"""
LISTED = f"""pairs0 AS (SELECT p.*, b.*, count(*) OVER (PARTITION BY p.style_code) AS n, {t.tint_similarity('x', 'y')} AS tint, s.sim FROM plain p JOIN base b USING (style_code) JOIN alike s ON s.a = b.title0 AND s.b = p.title JOIN tinted x ON x.txt = b.colorway0 JOIN tinted y ON y.txt = p.colorway),
    amb AS (SELECT style_code, count(*) AS n_listings, coalesce(bool_or(coalesce(sim < 0.9, false) OR coalesce(colorway0 <> '' AND colorway <> '' AND tint < 0.9, false) OR said0 <> said OR (gender0 <> '' AND gender <> '' AND gender0 <> gender)), false) AS ambiguous FROM pairs0 GROUP BY style_code),
    best AS (SELECT * FROM plain QUALIFY row_number() OVER (PARTITION BY style_code ORDER BY colorway <> '' DESC, release_date <> '' DESC, retail_price IS NOT NULL DESC, length(title) DESC, ord) = 1),
    listed AS (SELECT b.*, {SIZE} AS size_category, a.ambiguous, a.n_listings FROM best b JOIN amb a USING (style_code))"""
WEB = f"least(1.0{D}, 0.35{D} + 0.15{D} * coalesce(w.agreement, 1) + 0.1{D} * least(coalesce(w.trust, 0.5{D}), 2.0{D}))"
VALUE = f"CASE e.kind WHEN 'page_sku' THEN CASE WHEN e.weight >= 0.85 THEN 1.0{D} ELSE 0.8{D} END WHEN 'vision_tag' THEN 0.9{D} WHEN 'web' THEN wv WHEN 'vision_guess' THEN 0.35{D} WHEN 'catalog_search' THEN 0.15{D} WHEN 'embedding' THEN 0.1{D} ELSE 0.0{D} END"
FLAG = lambda c: f"CASE WHEN {c} THEN 1.0{D} WHEN NOT {c} THEN 0.0{D} END"
SCORED = f"""cand AS (SELECT c.query_id, c.style_code, c.display, c.ev, c.similarity, c.ord, coalesce(l.title, '') AS name, coalesce(l.brand, '') AS brand, coalesce(l.model, '') AS model, coalesce(l.colorway, '') AS colorway, coalesce(l.gender, '') AS gender,
        coalesce(l.size_category, '') AS size_category, coalesce(l.release_date, '') AS release_date, l.retail_price, coalesce(l.product_type, '') AS product_type, coalesce(l.ambiguous, false) AS disagree, {WEB} AS wv,
        o.brand AS o_brand, o.model AS o_model, o.colorways, o.gender AS o_gender, o.size_category AS o_size, o.price, o.labeled_codes, o.tag_code, o.nickname, o.collab, o.images_consistent, o.size_from_photos, o.model_from_photos, o.brand_from_photos, o.model_certain, o.brand_certain
        FROM pool c JOIN obs o USING (query_id) LEFT JOIN listed l USING (style_code) LEFT JOIN web w ON w.query_id = c.query_id AND w.style_code = c.style_code),
    fact AS (SELECT c.*, CASE WHEN c.model <> '' THEN c.model WHEN name <> '' THEN p.model ELSE '' END AS own, p.colorway_text AS name_colours, {t.compatible('o_size', 'c.size_category')} AS same_size, {t.compatible('o_gender', 'c.gender', 'unisex')} AS same_gender, {t.known_family('o_brand')} AS f1, {t.known_family('c.brand')} AS f2
        FROM cand c LEFT JOIN titled p ON p.title = c.name AND p.hint IS NULL),
    hue AS (SELECT query_id, style_code, max({t.tint_similarity('x', 'y')}) AS hue FROM (SELECT query_id, style_code, unnest(colorways) AS q, CASE WHEN colorway <> '' THEN colorway WHEN name <> '' THEN name_colours END AS target FROM fact) f JOIN tinted x ON x.txt = q JOIN tinted y ON y.txt = target GROUP BY ALL),
    comp AS (SELECT f.*, s.sim, s.x AS asked, s.y AS named, CASE WHEN f1 <> '' AND f2 <> '' THEN f1 = f2 END AS same_brand, CASE WHEN nickname <> '' AND name <> '' THEN {t.nickname_score('nickname', 'name_colours')} END AS nick, hue
        FROM fact f LEFT JOIN alike s ON o_model <> '' AND own <> '' AND s.a = o_model AND s.b = own LEFT JOIN hue USING (query_id, style_code)),
    checked AS (SELECT *, list_filter([CASE WHEN coalesce(price, 0) <> 0 AND coalesce(retail_price, 0) <> 0 THEN CASE WHEN price / retail_price BETWEEN 0.55 AND 1.35 THEN 1.0{D} ELSE 0.3{D} END END, {FLAG('same_gender')}, {FLAG('same_size')}, {FLAG('same_brand')}], lambda v: v IS NOT NULL) AS checks FROM comp),
    parts AS (SELECT *, list_max(list_transform(ev, lambda e: {VALUE})) AS c_sku, coalesce(sim, 0.5){D} AS c_model, coalesce(greatest(hue, nick), 0.5){D} AS c_colorway, coalesce(greatest(0.0{D}, least(1.0{D}, (similarity - 0.70{D}) / (0.92{D} - 0.70{D}))), 0.5){D} AS c_embedding,
        CASE WHEN len(checks) > 0 THEN list_sum(checks) / len(checks) ELSE 0.5 END{D} AS c_metadata, least(1.0{D}, len(list_intersect(list_distinct(list_transform(ev, lambda e: e.kind)), [{t.names(list(scoring.SIGNALS))}])) / 2.0){D} AS c_agreement FROM checked),
    scored AS (SELECT *, (floor((c_sku * 0.40{D} + c_model * 0.20{D} + c_colorway * 0.15{D} + c_embedding * 0.15{D} + c_metadata * 0.05{D} + c_agreement * 0.05{D}) * 10000 + 0.5{D}) / 10000) AS raw_score FROM parts)"""


def rules(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in pairs) + "], lambda z: z IS NOT NULL)"


APART = "coalesce(asked <> '' AND named <> '' AND asked <> named, false)"
OTHER = f"({APART} AND sim < 0.5)"
UNSURE = lambda w: f"({w}_from_photos AND NOT {w}_certain)"
NOT = lambda c: f"coalesce(NOT {c}, false)"
HARD = [
    (f"product_type <> '' AND NOT regexp_matches(lower(product_type), '{scoring.FOOTWEAR}')", "product_type"),
    (f"{NOT('same_size')} AND NOT size_from_photos", "size_category_mismatch"),
    (f"{OTHER} AND NOT {UNSURE('model')}", "model_mismatch"),
    (f"{NOT('same_brand')} AND NOT {UNSURE('brand')}", "brand_mismatch"),
]
SOFT = [
    ("disagree", 0.05, "several_products"),
    (f"{NOT('same_size')} AND size_from_photos", 0.25, "size_category_mismatch_in_photos"),
    (NOT("same_gender"), 0.15, "gender_mismatch"),
    (f"{OTHER} AND {UNSURE('model')}", 0.3, "model_mismatch_in_photos"),
    (f"{APART} AND sim >= 0.5 AND sim < 0.9", 0.05, "model_height_unspecified"),
    ("round(c_colorway, 4) < 0.2 AND len(colorways) > 0 AND colorway <> ''", 0.3, "colorway_conflict"),
    ("tag_code <> '' AND tag_code <> style_code", 0.4, "tag_style_code_mismatch"),
    ("len(labeled_codes) > 0 AND NOT list_contains(labeled_codes, style_code)", 0.25, "page_style_code_mismatch"),
    (f"{NOT('same_brand')} AND {UNSURE('brand')}", 0.3, "brand_mismatch_in_photos"),
    ("collab <> '' AND name <> '' AND NOT contains(lower(name), lower(collab))", 0.2, "collab_missing"),
    ("NOT images_consistent", 0.1, "query_images_inconsistent"),
    ("name = '' AND model = '' AND colorway = ''", 0.3, "no_catalog_identity"),
]
CONTRADICTED = f"""found AS (SELECT *, {rules(HARD)} AS hard, {rules([(c, n) for c, _, n in SOFT])} AS soft, {' + '.join(f'CASE WHEN {c} THEN {p}{D} ELSE 0.0{D} END' for c, p, _ in SOFT)} AS penalty FROM scored),
    against AS (SELECT *, hard || soft AS contradictions, len(hard) > 0 AS rejected0, coalesce(hard[1], '') AS reason0, (floor((greatest(0.0{D}, raw_score - penalty)) * 10000 + 0.5{D}) / 10000) AS score0 FROM found)"""
VERIFIED = f"""judged AS (SELECT a.* EXCLUDE (contradictions), lower(trim(v.verdict)) AS verdict, v.confidence AS sure,
        contradictions || CASE WHEN lower(trim(v.verdict)) = 'different' AND v.note <> '' THEN ['verifier:' || v.note] ELSE [] END AS contradictions,
        CASE lower(trim(v.verdict)) WHEN 'same' THEN (floor((least(1.0{D}, score0 + CASE WHEN v.confidence >= 0.85 THEN 0.10{D} WHEN v.confidence >= 0.7 THEN 0.05{D} ELSE 0.0{D} END)) * 10000 + 0.5{D}) / 10000) WHEN 'uncertain' THEN (floor((least(score0, 0.84{D})) * 10000 + 0.5{D}) / 10000) ELSE score0 END AS score,
        rejected0 OR coalesce(lower(trim(v.verdict)) = 'different', false) AS rejected, CASE WHEN reason0 = '' AND lower(trim(v.verdict)) = 'different' THEN 'verifier:different' ELSE reason0 END AS reason
        FROM against a LEFT JOIN verdicts_raw v USING (query_id, style_code))"""
CONFIRMED = """leader AS (SELECT query_id, style_code, o_model FROM judged WHERE NOT rejected QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) = 1),
    confirmed AS (SELECT query_id, product_id, l.title, ambiguous, NOT ambiguous AND (o_model = '' OR coalesce(s.sim >= 0.6, true)) AS confirmed FROM leader JOIN listed l USING (style_code) LEFT JOIN alike s ON s.a = o_model AND s.b = l.title)"""
RESOLVED = f"""ranked AS (SELECT *, CASE WHEN rejected THEN 2 WHEN name = '' AND colorway = '' AND model = '' THEN 1 ELSE 0 END AS dead FROM judged),
    turns AS (SELECT *, row_number() OVER o AS turn, lead(dead) OVER o AS next_dead, lead(score) OVER o AS next_score, lead(verdict) OVER o AS next_verdict FROM ranked WINDOW o AS (PARTITION BY query_id ORDER BY dead, score DESC, ord)),
    tops AS (SELECT r.query_id, u.style_code, u.score, u.dead, u.c_model, u.c_colorway, u.contradictions, coalesce(u.verdict = 'same', false) AS same, coalesce(u.verdict = 'uncertain', false) AS unsure, coalesce(u.sure >= 0.7, false) AS sure,
        dead IS NULL OR dead = 2 AS gone, coalesce(dead = 1, false) AS unnamed, coalesce(next_dead = 0 AND next_score >= score - 0.05{D}, false) AND NOT (coalesce(u.verdict = 'same', false) AND NOT coalesce(next_verdict = 'same', false)) AS close,
        list_contains(o.labeled_codes, u.style_code) AS labelled, coalesce(k.confirmed, false) AS confirmed FROM requests_raw r JOIN obs o USING (query_id) LEFT JOIN turns u ON u.query_id = r.query_id AND turn = 1 LEFT JOIN confirmed k ON k.query_id = r.query_id),
    prints AS (SELECT *, coalesce(labelled AND confirmed AND len(contradictions) = 0 AND round(c_model, 4) >= 0.5 AND (round(c_colorway, 4) >= 0.5 OR (same AND sure)), false) AND NOT close AND NOT unsure AS printed, CASE WHEN close THEN least(score, 0.84{D}) ELSE score END AS s0 FROM tops),
    lifts AS (SELECT *, CASE WHEN printed THEN greatest(s0, 0.95{D}) ELSE s0 END AS s1 FROM prints),
    caps AS (SELECT *, CASE WHEN s1 >= 0.95 AND NOT same AND NOT printed THEN 0.94{D} ELSE s1 END AS s2, len(list_filter(contradictions, lambda x: starts_with(x, 'verifier:'))) > 0 AS doubted FROM lifts),
    resolved AS (SELECT query_id, CASE WHEN NOT gone THEN style_code END AS style_code, (floor((CASE WHEN gone THEN 0.0{D} WHEN unnamed THEN least(score, 0.69{D}) WHEN doubted AND s2 >= 0.85 THEN least(s2, 0.84{D}) ELSE s2 END) * 10000 + 0.5{D}) / 10000) AS confidence,
        CASE WHEN gone OR unnamed THEN 'unresolved' WHEN doubted AND s2 >= 0.85 THEN 'low' ELSE {tier('s2')} END AS status, CASE WHEN dead IS NULL THEN 'NO_CANDIDATES' WHEN gone THEN 'CONTRADICTORY_EVIDENCE' WHEN unnamed THEN 'CATALOG_MATCH_UNCERTAIN' WHEN close THEN 'MULTIPLE_CANDIDATES' ELSE '' END AS failure,
        printed AS page_confirmed, close AS ambiguous FROM caps)"""
#: Earlier failures of the derived requests: inconsistent photos, and a leader whose listings disagree or that has none.
FINAL = f"""failed AS (SELECT r.query_id, list_filter([CASE WHEN seen AND NOT v_consistent THEN 'CONTRADICTORY_EVIDENCE' END, CASE WHEN l.query_id IS NOT NULL AND (k.query_id IS NULL OR k.ambiguous) THEN 'CATALOG_MATCH_UNCERTAIN' END], lambda x: x IS NOT NULL) AS codes
        FROM requests_raw r LEFT JOIN leader l USING (query_id) LEFT JOIN confirmed k USING (query_id)),
    markets AS (SELECT 'p' || l_partkey AS product_id, min(l_extendedprice) AS lowest_ask, max(l_extendedprice) AS highest_bid FROM lineitem GROUP BY 1),
    lists AS (SELECT query_id, string_agg(style_code, ',' ORDER BY place) AS candidates FROM (SELECT query_id, style_code, row_number() OVER (PARTITION BY query_id ORDER BY rejected, score DESC, ord) AS place FROM judged) WHERE place <= 12 GROUP BY query_id),
    every AS (SELECT r.*, list_distinct(list_filter(f.codes || [failure], lambda x: x <> '')) AS failures, array_to_string(list_filter(f.codes || [CASE WHEN list_contains(f.codes, failure) THEN '' ELSE failure END], lambda x: x <> ''), ',') AS told FROM resolved r JOIN failed f USING (query_id)),
    ended AS (SELECT * EXCLUDE (status), CASE WHEN list_contains(failures, 'CONTRADICTORY_EVIDENCE') AND status = 'high' THEN 'medium' ELSE status END AS status FROM every),
    final AS (SELECT e.query_id, e.status, e.status IN ('high', 'medium') AS identified, e.confidence, told AS failures, e.status IN ('low', 'unresolved') OR list_has_any(e.failures, ['MULTIPLE_CANDIDATES', 'CATALOG_MATCH_UNCERTAIN']) AS review_required,
        coalesce(nullif(j.display, ''), e.style_code) AS style_code, coalesce(nullif(j.brand, ''), j.o_brand) AS brand, coalesce(nullif(j.model, ''), j.o_model) AS model, coalesce(nullif(j.colorway, ''), j.colorways[1], CASE WHEN e.style_code IS NOT NULL THEN '' END) AS colorway, j.name AS product_name,
        CASE WHEN e.style_code IS NOT NULL THEN k.product_id END AS product_id, CASE WHEN e.style_code IS NOT NULL AND k.product_id IS NOT NULL THEN CASE WHEN k.confirmed THEN e.confidence ELSE (floor((least(e.confidence, 0.84{D})) * 10000 + 0.5{D}) / 10000) END END AS match_confidence,
        CASE WHEN e.style_code IS NOT NULL AND e.status <> 'unresolved' THEN m.lowest_ask END AS lowest_ask, CASE WHEN e.style_code IS NOT NULL AND e.status <> 'unresolved' THEN m.highest_bid END AS highest_bid, candidates
        FROM ended e LEFT JOIN judged j USING (query_id, style_code) LEFT JOIN lists USING (query_id) LEFT JOIN confirmed k ON k.query_id = e.query_id LEFT JOIN markets m ON m.product_id = k.product_id)"""

TO_POOL = f"WITH {RAW}, {TITLES}, {PLAIN}, {OBSERVED}, {POOL}"
TO_LISTED = f"{TO_POOL}, {COMPARED}, {LISTED}"
TO_AGAINST = f"{TO_LISTED}, {SCORED}, {CONTRADICTED}"
TO_RESOLVED = f"{TO_AGAINST}, {VERIFIED}, {CONFIRMED}, {RESOLVED}"

TITLES_KNOWN = t.parsed("(SELECT title, brand AS hint FROM listings_raw UNION SELECT title, NULL FROM listings_raw UNION SELECT title, page_brand FROM requests_raw UNION SELECT name, NULL FROM known_raw)")
OWN = f"""WITH {RAW}, {sql('known_raw')}, {TITLES_KNOWN}, {PLAIN}, {OBSERVED}, {POOL}, {COMPARED}, {LISTED},
    known AS (SELECT * FROM known_raw QUALIFY row_number() OVER (PARTITION BY style_code ORDER BY ord) = 1)
    SELECT c.query_id, c.style_code, l.product_id, {', '.join(f"coalesce(nullif(l.{a}, ''), nullif(k.{b}, ''), '') AS {b}" for a, b in [("title", "name"), *[(f, f) for f in ("brand", "model", "colorway", "gender", "size_category", "release_date")]])},
        coalesce(l.retail_price, k.retail_price) AS retail_price, coalesce(CASE WHEN l.title <> '' THEN l.model ELSE p.model END, '') AS name_model
    FROM pool c LEFT JOIN listed l USING (style_code) LEFT JOIN known k USING (style_code) LEFT JOIN titled p ON p.title = k.name AND p.hint IS NULL"""

ORACLES = {
    "own_database": OWN,
    "title_parse": f"WITH {sql('listings_raw')}, {t.parsed('(SELECT title, brand AS hint FROM listings_raw)')} SELECT product_id, t.brand, t.model, t.sub_model, t.gender, t.size_category, t.collab, t.colorway_text FROM listings_raw l JOIN titled t ON t.title = l.title AND t.hint = l.brand",
    "observations": f"WITH {RAW}, {TITLES}, {OBSERVED} SELECT * EXCLUDE (colorways, labeled_codes), array_to_string(colorways, '|') AS colorways, array_to_string(labeled_codes, ',') AS labeled_codes FROM obs",
    "catalog_search": f"WITH {RAW}, {SEARCH} SELECT query_id, ask, product_id, score, rank FROM hits",
    "evidence_pool": f"{TO_POOL} SELECT query_id, style_code, display, evidence, similarity, ord FROM pool",
    "catalog_listings": f"{TO_LISTED} SELECT style_code, product_id, title, brand, model, colorway, gender, size_category, retail_price, ambiguous, n_listings FROM listed",
    "score_candidates": f"{TO_AGAINST} SELECT query_id, style_code, {', '.join(f'round(c_{c}, 4) AS c_{c}' for c in scoring.COMPONENTS)}, raw_score FROM against",
    "contradictions": f"{TO_AGAINST} SELECT query_id, style_code, array_to_string(contradictions, ',') AS contradictions, round(penalty, 4) AS penalty, rejected0 AS rejected, reason0 AS rejection_reason, score0 AS score FROM against",
    "verify_candidates": f"{TO_AGAINST}, {VERIFIED} SELECT query_id, style_code, array_to_string(contradictions, ',') AS contradictions, rejected, reason AS rejection_reason, score FROM judged",
    "resolve_queries": f"{TO_RESOLVED} SELECT * FROM resolved",
    "resolve_stream": f"{TO_RESOLVED} SELECT * FROM resolved",
    "final_rows": f"{TO_RESOLVED}, {FINAL} SELECT * FROM final",
}
