"""The same queries in SQL that another engine runs on the same tables."""

from __future__ import annotations

from ..functions import codes
from ..operators import catalog, records
from . import texts_sql as t
from .derived import ASKED, FETCHED_HTML, FINAL_URL, MARKET_JSON, PRODUCT_JSON, VARIANT_JSON, sql
from .resolution_sql import ORACLES as RESOLUTION
from .resolution_sql import family_of, normal, tier

NORMAL_URL = r"CASE WHEN regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^;?#]*)', 2) = '' THEN '' ELSE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^;?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^;?#]*)', 2)) || regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^;?#]*)', 3), '/+$', '') END"
DOMAIN = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

COSINE = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"


def near(k: int) -> str:
    return f"""pairs AS (SELECT q.vec_id AS query_id, v.vec_id, v.label AS owner, round({COSINE}, 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM pairs QUALIFY rank <= {k})"""




def folded(c: str) -> str:
    text_of = f"coalesce({c}::VARCHAR, '') <> ''"
    return f"arg_max({c}, ord) FILTER ({text_of} AND authoritative) AS {c}_a, arg_min({c}, ord) FILTER ({text_of}) AS {c}_f"


UPSERT = f"""WITH current AS (SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN p_name END AS name, '' AS color, CASE WHEN p_size < 40 THEN p_retailprice END AS price FROM part),
    updates AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS color, c_acctbal AS price, false AS authoritative, 1 AS ord FROM customer UNION ALL SELECT s_suppkey, s_name, '', CASE WHEN s_acctbal > 0 THEN s_acctbal END, true, 2 FROM supplier),
    n AS (SELECT key, {', '.join(map(folded, ('name', 'color', 'price')))} FROM updates GROUP BY key)
    SELECT coalesce(o.key, n.key) AS key, coalesce(name_a, nullif(o.name, ''), name_f) AS name, coalesce(color_a, nullif(o.color, ''), color_f) AS color, coalesce(price_a, o.price, price_f) AS price FROM current o FULL JOIN n ON o.key = n.key"""

SEGMENTS = f"""WITH {sql("listings_raw")}, {sql("signals_raw")}, parts AS (SELECT DISTINCT product_id, {normal("regexp_replace(part, '\\([^)]*\\)', '', 'g')")} AS style_code FROM (SELECT product_id, unnest(string_split(style_id, '/')) AS part FROM listings_raw))
    SELECT query_id, style_code, product_id FROM (SELECT DISTINCT query_id, style_code FROM signals_raw) LEFT JOIN parts USING (style_code)"""


def unescaped(c: str) -> str:
    """The references that the driver's pages hold."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


def collapsed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def visible(c: str) -> str:
    """Text of a page outside its head, scripts, styles, navigation, header and footer; every tag parts words as it parts runs of text."""
    for tag in ("head", "script", "style", "nav", "header", "footer", "noscript", "svg"):
        c = rf"regexp_replace({c}, '(?s)<{tag}\b.*?</{tag}>', '', 'g')"
    return collapsed(unescaped(f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"))


INNER = lambda tag: collapsed(unescaped(f"regexp_replace(regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1), '<[^>]+>', '', 'g')"))  # noqa: E731
PAGE_FIELDS = f"""WITH p AS (SELECT page_id, url, html, {INNER('title')} AS title, {INNER('h1')} AS h1, {visible('html')} AS text FROM pages)
    SELECT page_id, title, h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links, CASE WHEN title = '' THEN 'no_metadata' ELSE '' END AS error, length(text)::BIGINT AS n_text, sha256(text) AS text_sha256,
        CASE WHEN regexp_matches(url, '^https?://[^/?#:]+') THEN '' ELSE 'blocked:no http(s) address' END AS blocked, CASE WHEN contains(url, '/products/') THEN NULL ELSE '' END AS product_key FROM p"""

#: Queries of each request in their order, the first of those that differ by case alone.
SEARCH = f"""WITH {sql("requests_raw")}, {t.parsed("(SELECT title, page_brand AS hint FROM requests_raw)")},
    asked AS (SELECT query_id, list_filter([
        CASE WHEN r.title <> '' THEN trim(r.title) || ' style code' END, CASE WHEN r.title <> '' AND p.model <> '' THEN p.model || ' ' || p.colorway_text || ' style code' END, CASE WHEN r.title <> '' AND page_colour <> '' THEN trim(r.title) || ' ' || page_colour END,
        CASE WHEN seen AND v_brand <> '' AND v_model <> '' THEN v_brand || ' ' || v_model || ' ' || coalesce(nullif(v_official, ''), v_colorway) || ' style code' END] || list_filter(string_split(labeled, ','), lambda x: x <> ''), lambda x: x IS NOT NULL) AS qs
        FROM requests_raw r LEFT JOIN titled p ON p.title = r.title AND p.hint = r.page_brand),
    clean AS (SELECT query_id, list_transform(qs, lambda q: trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS qs FROM asked),
    once AS (SELECT query_id, list_filter(qs, lambda q, i: list_position(list_transform(qs, lambda x: lower(x)), lower(q)) = i) AS qs FROM clean)
    SELECT query_id, array_to_string(qs[1:6], ' | ') AS queries FROM once"""

J = lambda path: f"coalesce(json_extract_string(j, '$.{path}'), '')"  # noqa: E731
AMOUNT = lambda path: f"try_cast(trim(regexp_replace({J(path)}, '[,$]', '', 'g')) AS DOUBLE)"  # noqa: E731
CATALOG = f"""WITH r AS (SELECT p_partkey, {PRODUCT_JSON} AS j FROM part), v AS (SELECT * FROM r WHERE json_valid(j))
    SELECT p_partkey, coalesce(nullif({J('productId')}, ''), {J('id')}) AS product_id, {J('styleId')} AS style_id, {J('title')} AS title, {J('brand')} AS brand, {J('productAttributes.colorway')} AS colorway, {J('productAttributes.gender')} AS gender, {AMOUNT('productAttributes.retailPrice')} AS retail_price, {J('productType')} AS product_type
    FROM v WHERE coalesce(nullif({J('productId')}, ''), {J('id')}) <> ''"""
VSIZE = f"coalesce(nullif({J('sizeChart.defaultConversion.size')}, ''), {J('variantValue')})"
MARKET = f"""WITH v AS (SELECT {J('variantId')} AS variant_id, CASE WHEN lower({J('sizeChart.defaultConversion.type')}) = 'us w' AND {VSIZE} <> '' AND NOT starts_with(upper({VSIZE}), 'W') THEN 'W' || {VSIZE} ELSE {VSIZE} END AS size FROM (SELECT {VARIANT_JSON} AS j FROM part)),
    m AS (SELECT l_orderkey AS product_id, {J('variantId')} AS variant_id, {J('variantValue')} AS own, coalesce(nullif({AMOUNT('lowestAskAmount')}, 0), {AMOUNT('standardMarketData.lowestAsk')}) AS ask, coalesce(nullif({AMOUNT('highestBidAmount')}, 0), {AMOUNT('standardMarketData.highestBidAmount')}) AS bid FROM (SELECT l_orderkey, {MARKET_JSON} AS j FROM lineitem))
    SELECT product_id, coalesce(nullif(size, ''), nullif(own, ''), 'ANY') AS size, min(ask) AS lowest_ask, max(bid) AS highest_bid, count(*) AS n FROM m LEFT JOIN v ON v.variant_id = m.variant_id AND m.variant_id <> '' WHERE ask IS NOT NULL OR bid IS NOT NULL GROUP BY 1, 2"""
LISTED_TITLES = t.parsed("(SELECT title, brand AS hint FROM listings_raw)")
FIRST_PART = "trim(regexp_replace(string_split(style_id, '/')[1], '\\([^)]*\\)', '', 'g'))"
SEEDS = f"""WITH {sql('listings_raw')}, {LISTED_TITLES} SELECT {normal(FIRST_PART)} AS style_code, {FIRST_PART} AS display, l.title AS name, coalesce(nullif(p.brand, ''), l.brand) AS brand, model, sub_model, colorway, lower(l.gender) AS gender,
    CASE WHEN size_category <> 'unknown' THEN size_category ELSE '' END AS size_category, release_date, retail_price, product_id, true AS authoritative, ord FROM listings_raw l JOIN titled p ON p.title = l.title AND p.hint = l.brand
    WHERE contains(lower(coalesce(nullif(product_type, ''), 'sneakers')), 'sneaker') OR contains(lower(product_type), 'shoe')"""
REPARSE = f"""WITH {sql('listings_raw')}, {LISTED_TITLES}, k AS (SELECT product_id AS style_code, p.*, CASE WHEN ord % 3 = 0 THEN 'Nike Dunk Low' ELSE '' END AS old_model, 'og' AS old_sub, l.gender AS old_gender, CASE WHEN ord % 2 = 0 THEN 'gs' END AS old_size FROM listings_raw l JOIN titled p ON p.title = l.title AND p.hint = l.brand WHERE l.title <> ''),
    o AS (SELECT style_code, CASE WHEN model <> '' AND model <> old_model THEN model END AS model, CASE WHEN sub_model <> '' AND sub_model <> old_sub THEN sub_model END AS sub_model, CASE WHEN gender <> 'unknown' AND old_gender = '' THEN gender END AS gender, CASE WHEN size_category <> 'unknown' AND coalesce(old_size, '') = '' THEN size_category END AS size_category FROM k)
    SELECT * FROM o WHERE model IS NOT NULL OR sub_model IS NOT NULL OR gender IS NOT NULL OR size_category IS NOT NULL"""
LOW = "lower(title)"
KEY_URL = NORMAL_URL.replace("url", "u")
INTAKE = rf"""WITH p AS (SELECT page_id AS query_id, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'ftp:' || url ELSE url END AS u, CASE WHEN page_id % 2 = 0 THEN '' ELSE trim({TITLE}) END AS t, CASE WHEN page_id % 3 = 0 THEN [sha256(html), sha256(url)] ELSE [] END AS hs FROM pages),
    e AS (SELECT *, CASE WHEN len(hs) = 0 AND u = '' AND t = '' THEN 'nothing to identify: neither image, address nor title' WHEN u <> '' AND NOT regexp_matches(u, '(?i)^https?://') THEN 'no http(s) address' ELSE '' END AS error FROM p)
    SELECT query_id, CASE WHEN error = '' THEN 'queued' ELSE 'error' END AS status, CASE WHEN u <> '' AND len(hs) > 0 THEN 'mixed' WHEN u <> '' THEN 'url' ELSE 'image' END AS input_kind, sha256(array_to_string(list_sort(hs), '|') || '|' || {KEY_URL} || '|' || trim(regexp_replace(lower(t), '[ 	

]+', ' ', 'g'))) AS cache_key, error FROM e"""
REUSE = """SELECT p.event_id AS query_id, arg_max(r.event_id, {'t': r.ts, 'i': r.event_id}) AS result_id FROM events p JOIN events r ON r.user_id = p.user_id AND r.event_type IN ('view', 'click') AND r.ts <= p.ts AND r.ts >= p.ts - INTERVAL 7 DAYS WHERE p.event_type = 'purchase' GROUP BY 1"""
TRUST = "CASE domain " + " ".join(f"WHEN '{d}' THEN {x}::DOUBLE" for d, x in records.DOMAIN_TRUST.items()) + f" ELSE {records.DEFAULT_TRUST}::DOUBLE END"
#: Codes of the results are of one format: labelled ones stand behind "Style:", bare ones anywhere; two count in a result, labelled ones first.
DISCOVERY = f"""WITH {sql('results_raw')}, r AS (SELECT *, {DOMAIN} AS domain, trim(title || ' ' || snippet) AS txt FROM results_raw),
    f AS (SELECT query_id, ord, domain, title, list_distinct(regexp_extract_all(txt, 'Style: ([A-Z]{{2}}[0-9]{{4}}-[0-9]{{3}})', 1)) AS ls, regexp_extract_all(txt, '[A-Z]{{2}}[0-9]{{4}}-[0-9]{{3}}') AS bs FROM r),
    g AS (SELECT *, list_filter(bs, lambda b, i: list_position(bs, b) = i AND NOT list_contains(ls, b)) AS os FROM f),
    x AS (SELECT query_id, domain, title, unnest((ls || os)[1:2]) AS display, unnest(range(len((ls || os)[1:2]))) AS i, ls, ord FROM g),
    y AS (SELECT query_id, domain, title, display, replace(display, '-', '') AS style_code, list_contains(ls, display) AS labeled, ord * 2 + i AS ord FROM x),
    d AS (SELECT query_id, style_code, domain, arg_min(labeled, ord) AS labeled, arg_min(display, ord) AS display, min(ord) AS ord FROM y GROUP BY ALL),
    p AS (SELECT query_id, style_code, arg_min(display, ord) AS display, count(*) AS agreement, round(sum({TRUST} * CASE WHEN labeled THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END), 6) AS trust, string_agg(domain, ',' ORDER BY ord, domain) AS domains, min(ord) AS first_ord FROM d GROUP BY ALL),
    q AS (SELECT query_id, style_code, string_agg(title, '|' ORDER BY ord, title) AS titles FROM (SELECT query_id, style_code, title, min(ord) AS ord FROM y WHERE title <> '' GROUP BY ALL) GROUP BY ALL)
    SELECT * FROM p LEFT JOIN q USING (query_id, style_code)"""
IMAGES = f"""WITH {sql('results_raw')}, r AS (SELECT *, {DOMAIN} AS domain FROM results_raw) SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY {TRUST} DESC, (width >= 400 AND height >= 300) DESC, ord) AS rank FROM r QUALIFY rank <= 2"""
ACCURACY = f"""WITH {sql('outcomes_raw')}, o AS (SELECT *, replace(expected, '-', '') AS want, status IN ('high', 'medium') AS sure FROM outcomes_raw), h AS (SELECT *, coalesce(got, '') = want AS hit, list_contains(string_split(ranked, ',')[1:3], want) AS three FROM o)
    SELECT count(*) AS cases, round(avg(hit::INT::DOUBLE), 6) AS top1, round(avg(three::INT::DOUBLE), 6) AS top3, round(avg(sure::INT::DOUBLE), 6) AS confident, round(count(*) FILTER (sure AND hit) / nullif(count(*) FILTER (sure), 0)::DOUBLE, 6) AS exact_if_confident,
        round(count(*) FILTER (sure AND hit AND product_id IS NOT NULL AND (expected_product_id = '' OR product_id = expected_product_id)) / nullif(count(*) FILTER (sure), 0)::DOUBLE, 6) AS mapped_if_confident, round(avg((sure AND NOT hit)::INT::DOUBLE), 6) AS false_positives, round(avg((status = 'unresolved')::INT::DOUBLE), 6) AS unresolved, round(avg(ms), 6) AS mean_ms, median(ms)::DOUBLE AS median_ms FROM h"""
OVERRIDE = f"""WITH {sql('outcomes_raw')}, {sql('decisions_raw')}, d AS (SELECT query_id, action, chosen FROM decisions_raw WHERE action IN ('confirm', 'reject') OR (action IN ('select', 'manual_sku') AND chosen <> '') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY decided_at DESC, ord DESC) = 1)
    SELECT query_id, CASE WHEN action = 'reject' THEN NULL WHEN action = 'confirm' THEN got WHEN action IS NOT NULL THEN chosen ELSE got END AS style_code, CASE WHEN action IS NOT NULL AND action <> 'reject' THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN action = 'reject' THEN 'unresolved' WHEN action IS NOT NULL THEN 'high' ELSE status END AS status,
        CASE WHEN action IS NOT NULL THEN false ELSE review_required END AS review_required, coalesce(action, '') AS review FROM outcomes_raw LEFT JOIN d USING (query_id)"""



def shown_code(norm: str, dash: int) -> str:
    mark, at = ("-", dash) if dash > 0 else (".", -dash)
    return norm if dash == 0 else f"substr({norm}, 1, {at}) || '{mark}' || substr({norm}, {at + 1})"


def code_case(pick) -> str:
    """The first format that fits norm under hint and label rules."""
    out = "CASE"
    for family, pattern, dash, bare in codes.FORMATS:
        free = "true" if bare else "labelled"
        if family == "nike":
            free = f"{free} AND (labelled OR separated OR NOT regexp_matches(norm, '^[A-Z]{{2}}'))"
        out += f" WHEN regexp_full_match(norm, {t.quoted(pattern)}) AND CASE WHEN hint IS NOT NULL THEN hint = '{family}' ELSE {free} END THEN {pick(family, dash)}"
    return out + " END"


def detect(source: str) -> str:
    """Codes of the relation source (key, k, text, told, base), of each row for itself: z.

    Tokens are rows here, each distinct one tried once by its prefixes; the lookaround of spaced codes is a word boundary.
    """
    return rf"""d AS (SELECT row_number() OVER () AS r, key, k, base, coalesce(text, '') AS text, told FROM {source}), h AS (SELECT r, key, k, base, coalesce(told, {family_of("lower(text)")}) AS hint,
        [list_transform(regexp_extract_all(text, {t.quoted(codes.LABELLED)}, 1), lambda x: trim(x, ' .,;:')), regexp_extract_all(text, {t.quoted(codes.TOKEN)}), list_transform(regexp_extract_all(text, '(?i)\b(?:[A-Z]{{2}}\d{{4}}|\d{{6}})\s+\d{{3}}\b'), lambda x: regexp_replace(x, '\s+', '-'))] AS ts FROM d),
    ks AS (SELECT r, key, k, base, hint, unnest(ts) AS tokens, unnest(range(3)) AS kind FROM h),
    w AS (SELECT r, key, k, base, hint, kind, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM ks),
    c AS (SELECT * FROM w WHERE regexp_matches(token, '[0-9]') AND length(token) >= 6),
    u AS (SELECT DISTINCT token, hint, kind = 0 AS labelled FROM c),
    ps AS (SELECT token, hint, labelled, regexp_extract_all(token, '[A-Za-z0-9]+|[-._/ ]') AS ps FROM u),
    n AS (SELECT token, hint, labelled, n, trim(array_to_string(ps[1:n], '')) AS prefix FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM ps) WHERE regexp_matches(ps[n], '[A-Za-z0-9]')),
    f AS (SELECT *, {normal('prefix')} AS norm, regexp_matches(prefix, '[-. _/]') AS separated FROM n),
    g AS (SELECT * FROM f WHERE length(norm) BETWEEN 6 AND 13 AND NOT (regexp_full_match(norm, '[0-9]+') AND (length(norm) >= 12 OR (substr(norm, 1, 2) IN ('19', '20') AND (length(norm) = 6 OR (length(norm) = 8 AND substr(norm, 5, 2) BETWEEN '01' AND '12' AND substr(norm, 7, 2) BETWEEN '01' AND '31')))))),
    e AS (SELECT token, hint, labelled, n, norm AS code, {code_case(lambda f, dash: t.quoted(f))} AS family, {code_case(lambda f, dash: shown_code('norm', dash))} AS display FROM g),
    b AS (SELECT token, hint, labelled, arg_max({{'code': code, 'family': family, 'display': display}}, n) AS x FROM e WHERE family IS NOT NULL GROUP BY ALL),
    o AS (SELECT r, key, k, base, x.code AS code, x.family AS family, x.display AS display, labelled, kind, i FROM c JOIN b ON b.token = c.token AND b.hint IS NOT DISTINCT FROM c.hint AND b.labelled = (c.kind = 0)),
    q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY kind, i) AS seen FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY r, code ORDER BY kind, i) = 1)),
    z AS (SELECT *, CASE WHEN labelled THEN least(0.95::DOUBLE, base + 0.4::DOUBLE) ELSE base END AS confidence FROM q WHERE labelled OR seen <= 10)"""


DETECT = f"""WITH {detect('(SELECT doc_id AS key, 0 AS k, 0.5::DOUBLE AS base, text, NULL::VARCHAR AS told FROM documents)')}
    SELECT key AS doc_id, code, display, family, labelled AS labeled, confidence, row_number() OVER (PARTITION BY r ORDER BY confidence DESC, seen) AS ord FROM z"""

#: The driver's pages have no identifiers, descriptions or brands: their codes are in titles, addresses and bodies.
SLUG = r"translate(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '/')[-1], '-_', '  ')"
PAGE_CODES = f"""WITH p AS (SELECT page_id, url, {INNER('title')} AS title, left({visible('html')}, 60000) AS body FROM pages), parts AS (SELECT page_id AS key, unnest([0, 1, 2]) AS k, unnest([0.6::DOUBLE, 0.5::DOUBLE, 0.45::DOUBLE]) AS base, unnest([title, {SLUG}, body]) AS text, {family_of('lower(title)')} AS told FROM p),
    {detect('parts')},
    best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, k, seen) AS place FROM z QUALIFY row_number() OVER (PARTITION BY key, code ORDER BY confidence DESC, k, seen) = 1)
    SELECT key AS page_id, code, display, ['page:title', 'page:url', 'page:body'][k + 1] AS source, labelled AS labeled, confidence, row_number() OVER (PARTITION BY key ORDER BY place) AS ord FROM best"""

PAGE_PRODUCTS = f"""WITH a AS (SELECT page_id, html AS page, {ASKED} AS asked, {FETCHED_HTML} AS html FROM pages), m AS (SELECT *, {FINAL_URL} AS final FROM a), s AS (SELECT *, coalesce(nullif(final, ''), asked) AS url FROM m),
    p AS (SELECT *, CASE WHEN starts_with(asked, 'ftp') THEN 'blocked:no http(s) address' WHEN contains(asked, '//10.') OR contains(url, '//192.168.') THEN 'blocked:address is not public' WHEN html IS NULL THEN 'fetch_failed' ELSE '' END AS why FROM s),
    k AS (SELECT *, page_id % 5 < 2 AND why = '' AS linked, why = '' AND ((page_id % 2 = 0 AND contains(asked, '/products/item')) OR contains(url, '/products/moved')) AS shop FROM p),
    f AS (SELECT *, lpad((page_id % 1500)::VARCHAR, 4, '0') AS d FROM k)
    SELECT page_id, url, split_part(asked, '?', 1) <> split_part(url, '?', 1) AS moved, CASE WHEN linked THEN 'Nike Dunk Low ' || page_id WHEN shop THEN 'Air Jordan ' || page_id WHEN why = '' THEN {INNER('title')} ELSE '' END AS title,
        CASE WHEN linked THEN 'Nike' WHEN shop THEN 'Jordan' ELSE '' END AS brand, CASE WHEN linked THEN ' Shoe ' ELSE '' END AS description, CASE WHEN linked THEN 80.5::DOUBLE + page_id % 90 WHEN shop THEN 99.0::DOUBLE END AS price, CASE WHEN linked THEN 'EUR' ELSE '' END AS currency, CASE WHEN linked THEN 'InStock' ELSE '' END AS availability,
        concat_ws(',', CASE WHEN linked THEN 'sku=DD' || d || '-100' END, CASE WHEN shop THEN 'variant_sku=FV' || d || '-006' END) AS identifiers, CASE WHEN linked THEN 'https://shop.example.com/a/' || page_id || '.jpg' ELSE '' END AS images, CASE WHEN shop THEN 'US 9' ELSE '' END AS sizes,
        CASE WHEN why = '' THEN concat_ws(',', CASE WHEN linked THEN 'jsonld' END, CASE WHEN shop THEN 'platform_json' END, 'html') ELSE '' END AS sources, CASE WHEN why <> '' THEN why WHEN title = '' THEN 'no_metadata' ELSE '' END AS error FROM f"""

TTL = """SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 7 DAYS ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS cached FROM events p WHERE event_type = 'purchase'"""
ORACLES = RESOLUTION | {
    "code_detect": DETECT,
    "page_codes": PAGE_CODES,
    "page_products": PAGE_PRODUCTS,
    "catalog_normalize": CATALOG,
    "market_sizes": MARKET,
    "seed_updates": SEEDS,
    "reparse_products": REPARSE,
    "eval_tags": f"WITH {sql('listings_raw')} SELECT product_id, array_to_string(list_filter(['cross_retailer', CASE WHEN contains({LOW}, '(gs)') OR contains({LOW}, 'grade school') OR contains({LOW}, 'kids') THEN 'gs' END, CASE WHEN contains({LOW}, 'women') OR contains({LOW}, 'wmns') OR contains({LOW}, '(w)') THEN 'womens' END], lambda x: x IS NOT NULL), ',') AS tags FROM listings_raw",
    "request_intake": INTAKE,
    "result_reuse": REUSE,
    "web_discovery": DISCOVERY,
    "image_ranking": IMAGES,
    "accuracy": ACCURACY,
    "human_override": OVERRIDE,
    "failure_maps": "WITH c AS (SELECT user_id, event_type, min(event_id) AS o, coalesce(string_agg(event_id::VARCHAR, '+' ORDER BY event_id) FILTER (value > 50), '') AS told FROM events GROUP BY ALL) SELECT user_id AS query_id, string_agg(event_type, ',' ORDER BY o) AS codes, coalesce(string_agg(event_type || '=' || told, ';' ORDER BY o) FILTER (told <> ''), '') AS details FROM c GROUP BY 1",
    "stage_timings": "WITH c AS (SELECT user_id, event_type, max(event_id) AS o, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id AS query_id, string_agg(event_type || '=' || round(v * 100)::BIGINT, ';' ORDER BY o) AS timings FROM c GROUP BY 1",
    "cascade_delete": "SELECT p_partkey AS product_id, 1::BIGINT AS n, (SELECT nullif(count(*), 0) FROM lineitem WHERE l_partkey = p_partkey) AS n_images FROM part WHERE p_size <= 40",

    "catalog_lookups": f"""WITH {sql('signals_raw')}, {sql('listings_raw')}, k AS (SELECT DISTINCT {normal("regexp_replace(part, '\\([^)]*\\)', '', 'g')")} AS style_code FROM (SELECT unnest(string_split(style_id, '/')) AS part FROM listings_raw)),
        c AS (SELECT query_id, style_code, min(CASE kind WHEN 'page_sku' THEN 0 WHEN 'web' THEN 1 ELSE 2 END) AS priority, min(ord) AS ord FROM signals_raw GROUP BY ALL)
        SELECT query_id, style_code, row_number() OVER (PARTITION BY query_id ORDER BY priority, ord) AS rank FROM c WHERE style_code NOT IN (SELECT style_code FROM k) QUALIFY rank <= 2""",
    "distinct_images": "SELECT source AS query_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS rank FROM documents WHERE lang <> 'de' GROUP BY source, sha256(text) QUALIFY rank <= 6",
    "not_sneakers": f"WITH {sql('requests_raw')} SELECT query_id, 'unresolved' AS status, 0.0::DOUBLE AS confidence, 'NOT_A_SNEAKER' AS failures, true AS review_required FROM requests_raw WHERE seen AND query_id % 9 = 4",
    "winner_updates": f"WITH {sql('outcomes_raw')} SELECT {normal('got')} AS style_code, expected AS name, '' AS brand, '' AS model, '' AS colorway, product_id IS NOT NULL AS authoritative, query_id AS ord FROM outcomes_raw WHERE status IN ('high', 'medium') AND got IS NOT NULL",
    "review_items": f"WITH {sql('outcomes_raw')} SELECT query_id, status, confidence, ms AS created_at, expected AS title, coalesce(nullif(got, ''), string_split(ranked, ',')[2]) AS top_candidate FROM outcomes_raw WHERE review_required AND NOT reviewed ORDER BY ms DESC, query_id LIMIT 50",
    "json_members": f"""WITH raw AS (SELECT p_partkey AS id, {PRODUCT_JSON} AS json FROM part UNION ALL SELECT -event_id - 1, props FROM events)
        SELECT r.id, replace(t.fullkey, '"', '') AS path, t.key AS key, trim(t.atom::VARCHAR, '"') AS value FROM (SELECT * FROM raw WHERE json_valid(json)) r, json_tree(r.json) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND t.key IS NOT NULL""",
    "seed_search": f"""WITH {sql('listings_raw')}, words_of AS (SELECT product_id, len(ws) AS size, unnest(ws) AS w FROM (SELECT product_id, list_distinct(list_filter(string_split_regex(lower(title || ' ' || colorway), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM listings_raw)),
        impacts AS (SELECT w, round(1000 * ln(1 + (SELECT count(DISTINCT product_id) FROM words_of)::DOUBLE / count(*)))::BIGINT AS impact FROM words_of GROUP BY w),
        asked AS (SELECT term, unnest(list_distinct(list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM (SELECT unnest([{t.names(catalog.SEED_QUERIES)}]) AS term)),
        matched AS (SELECT term, product_id, size, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (w) JOIN words_of USING (w) GROUP BY ALL)
        SELECT term, product_id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, size, product_id) AS rank FROM matched QUALIFY rank <= 20""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        a AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::BIGINT[] AS held, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM events
            UNION ALL
            SELECT user_id, i, CASE WHEN len(live) < 3 THEN live || [t] ELSE live END, event_id, len(live) < 3 FROM (SELECT e.user_id, e.i, e.t, e.event_id, list_filter(held, lambda h: h > e.t - 86400000000) AS live FROM a JOIN e ON e.user_id = a.user_id AND e.i = a.i + 1))
        SELECT event_id, admitted FROM a WHERE i > 0""",
    "knn_topk": f"WITH {near(10)} SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM ranked",
    "knn_resolve": f"""WITH {near(30)}, pooled AS (SELECT query_id, owner, max(s) AS s, arg_min(vec_id, (-round(s, 9), vec_id)) AS best_vec_id FROM ranked GROUP BY ALL),
        c AS (SELECT *, round(greatest(0.0, least(1.0, (s - 0.1) / (0.5 - 0.1))), 4)::DOUBLE AS confidence FROM pooled),
        r AS (SELECT *, row_number() OVER w AS rn, lead(confidence) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY query_id ORDER BY confidence DESC, owner))
        SELECT query_id, owner::BIGINT AS label, best_vec_id, confidence, coalesce(nxt >= confidence - 0.05, false) AS ambiguous, {tier("confidence")} AS tier FROM r WHERE rn = 1""",
    "similarity_to_group": f"SELECT q.vec_id AS query_id, q.label::BIGINT AS label, round(max(round({COSINE}, 9)), 5) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL",
    "url_normalize": f"SELECT page_id, {NORMAL_URL} AS url_key, {DOMAIN} AS domain FROM pages",
    "url_domain_counts": f"SELECT {DOMAIN} AS domain, count(*) AS n_pages, count(DISTINCT {NORMAL_URL}) AS n_urls FROM pages GROUP BY 1",
    "page_fields": PAGE_FIELDS,
    "page_tag_text": f"SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::BIGINT AS n_text, {TITLE} AS title FROM pages",
    "content_dedupe": "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY 2",
    "cache_key": rf"SELECT page_id, sha256(array_to_string(list_sort([sha256(html), sha256(url)]), '|') || '|' || {NORMAL_URL} || '|' || trim(regexp_replace(lower({TITLE}), '[ \t\n\r\f]+', ' ', 'g'))) AS cache_key FROM pages",
    "token_scan": f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{codes.TOKEN}'), lambda x: regexp_matches(x, '[0-9]')) AS ts FROM documents) SELECT doc_id, len(ts)::BIGINT AS n_tokens, array_to_string(list_sort(list_distinct(ts)), ' ') AS tokens FROM t",
    "title_attributes": f"WITH {sql('listings_raw')} SELECT product_id, {t.known_brand('title')} AS brand, CASE WHEN {t.known_brand('title')} IN ('Nike', 'Jordan') THEN 'Nike' ELSE {t.canonical_brand('title')} END AS family, {t.gender('title')} AS gender, {t.size_category('title')} AS size_category FROM listings_raw",
    "model_pairs": f"WITH {sql('listings_raw')}, {sql('requests_raw')}, pairs AS (SELECT product_id, l.title AS a, v_model AS b FROM listings_raw l JOIN requests_raw ON query_id = ord), {t.alike('pairs')} SELECT product_id, round(sim, 4) AS similarity FROM pairs JOIN alike USING (a, b)",
    "search_terms": SEARCH,
    "colour_tokens": f"WITH {sql('listings_raw')}, texts AS (SELECT p_name AS txt FROM part UNION ALL SELECT colorway FROM listings_raw), {t.tinted('texts')} SELECT txt, count(*) AS n, array_to_string(any_value(once), ',') AS colours FROM texts JOIN tinted USING (txt) GROUP BY txt",
    "colour_similarity": f"WITH {sql('listings_raw')}, {sql('requests_raw')}, pairs AS (SELECT product_id, colorway, l.title, coalesce(nullif(v_official, ''), v_colorway) AS shown FROM listings_raw l JOIN requests_raw ON query_id = ord), texts AS (SELECT colorway AS txt FROM pairs UNION SELECT title FROM pairs UNION SELECT shown FROM pairs), {t.tinted('texts')} SELECT product_id, round({t.tint_similarity('x', 'y')}, 4) AS similarity, round({t.tint_similarity('x', 'z')}, 4) AS with_title FROM pairs JOIN tinted x ON x.txt = colorway JOIN tinted y ON y.txt = shown JOIN tinted z ON z.txt = title",
    "json_identifiers": "WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) SELECT event_id, lower(regexp_replace(k, '[- ]', '', 'g')) AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM k",
    "evidence_merge": "WITH k AS (SELECT user_id, event_type, max(value) AS weight, min(event_id) AS ord FROM events GROUP BY ALL) SELECT user_id AS query_id, count(*) AS n_evidence, max(weight) AS best_weight, min(ord) AS first_ord, string_agg(event_type, ',' ORDER BY ord) AS kinds FROM k GROUP BY 1",
    "evidence_arg_max": "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "web_agreement_trust": rf"""WITH h AS (SELECT regexp_extract(url, '/(\d+)', 1) AS code, {DOMAIN} AS domain, contains(url, '/en/') AS labeled, page_id AS ord FROM pages),
        f AS (SELECT code, domain, arg_min(labeled, ord) AS labeled, min(ord) AS ord FROM h WHERE code <> '' AND domain <> '' GROUP BY ALL)
        SELECT code, count(*) AS n_domains, round(sum(CASE WHEN domain LIKE '%.example.com' THEN 1.0::DOUBLE WHEN domain LIKE '%.example.org' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN labeled THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END), 6) AS trust, min(ord) AS first_ord FROM f GROUP BY 1""",
    "multi_source_keys": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY 1 HAVING n_suppliers >= 20",
    "latest_n_per_key": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
    "anti_missing": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "semi_held_out": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "lookup_fill": "SELECT c_custkey, coalesce(nullif(n_name, ''), c_mktsegment) AS filled FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey",
    "segment_join": SEGMENTS,
    "choose_listing": """WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS t, arg_min(p_size, p_partkey) AS s FROM part GROUP BY 1)
        SELECT p_brand, (SELECT p_partkey FROM part q WHERE q.p_brand = p.p_brand ORDER BY (length(p_name) > 20) DESC, p_retailprice DESC, p_partkey LIMIT 1) AS chosen, bool_or(p_type <> t OR p_size <> s) AS ambiguous, count(*) AS n_listings FROM part p JOIN f USING (p_brand) GROUP BY p_brand""",
    "market_min_max": "SELECT l_partkey, min(l_extendedprice) FILTER (l_returnflag = 'R') AS lowest_ask, max(l_extendedprice) FILTER (l_returnflag = 'A') AS highest_bid, count(*) AS n_rows FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1",
    "ttl_cache_lookup": TTL,
    "sliding_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "daily_budget": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events",
    "rank_and_gap": f"""WITH s AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 500000.0, 4) AS score FROM orders), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey))
        SELECT o_custkey, o_orderkey, score, coalesce(nxt >= round(score - 0.05, 4), false) AS ambiguous, {tier("score")} AS tier FROM r WHERE rn = 1""",
    "review_queue": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "eval_metrics": """WITH t AS (SELECT CASE WHEN len(string_split(text, ' ')) >= 20 THEN 1 ELSE 0 END AS g, quality AS q, (length(text) % 1000)::DOUBLE AS l FROM documents JOIN labels USING (doc_id))
        SELECT count(*) AS n, round(count(*) FILTER (g = q) / count(*), 6) AS accuracy, round(count(*) FILTER (g = q AND g = 1) / nullif(count(*) FILTER (g = 1), 0), 6) AS precision, round(count(*) FILTER (g = 1 AND q <> 1) / nullif(count(*) FILTER (q = 0), 0), 6) AS false_positive_rate, round(avg(l), 6) AS mean_latency, median(l) AS median_latency FROM t""",
    "upsert_merge": UPSERT,
    "committed_upsert": UPSERT,
    "image_insert_absent": """WITH t AS (SELECT source, sha256(text) AS digest, doc_id, lang FROM documents) SELECT source, digest, min(doc_id) AS doc_id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.lang = 'en' AND b.source = a.source AND b.digest = a.digest) GROUP BY source, digest""",
    "latest_status": "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ttl_cache_stream": TTL,
    "stream_latest_status": "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 50",
    "ordered_distinct_urls": r"SELECT regexp_replace(url, '\?.*$', '') AS url_key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1",
}
