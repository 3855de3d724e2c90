"""SQL forms of the text functions, for the oracles: expressions over column names, without lookarounds."""

from __future__ import annotations

from ..functions import models, text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(xs: list[str]) -> str:
    return ", ".join(map(quoted, xs))


def brand_case(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {quoted(chr(32) + a)})' for a in aliases)} THEN '{brand}'" for brand, aliases in text.BRANDS) + " ELSE '' END"


def known_brand(c: str) -> str:
    return brand_case(f"' ' || lower(coalesce({c}, '')) || ' '")


def canonical_brand(c: str) -> str:
    return f"coalesce(nullif({known_brand(c)}, ''), trim(coalesce({c}, '')))"


def known_family(c: str) -> str:
    return f"lower(CASE WHEN {known_brand(c)} IN ('Nike', 'Jordan') THEN 'Nike' ELSE {known_brand(c)} END)"


def pattern_case(rules: list[tuple[str, str]], c: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({c}, '')), {quoted(p)}) THEN '{name}'" for name, p in rules) + f" ELSE {other} END"


def gender_word(c: str) -> str:
    return pattern_case(text.GENDERS, c, "'unknown'")


def size_category(c: str) -> str:
    return pattern_case(text.CATEGORIES, c, f"CASE WHEN {gender_word(c)} <> 'unknown' THEN 'adult' ELSE 'unknown' END")


def gender(c: str) -> str:
    return f"CASE WHEN {size_category(c)} IN ('td', 'ps', 'gs') THEN 'kids' ELSE {gender_word(c)} END"


def height_test(c: str, name: str) -> str:
    base, wanted, others = models.HEIGHTS[name]
    tail = f"regexp_extract({c}, {quoted(f'(?is)(?:{base})' + chr(92) + 'b(.*)$')}, 1)"
    stretch = f"regexp_extract({tail}, {quoted('^' + models.STRETCH)}, 0)"
    words = rf"list_filter(string_split_regex({stretch}, '\s+'), lambda w: w <> '')"
    place = lambda pattern: f"coalesce(list_position(list_transform({words}, lambda w: regexp_matches(w, {quoted(pattern)})), true), 0)"
    at, barred = place(rf"(?i)\b(?:{wanted})\b"), place(rf"(?i)^(?:{others})\b")
    test = f"({at} BETWEEN 1 AND {models.HEIGHT_WITHIN + 1} AND ({barred} = 0 OR {at} < {barred}))"
    if name == models.NO_HEIGHT:
        any_height = place(r"(?i)^(?:low|mid|high|hi)\b")
        test = f"({test} OR ({tail} = {stretch} AND len({words}) <= {models.NO_HEIGHT_WITHIN} AND {any_height} = 0))"
    there = quoted(f"(?i)(?:{base})" + r"\b")
    return f"(regexp_matches({c}, {there}) AND {test})"


def model(c: str) -> str:
    """Canonical name of a text that is not null."""
    test = lambda name, pattern: regexp(c, pattern) if pattern else height_test(c, name)
    return "CASE " + " ".join(f"WHEN {test(name, pattern)} THEN {quoted(name)}" for name, pattern in models.MODELS) + " ELSE '' END"


def regexp(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted('(?i)(?:' + pattern + ')')})"


def model_pattern(name: str) -> str:
    """Pattern of the model named in a column."""
    return f"CASE {name} " + " ".join(f"WHEN {quoted(n)} THEN {quoted('(?i)(?:' + (p or models.height_pattern(n)) + ')')}" for n, p in models.MODELS) + " END"


def colour_text(t: str, name: str) -> str:
    """What is left of the trimmed title t, whose model is name."""
    q = quoted(r"""['"“‘]([^'"”’]+)['"”’]""")
    aliases = "|".join(rf"\Q{a}\E" for a in text.REMOVED)
    bare = f"CASE WHEN {name} = '' THEN {t} ELSE regexp_replace({t}, {model_pattern(name)}, ' ', 'g') END"
    alias_pattern, piece_pattern = quoted(rf"(?i)\b(?:{aliases})\b"), quoted(rf"{models.TITLE_WORD}(?:\.\d)?|[^\p{{L}}\p{{N}}_'’]+")
    bare = f"regexp_replace(regexp_replace({bare}, {alias_pattern}, ' ', 'g'), '[-–|:]+', '/', 'g')"
    none = quoted(rf"(?i)^(?:{'|'.join(models.NO_COLOUR)}|\d{{1,2}}(?:\.\d)?)$")
    kept = f"array_to_string(list_transform(regexp_extract_all({bare}, {piece_pattern}), lambda w: CASE WHEN regexp_matches(w, {none}) THEN ' ' ELSE w END), '')"
    return rf"CASE WHEN regexp_extract({t}, {q}, 1) <> '' THEN regexp_extract({t}, {q}, 1) ELSE regexp_replace(regexp_replace({kept}, '\s+', ' ', 'g'), '^[ /]+|[ /]+$', '', 'g') END"


def sub_model(t: str, name: str) -> str:
    stands = lambda w: quoted(rf"(^|[^a-z0-9])\Q{w}\E($|[^a-z0-9])")
    words = ", ".join(f"CASE WHEN regexp_matches(lower({t}), {stands(w)}) THEN {quoted(w)} END" for w in models.SUB_MODELS)
    return f"CASE WHEN {name} <> '' THEN array_to_string(list_filter([{words}], lambda w: w IS NOT NULL), ' ') ELSE '' END"


def parsed(source: str) -> str:
    """Relations titled_m and titled of distinct (title, hint) in source: brand, model, sub_model, gender, size_category, collab, colorway_text."""
    collab = quoted(rf"(?i)\b({models.COLLABS})\b")
    brand = f"""CASE WHEN model LIKE 'Air Jordan%' THEN 'Jordan' WHEN own <> '' AND own = told AND said = 'Jordan' THEN 'Jordan' WHEN own = '' AND model LIKE 'Nike%' THEN 'Nike' WHEN own = '' AND model LIKE 'adidas%' THEN 'adidas' ELSE own END"""
    return f"""titled_m AS (SELECT title, hint, t, told, said, CASE WHEN told <> '' THEN {canonical_brand('told')} ELSE said END AS own, {model('t')} AS model
        FROM (SELECT title, hint, trim(coalesce(title, '')) AS t, trim(coalesce(hint, '')) AS told, {known_brand("trim(coalesce(title, ''))")} AS said FROM (SELECT DISTINCT title, hint FROM {source}))),
    titled AS (SELECT title, hint, {brand} AS brand, model, {sub_model('t', 'model')} AS sub_model, {gender('t')} AS gender, {size_category('t')} AS size_category, regexp_extract(t, {collab}, 1) AS collab, {colour_text('t', 'model')} AS colorway_text FROM titled_m)"""


def colours(c: str) -> str:
    """Colours and nicknames of a column in order, as a list; phrases become one word by replacement, the longest first."""
    low = f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '&| and ', '/', 'g'), '[()\\[\\]'']', ' ', 'g')"
    for p in text.PHRASES:
        # Twice: a phrase that ends where the next one begins.
        for _ in range(2):
            low = f"regexp_replace({low}, {quoted(f'(^|[^a-z]){p}($|[^a-z])')}, {quoted(chr(92) + '1' + text.SYNONYMS[p].replace(' ', '_') + chr(92) + '2')}, 'g')"
    named = "CASE w " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in text.SYNONYMS.items()) + " ELSE replace(w, '_', ' ') END"
    words = rf"list_filter(list_transform(list_filter(string_split_regex({low}, '[\s/,\-–|]+'), lambda w: w <> ''), lambda w: {named}), lambda w: w IN ({names(text.KNOWN)}))"
    return words


def tinted(source: str) -> str:
    """Relation tinted: distinct texts txt of source with their colours, nicknames and leading primary."""
    return f"""tinted_w AS (SELECT txt, {colours('txt')} AS ws FROM (SELECT DISTINCT txt FROM {source})),
    tinted_d AS (SELECT txt, ws, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS once FROM tinted_w),
    tinted_s AS (SELECT txt, once, list_filter(once, lambda w: w NOT IN ({names(text.NICKNAMES)})) AS cs, list_filter(once, lambda w: w IN ({names(text.NICKNAMES)})) AS ns FROM tinted_d),
    tinted AS (SELECT txt, once, cs, ns, list_filter(string_split(array_to_string(cs, ' '), ' '), lambda w: w IN ({names(text.PRIMARIES)}))[1] AS lead FROM tinted_s)"""


def tint_similarity(x: str, y: str) -> str:
    """Similarity of two rows of tinted."""
    jaccard = lambda f: f"len(list_intersect({x}.{f}, {y}.{f}))::DOUBLE / len(list_distinct({x}.{f} || {y}.{f}))"
    both = lambda f: f"len({x}.{f}) > 0 AND len({y}.{f}) > 0"
    turned = f"CASE WHEN {x}.lead <> {y}.lead THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"
    return f"least(CASE WHEN {both('cs')} THEN {jaccard('cs')} * {turned} END, CASE WHEN {both('ns')} THEN {jaccard('ns')} END)"


def nickname_score(nickname: str, name: str) -> str:
    words = lambda c: f"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2))"
    x, y = words(nickname), words(name)
    inside = f"len({x}) > 0 AND len(list_filter({x}, lambda w: NOT list_contains({y}, w))) = 0"
    return f"CASE WHEN {inside} AND len({x}) = len({y}) THEN 0.95::DOUBLE WHEN {inside} AND len({x}) > 1 THEN 0.85::DOUBLE WHEN {inside} THEN 0.5::DOUBLE END"


def ratio(a: str, b: str) -> str:
    """Indel similarity of two texts, 0 to 100, by the rows of their table of common subsequences."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN ca = {b}[j] THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0::BIGINT])"
    lcs = f"list_last(list_reduce(string_split({a}, ''), lambda row, ca: {row}, list_resize([0::BIGINT], length({b}) + 1, 0)))"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * {lcs} / (length({a}) + length({b})) END"


def alike(source: str) -> str:
    """Relation alike: a, b, x, y and sim of distinct pairs of texts (a, b) of source, whose canonical names are x and y."""
    words = lambda c: rf"list_distinct(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"
    return f"""alike_n AS (SELECT DISTINCT txt, {model('txt')} AS name FROM (SELECT a AS txt FROM {source} UNION SELECT b FROM {source}) WHERE txt IS NOT NULL),
    alike_p AS (SELECT a, b, coalesce(m.name, '') AS x, coalesce(n.name, '') AS y FROM (SELECT DISTINCT a, b FROM {source}) LEFT JOIN alike_n m ON m.txt = a LEFT JOIN alike_n n ON n.txt = b),
    alike_w AS (SELECT *, {words('p')} AS ps, {words('q')} AS qs FROM (SELECT *, CASE WHEN x <> '' AND y <> '' THEN x ELSE lower(a) END AS p, CASE WHEN x <> '' AND y <> '' THEN y ELSE lower(b) END AS q FROM alike_p)),
    alike_s AS (SELECT *, array_to_string(list_sort(list_intersect(ps, qs)), ' ') AS shared, array_to_string(list_sort(list_filter(ps, lambda w: NOT list_contains(qs, w))), ' ') AS l, array_to_string(list_sort(list_filter(qs, lambda w: NOT list_contains(ps, w))), ' ') AS r FROM alike_w),
    alike_r AS (SELECT *, trim(shared || ' ' || l) AS one, trim(shared || ' ' || r) AS two FROM alike_s),
    alike_t AS (SELECT *, CASE WHEN shared <> '' AND (l = '' OR r = '') THEN 100.0::DOUBLE ELSE greatest({ratio('one', 'two')}, CASE WHEN shared <> '' THEN {ratio('shared', 'one')} END, CASE WHEN shared <> '' THEN {ratio('shared', 'two')} END) END AS words FROM alike_r),
    alike AS (SELECT a, b, x, y, CASE WHEN x <> '' AND y <> '' AND x = y THEN 1.0::DOUBLE WHEN x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) THEN 0.6::DOUBLE WHEN x <> '' AND y <> '' THEN words / 200 WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN NULL ELSE words / 100 END AS sim FROM alike_t)"""


def compatible(a: str, b: str, *unknown: str) -> str:
    blank = names(["", "unknown", *unknown])
    return f"CASE WHEN coalesce({a}, '') IN ({blank}) OR coalesce({b}, '') IN ({blank}) THEN NULL ELSE {a} = {b} END"
