import math
import random
import re

from attestra.llm import url_templates as ut

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    path = re.split(r"[?#]", rest[cut.start() :])[0] if cut else ""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "http://example.net/en", "https://net/x", "http://notnet/x", "http://x.net", "http://x.net?q=/en/",
    "http://a.example.com/de/1#top", "http://b.org/fr/2?x=1", "http://b.org/FR/2", "ftp://ÉX.org/fr/", "http://a/b://c/d", "http://example.net/en/\nx", "http://u@h.example.com:80/de/",
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, 1, "t") for i, u in enumerate(URLS)] + [(4, URLS[4], 1, "t"), (None, URLS[4], 1, "t")], "page_id long, url string, n int, template string")
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "doc_id long, bad boolean")
    got = ut.url_filter(pages, labels).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id if r.page_id is not None else 4])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert ut.url_filter(pages.limit(0), labels).count() == 0
    assert ut.url_filter(pages, labels.limit(0)).count() == len(URLS) + 2


def test_bad_templates_are_rejected_and_good_ones_are_not(spark):
    rows = [(i, f"http://shop.example/{'spam' if i % 2 else 'item'}/{1000 + i}.html") for i in range(200)]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)], "id long, bad boolean")
    got = {r.page_id: r for r in ut.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=[]).collect()}
    assert {got[i].template for i in range(200)} == {"/spam/{n}.html", "/item/{n}.html"}
    assert all((got[i].verdict == "block") == bool(i % 2) for i in range(200))


def test_alike_and_many_branches_merge(spark):
    rows = [(i, f"http://h.example/{chr(97 + i % 26)}x/p") for i in range(260)] + [(1000 + i, f"http://g.example/{'ab'[i % 2]}/p") for i in range(20)]
    got = ut.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1000 + i, False) for i in range(20)], "id long, bad boolean"), rules=[]).collect()
    assert {r.template for r in got} == {"/*/p"} and {r.verdict for r in got} == {"allow"}


def test_a_bad_section_is_kept_among_many_siblings_and_at_any_depth(spark):
    names = [f"{a}{b}" for a in "abcdef" for b in "ghijk"]  # 30 sections, one of them bad
    rows = [(i, f"http://many.example/{names[i % 30]}/p") for i in range(1200)]
    # The first segments that differ are the sixth ones.
    rows += [(2000 + i, f"http://deep.example/a/b/c/d/e/{'spam' if i % 2 else 'item'}/x") for i in range(200)]
    # Deeper than any other and alone: keeps its own segments.
    rows += [(3000, "http://lone.example/" + "/".join("qrstuvwxyz")), (3001, "http://lone.example/"), (3002, "http://lone.example/q")]
    labels = [(i, i % 30 == 7) for i in range(900)] + [(2000 + i, bool(i % 2)) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in ut.url_filter(pages, spark.createDataFrame(labels, "id long, bad boolean"), rules=[]).collect()}
    assert len(got) == len(rows)
    assert all((got[i].verdict == "block") == (i % 30 == 7) for i in range(1200))
    assert got[7].template == f"/{names[7]}/p"
    assert all((got[2000 + i].verdict == "block") == bool(i % 2) for i in range(200))
    assert {got[2000 + i].template for i in range(200)} == {"/a/b/c/d/e/spam/x", "/a/b/c/d/e/item/x"}
    assert [got[3000 + i].template for i in range(3)] == ["/q/r/s/t/u/v/w/x/y/z", "", "/q"]


def brute_verdicts(rows, labels, z=2.0, prior=4.0, reject=0.5):
    """Template and verdict of every url by walking the tree of each host, node by node."""
    def shape(s):
        stem, ext = re.match(r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", s).groups()
        mark = "{n}" if re.fullmatch("[0-9]+", stem) else "{id}" if re.fullmatch("[0-9a-fA-F-]{16,}", stem) else re.sub("[0-9]+", "{n}", stem) if re.search("[0-9]{3}", stem) else stem
        return mark + (ext or "")

    bad = {}
    for i, b in labels:
        bad[i] = bad.get(i, False) or b
    tree, paths = {}, {}
    for i, url in rows:
        host, path, _, _ = brute(url)
        key = host, tuple(shape(s) for s in path.split("/") if s)
        n = tree.setdefault(key, [0, 0])
        paths[i] = key
        if i in bad:
            n[0] += 1
            n[1] += bad[i]
    templates = {}

    def judge(host, template, own, level):
        for key in [k for k in own if len(k[1]) <= level]:
            templates[key] = template
        own = [k for k in own if len(k[1]) > level]
        if len(own) == 1:
            templates[own[0]] = template + "/" + "/".join(own[0][1][level:])
            return
        labels, bads = (sum(tree[k][j] for k in own) for j in (0, 1))
        rate, below = (bads + 0.5) / (labels + 1), {}
        for k in own:
            below.setdefault(k[1][level], []).append(k)
        counts = {seg: [sum(tree[k][j] for k in branch) for j in (0, 1)] for seg, branch in below.items()}
        # pools: branches that stand out by thousandths of their rate, and all the others
        pools = {}
        for seg, (n, b) in counts.items():
            p = (b + rate) / (n + 1)
            error = (max(rate * (1 - rate), p * (1 - p)) / (n + 1)) ** 0.5
            stands_out = abs(p - rate) > (z * z + 2 * math.log(len(below))) ** 0.5 * error
            pools.setdefault(math.floor(p * 1000) if stands_out else None, []).append(seg)
        total = lambda segs: [sum(counts[x][j] for x in segs) for j in (0, 1)]
        key = lambda i: float(i) if i is not None else (total(pools[None])[1] + rate) / (total(pools[None])[0] + 1) * 1000
        groups = []
        for i in sorted(pools, key=lambda i: (key(i), i is None)):
            n, b = total(pools[i])
            if groups:
                m, c = total(groups[-1])
                pooled = (b + c) / (n + m) if n + m else 0
                if not n or not m or abs(b / n - c / m) <= z * (pooled * (1 - pooled) * (1 / n + 1 / m)) ** 0.5:
                    groups[-1] += pools[i]
                    continue
            groups.append(list(pools[i]))
        steps = {}
        main = next((i for i, g in enumerate(groups) if None in pools and pools[None][0] in g), 0)
        for i, g in enumerate(groups):
            steps[g[0] if len(g) == 1 else "*" if i == main else f"*{i}"] = [k for seg in g for k in below[seg]]
        for step, branch in steps.items():
            judge(host, f"{template}/{step}", branch, level + 1)

    for host in {k[0] for k in tree}:
        judge(host, "", [k for k in tree if k[0] == host], 0)
    total = sum(n for n, _ in tree.values()), sum(b for _, b in tree.values())
    share, out = (total[1] + 0.5) / (total[0] + 1), {}
    for i, key in paths.items():
        add = lambda test: [sum(tree[k][j] for k in tree if test(k)) for j in (0, 1)]  # noqa: E731, B023
        n, b = add(lambda k: k[0] == key[0] and templates[k] == templates[key])  # noqa: B023
        hn, hb = add(lambda k: k[0] == key[0])  # noqa: B023
        of_host = (hb + prior * share) / (hn + prior)
        out[i] = templates[key], "block" if (b + prior * of_host) / (n + prior) >= reject else "allow"
    return out


def test_templates_and_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    hosts, words = ["a.example", "B.example", "c.example"], ["news", "shop", "spam", "item", "x1", "deadbeefdeadbeef", "p2024.html", "42", "7.html", "big9999"]
    rows = [(i, f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(600)] + [(900, None), (901, "http://c.example/" + "/".join(["deep"] * 40))]
    labels = [(i, rng.random() < (0.9 if "spam" in (u or "") else 0.1)) for i, u in rows if rng.random() < 0.6]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, template string, `a.b` int").repartition(3)
    got = {r.page_id: r for r in ut.url_filter(pages, spark.createDataFrame(labels, "id long, bad boolean"), rules=[]).collect()}
    want = brute_verdicts(rows, labels)
    assert {i: (r.template, r.verdict) for i, r in got.items()} == want and {v for _, v in want.values()} == {"allow", "block"}


def test_alike_sections_are_one_and_bad_ones_another(spark):
    """30 sections of 100 labelled urls, two all bad: the 28 others are alike, however much the bad ones move their host's rate."""
    rows = [(i, f"http://h.example/s{chr(97 + i % 30)}/p") for i in range(3000)]
    labels = [(i, i % 30 in (3, 8)) for i in range(3000)]
    got = ut.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad boolean"), rules=[]).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.template, r.verdict), set()).add(r.page_id % 30)
    assert groups == {("/*/p", "allow"): set(range(30)) - {3, 8}, ("/*1/p", "block"): {3, 8}}
    # Half of them bad: no rate in the middle hides that there are two kinds.
    labels = [(i, i % 30 < 15) for i in range(3000)]
    got = ut.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad boolean"), rules=[]).collect()
    assert all((r.verdict == "block") == (r.page_id % 30 < 15) for r in got) and len({r.template for r in got}) == 2


def test_lone_bad_labels_are_chance(spark):
    """One label a section, one in a hundred bad: none of them stands out."""
    rows = [(i, f"http://h.example/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}/p") for i in range(1000)]
    labels = [(i, i % 100 == 7) for i in range(1000)]
    got = ut.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad boolean"), rules=[]).collect()
    assert {(r.template, r.verdict) for r in got} == {("/*/p", "allow")}
