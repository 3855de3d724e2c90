import random
import re

from attestra.llm import licenses


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        own = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


NOTES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.",
]
LABELS = ["mit", "apache-2", "gpl-3", "cc-by-nc", "cc-by-sa"]


def test_base_equals_brute_force_and_labels_are_found(spark):
    rng = random.Random(6)
    vocab = ["the", "by", "of", "éau", "license", "mit", "version", "2", "Naïve", "cc", "nc", "work", "x1"]
    texts = [None, "", "the\x80mit license", "the mit\nlicense THE-MIT-LICENSE", "the mit licenses", "K", *NOTES]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(80))) for _ in range(100)]
    texts += ["plain prose of nothing much " * 5 for _ in range(100)]
    texts += [f"eau de {n} la fin" for n in NOTES] + ["license " * 20_000 + NOTES[0]]
    docs = spark.createDataFrame([(i, t, 0, []) for i, t in enumerate(texts)], "doc_id long, text string, base int, hits array<int>")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    for k, label in enumerate(LABELS):
        for i in (6 + k, 211 + k):
            assert label in got[i].labels.split(",") and got[i].score > 0.5, (texts[i], got[i])
    assert got[216].labels == "mit"
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_key_phrases_must_stand_in_place(spark):
    rows = [(1, "gnu public general license version 3 licensed work"), (2, "licensed under the gnu general public license version 9"), (3, NOTES[2])] + [(10 + i, "prose") for i in range(50)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "gpl-3"


PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"


def test_a_file_keeps_the_labels_of_all_its_notices(spark):
    gpl = NOTES[2]
    rows = [(1, f"{PERMISSION}. {gpl}"), (2, f"{gpl} {PERMISSION}."), (3, " filler ".join([PERMISSION, *NOTES]))] + [(10 + i, "prose") for i in range(50)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == "gpl-3,mit"
    assert got[3] == ",".join(sorted(LABELS))


def test_a_notice_that_most_documents_carry_is_found(spark):
    rows = [(i, f"{NOTES[2]} {PERMISSION} {i}" if i % 5 < 3 else "prose") for i in range(100)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (("gpl-3,mit", 1.0) if i % 5 < 3 else ("", 0.0)) for i in range(100))


def test_labelling_phrases_and_their_places(spark):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    texts = [
        "released under the MIT License", "see the mit license", "the mit license applies; use is under the mit license", "mit license under the",
        "Under the Apache License, Version 2.0, CC BY-NC", "the apache license", "under the mit licenses", "prose",
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ws = re.findall(r"[a-z0-9]+", text.lower())
        at = {label: [j for j in range(len(ws)) if ws[j : j + len(p.split())] == p.split()] for label, p in phrases.items()}
        places, labels = sum(at.values(), []), ",".join(sorted(label for label, js in at.items() if js))
        r = got[i]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), labels), text


def test_a_few_words_of_a_notice_score_low(spark):
    """Shares are of the whole template by rarity in the corpus."""
    prose = ["the and of to in is it that a for any this with or without under use copy " + w for w in ("sun", "moon", "rain", "wind")]
    rows = [(1, "the mit license"), (2, "released under the MIT license"), (3, "see the mit license here"), (4, PERMISSION), (5, "permission is hereby granted to park free of charge")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows + [(100 + i, prose[i % 4]) for i in range(200)], "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score) == ("", 0.0) and got[3].labels == "" and got[5].labels == ""
    assert (got[2].labels, got[2].score) == ("mit", 1.0) and (got[4].labels, got[4].score) == ("mit", 1.0)


def test_idf_orders_the_words_of_a_template():
    index = licenses.Index()
    idf, rarest = index.weigh({"the": 900, "software": 10, "obtaining": 0}, 1000)
    assert idf["the"] < idf["software"] < idf["obtaining"]
    assert all(len(ps) == min(licenses.RAREST, len(ws)) for ps, ws in zip(rarest, index.words, strict=True))
    assert all("the" not in [ws[p] for p in ps] for ps, ws in zip(rarest, index.words, strict=True) if len(ws) > 12)


def test_long_notices_with_changes(spark):
    """A long notice is found with some of its words changed in place, and lost where its key phrase is gone."""
    for t in licenses.TEMPLATES:
        ws = t.text.split()
        if len(ws) < 25:
            continue
        held = {i for p in t.phrases for i in range(len(ws)) for j in range(len(p.split())) if ws[i - j : i - j + len(p.split())] == p.split()}
        changed = [w if i in held or i % 10 else "xx" for i, w in enumerate(ws)]
        broken = [w if i not in held else "yy" for i, w in enumerate(ws)]
        rows = [(1, "Intro. " + " ".join(changed).upper() + " outro"), (2, " ".join(broken)), (3, " ".join(ws))] + [(10 + i, "prose") for i in range(20)]
        got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert t.label in got[1].labels.split(",") and 0.75 <= got[1].score < 1, t
        assert t.label not in got[2].labels.split(",") and got[3].score == 1.0
