"""License scans: a positional index of rare template tokens, intersected by relative position, verified by key phrases.

Templates are licence notices. How many documents of the corpus have each template word is counted in one aggregate; from it comes
its inverse document frequency (IDF), and a template's rarest words, by IDF, are its postings. A file's words that are among some
template's rarest are looked up, and their postings intersected by (position in the text - position in the template). An alignment
that holds half of a template's rarest words is a candidate; it labels the file if every mandatory key phrase stands in its place and
the words in place make up enough of the IDF of the *whole* template. So a few words of a notice score low, common words count for
little, and a file keeps the labels of all its notices, however many it carries and however common they are in the corpus.

Plan: one pass over the texts writes, for each, which template words it has, where the phrases start, and for texts with a key phrase
where template words stand; counts of at most the vocabulary's size reach the driver; alignments are array expressions on the
written rows.

Defined cases: null and empty texts have no words, empty labels and score 0; a null id stays null; repeated rows give a row each;
alignments that tie all count, and labels are sorted; words of equal IDF rank by text, then place; an empty table gives an empty result;
a very long text is scanned whole, and what is kept of it are its template words; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that label by themselves.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: A template's words that are looked up.
RAREST = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted", "without restriction"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("apache license version 2", "in compliance with the license"),
    ),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        ("gnu general public license", "version 3"),
    ),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("gnu general public license", "version 2"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license", "version 2")),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template(
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        ("redistribution and use in source and binary forms", "endorse or promote products"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


class Index:
    """Words of the templates and phrases, key phrases with their places in each template; all bounded by the templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None):
        self.templates = templates
        self.words = [t.text.split() for t in templates]
        self.phrases = sorted({p for t in templates for p in t.phrases})
        self.vocabulary = sorted({w for ws in self.words for w in ws} | {w for p in (*self.phrases, *(PHRASES if phrases is None else phrases).values()) for w in p.split()})
        # (phrase, place in the template) for each template
        self.places = [[(self.phrases.index(p), next(i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())) for p in t.phrases] for t, ws in zip(templates, self.words, strict=True)]

    def weigh(self, seen: dict[str, int], n: int) -> tuple[dict[str, float], list[list[int]]]:
        """IDF of every word, given how many of n documents have it, and the places of each template's rarest words."""
        idf = {w: math.log(1 + (n + 1) / (seen.get(w, 0) + 0.5)) for w in self.vocabulary}
        return idf, [sorted(sorted(range(len(ws)), key=lambda p: (seen.get(ws[p], 0), ws[p], p))[:RAREST]) for ws in self.words]


def starts(words: Column, phrase: str) -> Column:
    """Word positions, from 0, where the phrase's words stand one after another."""
    ws = phrase.split()
    at = lambda i: F.get(words, i) == F.lit(ws[0])
    first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)
    rest = lambda i: F.slice(words, i + 1, F.lit(len(ws))) == F.array(*map(F.lit, ws))
    return F.filter(first, rest)


def scan(docs: DataFrame, index: Index, phrases: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, present (numbers of the vocabulary's words), base (starts of each labelling phrase), keys (of each key phrase), hits (place: word, of
    texts with a key phrase); written."""
    df = texts(docs, id_col, text_col).select("doc_id", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    known = F.array(*map(F.lit, index.vocabulary))
    df = df.select("doc_id", "words", F.array_intersect("words", known).alias("own"))
    number = {w: i for i, w in enumerate(index.vocabulary)}
    # Words are looked for one after another only in texts that have all of them.
    whole = lambda p: F.forall(F.array(*map(F.lit, sorted(set(p.split())))), lambda w: F.array_contains("own", w))
    none = F.array().cast("array<int>")
    places = lambda ps: F.when(F.size("own") > 0, F.array(*[F.when(whole(p), starts(F.col("words"), p)).otherwise(none) for p in ps]))
    df = df.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), "own", places(phrases.values()).alias("base"), places(index.phrases).alias("keys"))
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.try_element_at(numbers, w).alias("w"))), lambda h: h["w"].isNotNull())
    keyed = F.exists("keys", lambda k: F.size(k) > 0)
    return materialize(df.select("doc_id", "n_words", F.transform("own", lambda w: F.try_element_at(numbers, w)).alias("present"), "base", F.when(keyed, F.col("keys")).alias("keys"), F.when(keyed, hits).alias("hits")), "licences")


def runs(codes: Column) -> Column:
    """Distinct values of an array of longs with their counts: sort, keep the ends of runs."""

    def count(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i + 1), F.lit(True)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i).alias("code"), (i - F.coalesce(F.when(k > 0, F.get(e, k - 1)), F.lit(-1))).alias("n"))))

    return F.when(F.size(codes) > 0, let(F.sort_array(codes), count)).otherwise(F.array().cast("array<struct<code:bigint,n:int>>"))


def license_scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: tuple[Template, ...] = TEMPLATES, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (IDF in place of the best template found, of all its IDF).

    share: part of a template's IDF that must be in place.
    """
    phrases = PHRASES if phrases is None else phrases
    index = Index(templates, phrases)
    df = scan(docs, index, phrases, id_col=id_col, text_col=text_col)
    # At most a row for each word of the vocabulary.
    counts = {index.vocabulary[r.w]: r["count"] for r in df.select(F.explode("present").alias("w")).groupBy("w").count().collect()}
    idf, rarest = index.weigh(counts, df.count())
    number = {w: i for i, w in enumerate(index.vocabulary)}
    postings = [[(t, p) for t, ps in enumerate(rarest) for p in ps if index.words[t][p] == w] for w in index.vocabulary]
    # An alignment's code: template * 2^40 + position in the text - position in the template + 2^30.
    table = F.array(*[F.array(*[F.lit(t * 2**40 + 2**30 - p) for t, p in ps]) if ps else F.array().cast("array<bigint>") for ps in postings])
    codes = lambda hits: F.flatten(F.transform(hits, lambda h: F.transform(F.get(table, h["w"]), lambda q: q + h["pos"])))
    least = F.array(*[F.lit((len(ps) + 1) // 2) for ps in rarest])
    template_of = lambda code: F.floor(code / F.lit(2**40)).cast("int")
    offset_of = lambda code: ((code % F.lit(2**40)) - F.lit(2**30)).cast("int")
    keys = F.array(*[F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("at")) for p, i in places]) for places in index.places])
    verified = lambda code: F.forall(F.get(keys, template_of(code)), lambda k: F.array_contains(F.get(F.col("keys"), k["phrase"]), offset_of(code) + k["at"]))
    near = F.filter(runs(codes(F.col("hits"))), lambda a: (a["n"] >= F.get(least, template_of(a["code"]))) & verified(a["code"]))
    df = df.withColumn("near", F.when(F.size("hits") > 0, near))
    spelled = F.array(*[F.array(*[F.lit(number[w]) for w in ws]) for ws in index.words])
    weights = F.array(*[F.lit(idf[w]) for w in index.vocabulary])
    whole = F.array(*[F.lit(sum(idf[w] for w in ws)) for ws in index.words])

    def weighed(code: Column) -> Column:
        """The template, and the share of its IDF that stands in place."""
        placed = F.transform(F.get(spelled, template_of(code)), lambda w, p: F.when(F.try_element_at(F.col("at"), offset_of(code) + p) == w, F.get(weights, w)).otherwise(F.lit(0.0)))
        return F.struct(template_of(code).alias("t"), (F.aggregate(placed, F.lit(0.0), lambda a, x: a + x) / F.get(whole, template_of(code))).alias("share"))

    df = df.withColumn("at", F.when(F.size("near") > 0, F.map_from_entries("hits")))
    good = F.filter(F.transform("near", lambda a: weighed(a["code"])), lambda g: g["share"] >= share)
    names = F.array(*[F.lit(t.label) for t in templates])
    df = df.withColumn("good", F.coalesce(F.when(F.size("near") > 0, good), F.array().cast("array<struct<t:int,share:double>>")))
    base_at = F.flatten("base")
    base_names = F.filter(F.array(*[F.when(F.size(F.get(F.col("base"), F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases)]), lambda x: x.isNotNull())
    base_labels = F.coalesce(F.array_sort(F.array_distinct(base_names)), F.array().cast("array<string>"))
    own = F.transform("good", lambda g: F.get(names, g["t"]))
    score = F.round(F.least(F.coalesce(F.array_max(F.transform("good", lambda g: g["share"])), F.lit(0.0)), F.lit(1.0)), 6)
    return df.select(
        "doc_id", "n_words",
        F.coalesce(F.size(base_at), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(base_at).cast("long").alias("first_word"),
        F.array_max(base_at).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        score.cast("double").alias("score"),
    )
