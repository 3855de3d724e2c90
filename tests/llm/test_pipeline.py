import random
import re

import numpy as np
from test_near_dups import brute as near_groups
from test_quality import brute as measures
from test_secrets import brute as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline
from attestra.llm import quality, tokens


def corpus():
    rng = random.Random(12)
    vocab = ["the", "of", "and", "committee", "report", "table", "plan", "reads", "members", "with", "old", "new"] + [f"word{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for i in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 90, 200]))]
        rows.append(" ".join(ws))
        if i % 4 == 0:
            rows += [" ".join(ws), " ".join(ws[:-1] + ["zzz"])]
        if i % 5 == 0:
            rows.append(" ".join(ws) + f' password = "hunter{i}abc" ' + " ".join(rng.choice(vocab) for _ in range(60)))
        if i % 7 == 0:
            rows.append("!! ".join(ws) + " ### $$$ " * 40)
    rows += [None, "", rows[0]]
    order = rng.sample(range(1000), len(rows))
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(order, rows, strict=True)]


def expected(rows):
    def keep(t):
        n, chars, symbols, dup, repeated = measures(t)
        lines = [x for x in (t or "").split("\n") if x.strip()]
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        stops = sum(w.lower().rstrip(".,;:!?") in quality.STOP_WORDS for w in ws)
        return n >= 20 and 100 * repeated <= 30 * n and 2 <= chars / n <= 15 and symbols / n <= 0.3 and t.count("!") / n <= 0.4 and dup / max(len(lines), 1) <= 0.5 and stops / n >= 0.01

    good = [(r[0], r[1]) for r in rows if keep(r[1])]
    groups = near_groups(good)
    left = [(i, t) for (i, t), (_, _, c) in zip(good, groups, strict=True) if i == c]

    def redact(t):
        spans = [tuple(map(int, s.split(":")[1:])) for s in secret_spans(t)[1].split(",") if s]
        out, at = "", 0
        for s, e in sorted(spans):
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, e)
        return out + t[at:]

    return {i: redact(t) for i, t in left}


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = expected(rows)
    assert 10 < len(want) < len(rows) - 20
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in want.items()}
    assert {r.doc_id for r in got} == set(want)
    import zlib

    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]), want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_stages_keep_the_columns_and_survive_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, schema)
    for docs in (empty, nulls):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
