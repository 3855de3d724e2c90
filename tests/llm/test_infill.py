"""Fill-in-middle examples against a plain reading of the rules."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(seed, n):
    r = random.Random(seed)
    alphabet = " \t\n\r\x0b\x0c\x1c\x85\xa0ab<PSM>.é 　\U0001f600"
    return ["".join(r.choices(alphabet, k=r.choice([0, 1, 2, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 14])
def test_cuts_by_chunks(chunk):
    texts = made(chunk, 120) + ["a", " ", "a ", " a", "aa bb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    chunks = infill.Chunks(data, offsets, chunk, slab=50)
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        assert chunks.tokens[i] == len(tokens)
        for rank in range(len(tokens) + 1):
            assert chunks.cut(i, rank) == len("".join(tokens[:rank]).encode())


def test_equals_brute_force_and_restores(spark):
    rows = [(i, t) for i, t in enumerate(made(5, 400))]
    rows += [(None, "a b c d"), (None, "a b c d"), (None, None), (7, None), (8, ""), (9, "x <P y <S z <M w"), (1001, "word " * 60_000), (1004, "é" * 90_000 + " end"), (1005, "\n" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, `n.form` int").repartition(3)
    out = infill.fill_in_middle(df, chunk=64)
    got = out.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute(*r) for r in rows), key=key)
    wanted = sorted((t or "", i is None, i or 0) for i, t in rows)
    assert sorted((r.restored, r.doc_id is None, r.doc_id or 0) for r in got) == wanted
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.where("false")).count() == 0


def test_marks_next_to_parts(spark):
    texts = [f"{a} {b}" for a in ("<", "<P", "P>", ">", "<S", "S>", "<<", ">>M") for b in ("<", "<M", "M>", ">", "S>", "P>")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = infill.fill_in_middle(df, percent=100)
    got = out.select("doc_id", "form", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {r[0]: r[2] for r in got} == dict(enumerate(texts)) and all(r[1] != "plain" for r in got)


def test_sliced_columns():
    column = pa.array(["zz z", "a b", "", "c  d e"]).slice(1)
    data, offsets = infill.text_bytes(column)
    assert infill.Chunks(data, offsets, 2).tokens.tolist() == [2, 0, 3]
