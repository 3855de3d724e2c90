"""BPE encoding and decoding of documents as Spark stages: Arrow batches in, Arrow batches out, one vocabulary per worker.

Defined cases: a null text counts as empty and has no ids; a null id stays null; repeated rows give a row each and no rows are
compared, so there are no ties; empty tables give empty results; other columns, whatever their names, are not read. A very long
text is encoded whole, and so is one unbroken piece of it, in time of n log n. The vocabulary's special strings inside a text become
their ids, as the public library does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from . import bpe
from .common import texts


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        for batch in batches:
            at = 0
            for run in bpe.small_batches(batch.column(1).to_pylist()):
                ids = [np.frombuffer(b, "<i4") for b in tok.encode_batch(run)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.array([], "<i4")])))
                yield pa.record_batch([batch.column(0).slice(at, len(run)), values], names=["doc_id", "ids"])
                at += len(run)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: special tokens are kept; null ids give an empty text."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        for batch in batches:
            out = [tok.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so that neither ids nor texts leave the worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        decimal = {i: str(i) for i in tok.names}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for run in bpe.small_batches(batch.column(1).to_pylist()):
                for blob in tok.encode_batch(run):
                    ids = np.frombuffer(blob, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                    text_sha.append(sha(b"".join(map(tok.names.__getitem__, ids)).decode("utf-8", "replace").encode()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
