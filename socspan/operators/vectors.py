"""Dense vectors of texts by a randomised truncated SVD of their TF-IDF matrix (TXT-08)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written
from .text import _char_grams, _filled, _word_grams

DIMS = 128
BUCKETS = 4096  # of hashed grams: half of them for words, half for characters
NOTES_AT_ONCE = 512  # notes whose matrix a task holds
OVER, PASSES, SEED = 16, 3, 42  # columns beyond DIMS in the sketch, and multiplications by the matrix and its transpose


def _counted(note: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a note's grams in ascending order, and 1 + ln of their counts."""
    half, at, w = buckets // 2, [], []
    for kind, grams in enumerate((_word_grams, _char_grams)):
        n = np.bincount(((grams(note) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(half)).astype(np.int64), minlength=half)
        b = np.flatnonzero(n)
        at.append(b.astype(np.int32) + np.int32(kind * half))
        w.append(1 + np.log(n[b]))
    return np.concatenate(at), np.concatenate(w)


def _blocks(pdfs: Iterator[pd.DataFrame], buckets: int, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Notes by blocks of NOTES_AT_ONCE, each a matrix: weights by idf, those of words and those of characters of a note each scaled to length 1."""
    for pdf in pdfs:
        for lo in range(0, len(pdf), NOTES_AT_ONCE):
            part = pdf[lo : lo + NOTES_AT_ONCE]
            at, w = np.frombuffer(b"".join(part["at"]), np.int32), np.frombuffer(b"".join(part["w"]))
            row = np.repeat(np.arange(len(part)), part["at"].map(len) // at.itemsize)
            vector = row * 2 + (at >= buckets // 2)  # a note has two, of words and of characters
            x = w * idf[at]
            norm = np.sqrt(np.bincount(vector, x * x, minlength=2 * len(part)))
            block = np.zeros((len(part), buckets))
            block[row, at] = x / norm[vector]
            yield block


def _idf(sparse: DataFrame, n: int, buckets: int) -> np.ndarray:
    """ln((1 + n) / (1 + notes that have it)) + 1 of each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(buckets, np.int64)
        for pdf in batches:
            held += np.bincount(np.frombuffer(b"".join(pdf["at"]), np.int32), minlength=buckets)
        hit = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": hit, "n": held[hit]})

    df = np.zeros(buckets)
    for bucket, c in sparse.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        df[bucket] = c
    return np.log((1 + n) / (1 + df)) + 1


def _times(sparse: DataFrame, idf: np.ndarray, v: np.ndarray) -> np.ndarray:
    """X'Xv, where X has a row for each note: tasks multiply blocks of notes, and send a row for each bucket that they met, whatever the number of their notes."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    sent = sparse.sparkSession.sparkContext.broadcast((idf, v))  # BUCKETS * (DIMS + OVER) doubles

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, v = sent.value
        z = np.zeros_like(v)
        for x in _blocks(batches, len(v), idf):
            z += x.T @ (x @ v)
        if len(hit := np.flatnonzero(z.any(axis=1))):
            yield pd.DataFrame({"bucket": hit, "part": list(z[hit])})

    sums = sparse.mapInPandas(add, "bucket int, part array<double>").groupBy("bucket").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
    out = np.zeros_like(v)
    for bucket, s in sums.collect():  # a row for each bucket
        out[bucket] = s.toArray()
    return out


def text_basis(sparse: DataFrame, n: int, dims: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """idf and the first dims right singular vectors of the notes' matrix; zeros beyond its rank or beyond n - 1."""
    idf = _idf(sparse, n, buckets)
    v = np.linalg.qr(np.random.default_rng(SEED).standard_normal((buckets, min(dims + OVER, buckets))))[0]
    for _ in range(PASSES):
        v = np.linalg.qr(_times(sparse, idf, v))[0]
    small = v.T @ _times(sparse, idf, v)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis, values = (v @ turn)[:, ::-1], values[::-1]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    basis[:, values <= 1e-9 * values[0]] = 0
    basis[:, max(1, n - 1) :] = 0
    out = np.zeros((buckets, dims))
    out[:, : min(dims, basis.shape[1])] = basis[:, :dims]
    return idf, out


def text_vectors(notes: DataFrame, id_col: str, dims: int = DIMS, buckets: int = BUCKETS) -> DataFrame:
    """TXT-08: (id, vector): TF-IDF of words, pairs of words and runs of characters, projected on the matrix's first dims singular vectors.

    Fitted over the whole corpus by subspace iteration from a random start
    (PASSES times, then Rayleigh-Ritz), so vectors of any two rows compare.
    Grams are hashed to buckets, so what tasks and the driver hold doesn't grow
    with the notes. Blank notes count as the stand-in text. Vectors of fewer
    dimensions than dims, as those of n - 1 notes or less, end in zeros; that
    of a single note is made of the bytes of its SHA-256. No notes, no rows.
    """
    filled = notes.select(id_col, F.lower(_filled()).alias("note"))
    schema = T.StructType([filled.schema[id_col], T.StructField("at", T.BinaryType()), T.StructField("w", T.BinaryType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_counted(note, buckets) for note in pdf["note"]]
            yield pd.DataFrame({id_col: pdf[id_col], "at": [at.tobytes() for at, _ in rows], "w": [w.tobytes() for _, w in rows]})

    sparse = written(filled.mapInPandas(count, schema), "text-grams")
    n = sparse.count()
    if n < 2:
        byte = lambda i: F.conv(F.substring(F.sha2(_filled(), 256), i % 32 * 2 + 1, 2), 16, 10).cast("double") / 255
        return notes.select(id_col, F.array(*(byte(i) for i in range(dims))).alias("vector"))
    sent = notes.sparkSession.sparkContext.broadcast(text_basis(sparse, n, dims, buckets))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = sent.value
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "vector": [v for x in _blocks(iter([pdf]), buckets, idf) for v in x @ basis]})

    return sparse.mapInPandas(project, T.StructType([schema[id_col], T.StructField("vector", T.ArrayType(T.DoubleType()))]))
