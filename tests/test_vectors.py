"""Vectors of texts (TXT-08) against an exact decomposition of the whole matrix."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from socspan.operators import vectors as tv


def _matrix(notes, buckets):
    rows = [tv._counted(n.lower(), buckets) for n in notes]
    df = np.zeros(buckets)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(notes)) / (1 + df)) + 1
    x = np.zeros((len(notes), buckets))
    for i, (at, w) in enumerate(rows):
        x[i, at] = w * idf[at]
        for part in (slice(0, buckets // 2), slice(buckets // 2, buckets)):
            x[i, part] /= np.linalg.norm(x[i, part]) or 1
    return x


def _cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


@pytest.fixture(scope="module")
def notes():
    r = random.Random(5)
    themes = [[f"{t}term{i}" for i in range(12)] for t in ("mail", "disk", "login", "proxy")]
    return [" ".join(r.choices(themes[i % 4], k=25) + r.choices([f"common{j}" for j in range(30)], k=6)) for i in range(80)]


def test_vectors_equal_those_of_an_exact_decomposition(spark, notes):
    df = spark.createDataFrame(list(enumerate(notes)), "n long, notes string").repartition(4)
    out = {x.n: x.vector for x in tv.text_vectors(df, "n", dims=6, buckets=512).collect()}
    got = np.array([out[i] for i in range(len(notes))])
    u, s, _ = np.linalg.svd(_matrix(notes, 512), full_matrices=False)
    want = u[:, :6] * s[:6]
    assert np.allclose(np.linalg.norm(got, axis=0)[:4], s[:4], rtol=1e-3)
    assert np.abs(_cosines(got[:, :4]) - _cosines(want[:, :4])).max() < 1e-3
    nearest = np.argsort(-_cosines(got), axis=1)[:, 1]
    assert all(j % 4 == i % 4 for i, j in enumerate(nearest))


def test_few_notes_end_in_zeros(spark):
    rows = [(1, "disk is full"), (2, "login failed twice"), (3, None), (4, "  "), (5, "disk is full")]
    out = {x.n: np.array(x.vector) for x in tv.text_vectors(spark.createDataFrame(rows, "n long, notes string"), "n").collect()}
    assert all(len(v) == tv.DIMS and not v[4:].any() and v.any() for v in out.values())
    assert np.allclose(out[1], out[5]) and np.allclose(out[3], out[4])  # blank notes are alike
    x = _matrix(["disk is full", "login failed twice", "empty note placeholder", "empty note placeholder", "disk is full"], tv.BUCKETS)
    assert np.allclose([[out[a] @ out[b] for b in out] for a in out], [[x[a - 1] @ x[b - 1] for b in out] for a in out], atol=1e-9)


def test_one_note_and_none(spark):
    one = spark.createDataFrame([(7, "Only this")], "n long, notes string")
    digest = hashlib.sha256(b"Only this").digest()
    assert np.allclose(tv.text_vectors(one, "n").first().vector, [digest[i % 32] / 255 for i in range(tv.DIMS)])
    assert tv.text_vectors(one.limit(0), "n").count() == 0


def test_notes_are_multiplied_by_blocks(notes):
    some = [*notes[:5], "a", *notes[5:9]]  # "a" has no grams
    rows = [tv._counted(n, 512) for n in some]
    pdf = pd.DataFrame({"at": [at.tobytes() for at, _ in rows], "w": [w.tobytes() for _, w in rows]})
    df = np.bincount(np.concatenate([at for at, _ in rows]), minlength=512)
    blocks = list(tv._blocks(iter([pdf, pdf[:0]]), 512, np.log((1 + len(some)) / (1 + df)) + 1))
    assert len(blocks) == 1 and not blocks[0][5].any() and np.allclose(blocks[0], _matrix(some, 512))
    assert sum(len(b) for b in tv._blocks(iter([pd.concat([pdf] * 60)]), 512, np.ones(512))) == 600
