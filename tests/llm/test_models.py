"""Language ID and the quality classifier: held-out accuracy, recovered labels, edge cases."""

import random

import numpy as np
import pytest

from socspan.llm import language_id as lid
from socspan.llm import quality_model as qm

SYLLABLES = {"en": ["the", "ing", "ou", "sh", "er", "th"], "de": ["sch", "ein", "ung", "ü", "keit", "pf"], "fr": ["eau", "è", "oi", "que", "ê", "tre"]}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.mark.parametrize("n", [1, 2, 4, 7, 9, 40])
def test_codewords_differ(n):
    code = lid.codewords(n)
    assert len(np.unique(code, axis=0)) == n and set(np.unique(code)) <= {1.0, -1.0}


def test_language_held_out(spark, tmp_path):
    rows = [(i, prose(lang, 12 + i % 60, i), lang) for i in range(600) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(9000, None, "en"), (9001, "", "en"), (9002, "12 ... 34", "de"), (9003, prose("de", 50_000, 1), None), (None, prose("fr", 30, 1), "fr")]
    spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = lid.op10_language_id(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(got) == len(rows) and 60 < len(held) < 200
    assert np.mean([r.lang_pred == list(SYLLABLES)[r.doc_id % 3] for r in held]) > 0.98
    assert [(by[i].lang_pred, by[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert by[9003].lang_pred == "de" and by[None].lang_pred == "fr" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_language_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    m = lid.fit(df)
    assert m.langs == [] and m.predict("abc") == ("und", 0.0, False)
    assert lid.fit(spark.createDataFrame([("abc", "xx")], "text string, lang string")).predict("zzz")[0] == "xx"


def test_em_recovers_labellers():
    r = np.random.default_rng(1)
    n = 20_000
    truth = r.random(n) < 0.8
    votes = np.full((n, qm.LABELLERS), qm.NONE)
    for k in range(qm.LABELLERS):
        says = r.random(n) < 0.7
        right = r.random(n) < (0.95 - 0.04 * k)
        votes[says, k] = np.where(right, truth, ~truth)[says]
    pattern = votes @ 3 ** np.arange(qm.LABELLERS)[::-1]
    ids, times = np.unique(pattern, return_counts=True)
    p = qm.posteriors(dict(zip(ids.tolist(), times.tolist(), strict=True)))
    assert ((p[pattern] > 0.5) == truth).mean() > 0.95
    assert qm.posteriors({}).shape == (qm.PATTERNS,)


def test_quality_scores(spark):
    good = [(i, prose("en", 80 + i % 40, i), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose("en", 60, i).split()), 0) for i in range(20)]
    bad += [(1100 + i, prose("de", 60, i).upper().replace(" ", "!! "), 0) for i in range(20)] + [(1200 + i, "again " * 90, 0) for i in range(20)]
    df = spark.createDataFrame([(*x, "c") for x in good + bad], "doc_id long, text string, quality int, score string")
    m = qm.fit(df)
    out = qm.score(df, m).collect()
    right = [(r._quality.score >= qm.KEEP) == bool(r.quality) for r in out]
    assert np.mean(right) > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("x",), ("w " * 100_000,)], "text string")
    assert all(0 <= r._quality.score <= 1 for r in qm.score(odd, m).collect())
    assert qm.score(odd.limit(0), qm.fit(odd.limit(0))).count() == 0
