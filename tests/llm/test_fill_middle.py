"""Fill-in-middle against a brute-force version over code points, the byte index both ways, odd texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from socspan.llm import fill_middle as fm

ALPHABET = ["a", "\n", "é", "中", "😀", " ", "\r", "\x00", "<"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    c1, c2 = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:c1]), "".join(units[c1:c2]), "".join(units[c2:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(3)
    out = [None, "", "\n", "\n\n", "x", "é", "a\n", "\na", "<P>", "a<S>b\nc", "x<M>", "<<\nS>P>\n<", "é\n" * 40_000, "long " * 100_000]
    out += ["".join(r.choices(ALPHABET, k=r.randint(0, 60))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(out)] + [(None, "a\nb\nc"), (5, "é"), (5, "again\nand\nagain"), (-3, "中\n中"), (2**62, "q\nr")]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_against_brute_force(spark, unit):
    rows = texts()
    df = spark.createDataFrame([(*r, "c", 2.0) for r in rows], "doc_id long, text string, form string, n double").repartition(3)
    out = fm.fill_middle(df, unit=unit)
    assert out.columns == [*df.columns, "_fim"]
    got = out.withColumn("back", fm.restore(out["_fim.output"], out["_fim.form"])).select("text", "_fim", "doc_id", "back").collect()
    assert all(r.back == (r.text or "") for r in got)
    have = sorted(((r.doc_id, *r._fim) for r in got), key=str)
    assert have == sorted((brute(*r, unit) for r in rows), key=str)


def test_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in fm.op13_fill_middle(spark, str(tmp_path)).collect()), key=str)
    want = sorted(((*b[:5], sha(b[5]), sha(t or "")) for (i, t) in rows for b in [brute(i, t)]), key=str)
    assert got == want


def test_parameters_and_empty(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    assert {r._fim.form for r in fm.fill_middle(df, rate=0).collect()} == {"plain"}
    assert "psm" not in {r._fim.form for r in fm.fill_middle(df, spm=100).collect()}
    assert fm.fill_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="_FIM"):
        fm.fill_middle(df.withColumnRenamed("text", "_FIM"))
    with pytest.raises(ValueError, match="unit"):
        fm.fill_middle(df, unit="word")


def test_index():
    text = "".join(random.Random(9).choices(ALPHABET, k=3000))
    octets = np.frombuffer(text.encode(), np.uint8)
    index = fm.Index(octets)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.chars(at) == np.arange(len(text) + 1)).all() and (index.octets(np.arange(len(text) + 1)) == at).all()
    assert len(index.at) == sum(ord(c) > 127 for c in text)
