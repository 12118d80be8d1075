import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from socspan.llm import suffix_dedup as sd


def brute(rows):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for q in range(len(data) - sd.LENGTH + 1):
            s = data[q : q + sd.LENGTH]
            if s in seen:
                gone[q : q + sd.LENGTH] = b"\x01" * sd.LENGTH
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 2)
            parts += [p[cut : cut + r.choice([99, 100, 101, 130, 999])], word()]
        rows.append((d, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (None, passages[0]), (102, None), (103, ""), (104, "x" * 99), (105, "y" * 100), (106, "y" * 101), (107, "ab " * 400), (108, "z" + "ab " * 300), (2**60, passages[1] * 3)]
    return rows


def run(spark, df):
    from pyspark.sql import functions as F

    return sorted(map(tuple, sd.dedup_bytes(df).withColumn("kept", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, d1 int, bytes string").repartition(5)
    assert run(spark, df) == sorted(brute(rows), key=str)


def test_empty_repeated_and_long(spark):
    df = spark.createDataFrame([(1, "same text " * 5000), (1, "same text " * 5000), (2, "other " + "same text " * 30)], "doc_id long, text string")
    one, two, other = run(spark, df)
    assert one == two and one[2] == 50_000 - 10 and other[2] == 301 and sd.dedup_bytes(df.limit(0)).count() == 0


def test_pieces_and_tries(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[3000:3300] = data[100:400]
    grams = [data[i : i + sd.GRAM].tobytes() for i in range(len(data) - sd.GRAM + 1)]
    whole = sd.anchors(data)
    chosen = {}
    for q in range(len(whole)):
        window = data[q : q + sd.LENGTH].tobytes()
        assert q <= whole[q] < q + sd.WINDOW and grams[whole[q]] not in grams[q : whole[q]]
        assert chosen.setdefault(window, whole[q] - q) == whole[q] - q
    starts = np.arange(len(data) - sd.LENGTH + 1)
    first, seen = sd.repeats(np.append(data, np.zeros(8, np.uint8)), starts), {}
    assert first.tolist() == [seen.setdefault(data[s : s + sd.LENGTH].tobytes(), s) for s in starts.tolist()]


def test_pieces_of_long_texts():
    """Anchors of texts that are hashed together, or in pieces, are those of each text alone."""
    r = random.Random(5)
    texts = ["".join(r.choices("abc ", k=k)).encode() for k in (50, 100, 101, 3000, 2 * sd.PIECE + 500, 99, 700)]
    s = sd._Sender(4)
    for i, t in enumerate(texts):
        s.add(i, t)
    s._hash()
    got = {(int(d), int(q) + k): int(q) + int(o) for p in s.parts for d, (q, n, o) in zip(p[3], p[4], strict=True) for k in range(n)}
    want = {(i, q): int(a) for i, t in enumerate(texts) if len(t) >= sd.LENGTH for q, a in enumerate(sd.anchors(np.frombuffer(t, np.uint8)))}
    assert got == want


def test_memory_bound_changes_nothing(monkeypatch):
    docs = pd.DataFrame([(d if d is not None else -1, i, x or "") for i, (d, x) in enumerate(corpus(3))], columns=["d1", "d2", "text"])
    places = pd.concat(sd._meet(iter([x for x in sd._send(3)(iter([docs])) if len(x)]))).groupby(["d1", "d2"])["blob"].apply(list).rename("blobs").reset_index()
    rows = pd.concat(sd._stretches(iter([docs.merge(places, on=["d1", "d2"])])), ignore_index=True)
    whole = pd.concat(sd._sorted_out(iter([rows])), ignore_index=True)
    monkeypatch.setattr(sd, "SUFFIXES", 40)
    assert len(whole) > 20 and pd.concat(sd._sorted_out(iter([rows])), ignore_index=True).equals(whole)


def test_oracles_are_sql():
    from socspan.llm.queries import ORACLES

    assert all(isinstance(x, str) and "select" in x for x in ORACLES.values())
