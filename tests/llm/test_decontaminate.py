import random
import re

import numpy as np
import pytest

from socspan.llm import decontaminate as dc


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_tiles(a, b):
    """Greedy string tiling by comparing every pair of places."""
    least = min(dc.LEAST_MATCH, len(a))
    used_a, used_b, out = set(), set(), []
    while least:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < least:
            break
        for i, j in found:
            if not (set(range(i, i + best)) & used_a or set(range(j, j + best)) & used_b):
                out.append((i, j, best))
                used_a |= set(range(i, i + best))
                used_b |= set(range(j, j + best))
    return out


def brute(docs, bench):
    out = set()
    for d, text in docs:
        for i, item in bench:
            a = words(item)
            tiles = brute_tiles(a, words(text)) if a else []
            if a and sum(t[2] for t in tiles) >= dc.COVERAGE * len(a):
                out.add((d, i, len(a), sum(t[2] for t in tiles), len(tiles)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_tiles_equal_brute_force(seed):
    r = random.Random(seed)
    a = [r.choice("abcd" if seed % 2 else "ab") for _ in range(r.randint(1, 25))]
    b = [r.choice("abcd" if seed % 2 else "ab") for _ in range(r.randint(0, 40))] + (a[6:] + a[:6] if seed % 3 else [])
    assert dc.tile(dc.tokens(" ".join(a)), dc.tokens(" ".join(b))) == brute_tiles(a, b)


@pytest.mark.parametrize("sent", [dc.TOKENS_SENT, -1])
def test_leaks(spark, sent):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(40)]
    bench = [(i, " ".join(r.choices(vocab, k=r.randint(3, 20)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, "...")]
    docs = []
    for d in range(40):
        item = bench[d % 12][1].split()
        cut = len(item) // 2
        body = r.choices(vocab, k=20)
        docs.append((d, " ".join([*body[:9], *((item, item[cut:] + body[:2] + item[:cut], item[:cut], [])[d % 4]), *body[9:]])))
    docs += [(100, None), (101, ""), (102, "One, TWO"), (103, (bench[0][1] + " ") * 300), (None, bench[1][1]), (100, None)]
    df = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, item_id int, tiles string")
    bf = spark.createDataFrame([(*x, 1) for x in [*bench, (None, "w1 w2 w3 w4"), bench[2]]], "item_id long, text string, key int")
    out = dc.find_leaks(df, bf, sent)
    assert out.columns == [*df.columns, "_leaks"]
    rows = out.collect()
    assert len(rows) == len(docs)
    assert {(x.doc_id, *y) for x in rows for y in x._leaks} == brute(docs, bench)
    assert dc.find_leaks(df.limit(0), bf, sent).count() == 0
    assert all(not x._leaks for x in dc.find_leaks(df, bf.limit(0), sent).collect())


def test_running_hash():
    t = dc.tokens("a b c a b c")
    w = dc.windows(t, 3)
    assert w[0] == w[3] and len(np.unique(w)) == 3 and len(dc.windows(t, 7)) == 0
