"""Line dedup and mixing, against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

from socspan.llm import line_dedup as ld
import pytest

from socspan.llm import mixing as mx


def brute_lines(rows):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if re.search(r"[^ \t-\r]", x)]
        gone = set()
        for k in range(len(worded)):
            for n in range(1, ld.RUN + 1):
                run = tuple(lines[i] for i in worded[k : k + n])
                if len(run) == n and (n == ld.RUN or sum(len(re.findall(r"[^ \t-\r]+", x)) for x in run) > ld.LONG):
                    gone |= set(range(k, k + n)) if run in seen else set()
                    seen.add(run)
        runs = sum(k - 1 not in gone for k in gone)
        lost = {worded[k] for k in gone}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
        out[d] = (len(lines), len(gone), runs, hashlib.md5(kept.encode()).hexdigest())
    return out


def test_line_dedup(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "", " ", "long line é"]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same\n" * 5000), (None, "p\nq\nr\ns"), (103, "x\np\nq\nr\ns\nt\n\np\nq\nr"), (2**60, "q\nr\ns")]
    long = ["w " * n + str(n) for n in (24, 26, 49, 50, 51)]
    rows += [(200 + i, "\n".join(r.choice([*long, *long, "a", "", f"own {r.random()}"]) for _ in range(r.randint(0, 5)))) for i in range(60)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, start string, n_lines int")
    out = ld.dedup_lines(df)
    got = {x.doc_id: (x._dedup.n_lines, x._dedup.n_removed, x._dedup.n_runs, hashlib.md5(x._dedup.text.encode()).hexdigest()) for x in out.collect()}
    assert got == brute_lines(rows)
    assert out.columns == [*df.columns, "_dedup"]
    assert ld.dedup_lines(df.limit(0)).count() == 0
    twice = ld.dedup_lines(df.filter("doc_id = 103").union(df.filter("doc_id = 103"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def brute_cells(rows):
    cells = defaultdict(int)
    cell = {}
    for d, text, lang, source in rows:
        words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
        longest = max(words, key=lambda w: (len(w), w), default="")
        cell[d] = ((source or "", lang or "", str(int(hashlib.md5(longest.encode()).hexdigest()[:4], 16) % mx.TOPICS)), len(words))
        cells[cell[d][0]] += len(words)
    return {k: v for k, v in cells.items() if v}, cell


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 9) + str(r.randint(0, 99)) for _ in range(r.randint(5, 80))), r.choice(["en", "de", None]), f"s{min(r.randint(0, 6), 3)}") for i in range(3000)]
    rows += [(5000, None, "en", "s0"), (5001, "", None, None), (None, "word " * 50_000, "en", "s1")]
    df = spark.createDataFrame([(*x, 1.0, "t") for x in rows], "doc_id long, text string, lang string, source string, p double, topic string")
    cells, cell = brute_cells(rows)
    margins = [defaultdict(float) for _ in range(3)]
    for k, v in cells.items():
        for m in range(3):
            margins[m][k[m]] += v
    goals = []
    for m, power in zip(margins, mx.POWERS.values(), strict=True):
        p = {k: v**power for k, v in m.items()}
        goals.append({k: v / sum(p.values()) for k, v in p.items()})
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(1000):
        off = 0
        for m in range(3):
            s = defaultdict(float)
            for k, v in w.items():
                s[k[m]] += v
            f = {k: goals[m][k] / v for k, v in s.items()}
            off = max(off, *(abs(x - 1) for x in f.values()))
            w = {k: v * f[k[m]] for k, v in w.items()}
        if off < mx.TOLERANCE:
            break
    lo, hi = 0.0, 1e9
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(v * min(1, c * w[k] / v) for k, v in cells.items()) < mx.KEEP * total else (lo, c)
    p = {k: min(1, c * w[k] / v) for k, v in cells.items()}
    out = mx.mix(df)
    assert out.columns == [*df.columns, "_mix"]
    got = {x.doc_id: x._mix for x in out.collect()}
    for d, m in got.items():
        assert (m.source, m.lang, m.topic) == cell[d][0] and m.tokens == cell[d][1] and math.isclose(m.p, p[cell[d][0]], rel_tol=1e-4)

    def drawn(d):
        return int(hashlib.md5(f"{'' if d is None else d}:{mx.SEED}".encode()).hexdigest()[:8], 16) / 2**32

    want = {d for d, _, _, _ in rows if cell[d][1] and drawn(d) < p[cell[d][0]]}
    assert len(want ^ set(got)) <= 2  # a chance at the very limit
    assert mx.mix(df.limit(0)).count() == 0 and mx.mix(df.filter("doc_id >= 5000")).count() == 0


def test_given_targets_and_topic_column(spark):
    """Drawn tokens follow the given weights; values without one aren't drawn."""
    r = random.Random(4)
    rows = [(i, "word " * 20, r.choice(["en", "de"]), r.choice(["web", "books", "code"]), r.choice(["x", "y", None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    goals = [("source", "web", 1.0), ("source", "books", 3.0), ("lang", "en", 0.5), ("lang", "de", 0.5), ("topic", "x", 0.7), ("topic", mx.OTHER, 0.3), ("topic", "nowhere", 5.0)]
    out = mx.mix(df, keep=0.3, goals=spark.createDataFrame(goals, "margin string, value string, target double"), topic="subject")
    got = [x.asDict() | x._mix.asDict() for x in out.collect()]
    share = lambda k, v: sum(x[k] == v for x in got) / len(got)
    assert abs(len(got) - 1800 * 2 / 3 * 2 / 3) < 80
    for k, v, want in (("source", "books", 0.75), ("source", "code", 0), ("lang", "de", 0.5), ("topic", "x", 0.7), ("topic", "y", 0)):
        assert abs(share(k, v) - want) < 0.05


def test_margins_that_contradict_each_other(spark):
    """A source that alone has a language, but another target: raking ends with a warning, and its weights add up to 1."""
    cells = spark.createDataFrame([("a", "x", "0", 60), ("b", "y", "0", 40), ("c", "y", "0", 0)], "source string, lang string, topic string, tokens long")
    goals = [("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.2), ("lang", "y", 0.8), ("topic", "0", 1.0)]
    with pytest.warns(UserWarning, match="no longer help"):
        got = mx.rake(cells, spark.createDataFrame(goals, "margin string, value string, target double")).collect()
    assert {x.source for x in got} == {"a", "b"} and math.isclose(sum(x.w for x in got), 1, rel_tol=1e-9)
