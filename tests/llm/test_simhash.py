import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from socspan.llm import common
from socspan.llm import simhash as sh


def brute_fp(text, k=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    """items: (id, value); the least id reachable, None last."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if find(i) != find(j) and linked(items[i][1], items[j][1]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(items):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(items))]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = r.choices(vocab, k=r.choice([4, 40, 150, 250]))
        for _ in range(r.randint(1, 7)):
            t = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize("hot", [256, 1])
def test_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(sh, "HOT", hot)
    rows = list(enumerate(corpus(1)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "oNE"), (505, "É one"), (505, "É one"), (None, rows[5][1]), (None, "alone here"), (506, "big " * 40_000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, fp int, first int")
    got = sorted(map(tuple, sh.simhash_groups(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_components([(d, f) for (d, _), f in zip(rows, fps, strict=True)], lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == sorted(((d, signed(f), c) for (d, _), f, c in zip(rows, fps, roots, strict=True)), key=str)
    assert sh.simhash_groups(df.limit(0)).count() == 0


def test_links_are_complete(spark, monkeypatch):
    """Random near fingerprints with a half in common, by pairs and by meeting in the middle."""
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(30):
            g = f
            for b in r.sample(range(64), r.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(map(signed, fps))
    want = brute_components([(f, f) for f in fps], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (10_000, 3):
        monkeypatch.setattr(sh, "HOT", hot)
        roots = dict(map(tuple, sh.components(sh.links_within_3(nodes)).collect()))
        assert [roots.get(f, f) for f in fps] == want


def test_components_of_long_chain(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.range(1000, 1400).selectExpr("1000 as a", "id as b"))
    got = dict(map(tuple, sh.components(links).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert sh.components(links.limit(0)).count() == 0


def jaccard(a, b):
    def s(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {" ".join(w[i : i + sh.WORDS]) for i in range(max(1, len(w) - sh.WORDS + 1))} if w else set()

    a, b = s(a), s(b)
    return not (a | b) or sh.UNDER * len(a & b) >= sh.TOP * len(a | b)


def test_near_duplicates(spark):
    rows = list(enumerate(corpus(7)))
    random.Random(1).shuffle(rows)
    rows += [(600, rows[0][1]), (600, rows[0][1]), (601, None), (602, ""), (603, " \n "), (None, rows[3][1]), (None, "only null id here"), (604, "x " * 30_000)]
    df = spark.createDataFrame([(*x, "en", 1) for x in rows], "doc_id long, text string, id string, key int")
    out = sh.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(got, key=str) == sorted(set(brute_components(rows, jaccard)), key=str)
    assert sh.drop_near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sh.drop_near_duplicates(df.withColumn("_copy", F.lit(1)))


def test_every_link_is_found(spark, monkeypatch):
    """Groups of two at similarities around 0.8, and a large group of near copies of one text, by brute force; common shingles order prefixes."""
    monkeypatch.setattr(sh, "COMMON_LEAST", 2)
    r = random.Random(11)
    rows = []
    for _ in range(150):
        n = r.choice([6, 30, 120, 400])
        a = [f"w{r.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(1, max(1, n // 35))):
            b[r.randrange(n)] = "new"
        rows += [" ".join(a), " ".join(b[: n - r.randrange(n // 6)])]
    base = [f"v{r.randrange(10**6)}" for _ in range(150)]
    for _ in range(150):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(t))
    rows = list(enumerate(rows))
    got = sorted(x.doc_id for x in sh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(set(brute_components(rows, jaccard)))


def test_what_is_sent_and_left(spark, monkeypatch):
    """Texts in no pair are dropped before they are exchanged; of what is written only the table of rows that stay is left."""
    ids = spark.createDataFrame([(1 << 40 | i,) for i in range(2000)], "id long")
    monkeypatch.setattr(sh, "MARKS", 1 << 16)
    some, told = sh._in_pairs(ids, ids.filter("id % 500 = 7").selectExpr("id as a", "id + 5 as b"))
    left, want = ({r.id for r in x.collect()} for x in (some, told))
    assert len(want) == 8 and want <= left and len(left) < 20
    assert sh._in_pairs(ids, ids.limit(0).selectExpr("id as a", "id as b"))[0].count() == 0

    made = []
    named = common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda *x: made.append(named(*x)) or made[-1])
    monkeypatch.setattr(sh, "shared_dir", common.shared_dir)
    rows = [(i, t) for i, t in enumerate(corpus(7))]
    out = sh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    there = [p for p in made if common.file_at(p)[0].get_file_info(common.file_at(p)[1]).type.name == "Directory"]
    assert len(made) > 5 and [p.rpartition("/")[2].rpartition("-")[0] for p in there] == ["near-stays"]
    assert out.count() == len(set(brute_components(rows, jaccard)))


def test_word_shingles(monkeypatch):
    """Equal hashes are equal runs of words, whatever the block that a word falls into."""
    r = random.Random(3)
    monkeypatch.setattr(sh, "BLOCK", 64)
    seen = {}
    for n in [*range(12), 100, 1000]:
        w = [r.choice("ab") * r.choice([1, 2, 62, 63, 64, 65, 200]) for _ in range(n)]
        got = sh.word_shingles("  " + " \n".join(w).upper() + " ").tolist()
        runs = [tuple(w[i : i + 5]) for i in range(max(1, n - 4))] if w else []
        assert len(got) == len(runs)
        for run, h in zip(runs, got, strict=True):
            assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def test_equal_ids_of_different_texts(spark, monkeypatch):
    """Texts whose 64-bit ids are equal are told apart."""
    real = F.xxhash64
    monkeypatch.setattr(sh.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else real(*c) % 3)
    rows = [(i, f"text number {i} of a few words only") for i in range(20)] + [(30, "text number 4 of a few words only")]
    got = sorted(x.doc_id for x in sh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(range(20))


def broadcast_rows(df):
    """What the plan of df broadcasts, as the text of each part."""
    return [x for x in re.split(r"(?=BroadcastExchange)", df._jdf.queryExecution().executedPlan().toString()) if x.startswith("BroadcastExchange")]


def test_look_ups_are_never_broadcast(spark):
    """Spark sizes a table before an explode; 33 rows for each of its rows were sent to the driver (F2)."""
    nodes = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    links = sh.links_within_3(common.written(nodes, "nodes"))
    assert not [x for x in broadcast_rows(links) if "inline(near" in x.split("FileScan")[0]]
    assert links.count() == 0


def test_size_classes_are_never_broadcast(spark, monkeypatch):
    """Look-ups by size class, several for each text, are sized as one (F1)."""
    plans = []
    monkeypatch.setattr(sh, "_similar", lambda pairs, texts, f=sh._similar: plans.append(broadcast_rows(pairs)) or f(pairs, texts))
    df = spark.createDataFrame(list(enumerate(corpus(2)[:12])), "doc_id long, text string")
    assert 0 < sh.drop_near_duplicates(df).count() <= 12
    assert len(plans) == 3 and not [x for x in plans[2] if "explode(sequence" in x.split("FileScan")[0]]
