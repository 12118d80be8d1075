import math
import re
from collections import Counter, defaultdict

from socspan.llm import quality_rules as q


def counts(text):
    text = text or ""
    words = re.split(r"[\x20\x09-\x0D]+", text)
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-ZÀ-ÖØ-Þ]", text))


def brute(rows):
    """Verdicts by doc, with sorted lists in place of sketches and values cut to the bucket's least."""
    c = {d: dict(zip([x.split()[0] for x in q.COUNTS.split(", ")], counts(t), strict=True)) for d, t, _, _ in rows}
    failed = {d: x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for d, x in c.items()}

    def value(x, r):
        top, under, scale, *_ = q.RULES[r]
        return x[top] * scale // max(1, x[under])

    def cut(v):
        s = max(0, v.bit_length() - 6)
        return v >> s << s

    values = defaultdict(list)
    for d, _, lang, src in rows:
        if not failed[d]:
            for r in q.RULES:
                for key in ((lang or "", src or ""), (lang or "",), ()):
                    values[key, r].append(cut(value(c[d], r)))
    out = {}
    for d, _, lang, src in rows:
        ok = not failed[d]
        for r, (_, _, _, least, low, high) in q.RULES.items():
            if not ok:
                break
            v = next((x for x in (sorted(values[k, r]) for k in ((lang or "", src or ""), (lang or "",))) if len(x) >= q.GROUP_LEAST), sorted(values[(), r]))
            q1, q3 = v[math.ceil(len(v) / 4) - 1], v[math.ceil(len(v) * 3 / 4) - 1]
            s = q.SPREADS * max(q3 - q1, least)
            x = value(c[d], r)
            ok = ok and (not low or x >= q1 - s) and (not high or x <= q3 + s)
        out[d] = (*list(c[d].values())[:5], failed[d], ok)
    return out


def test_counts_on_edge_cases():
    for t in (None, "", " \n\t ", "a", "a b c a b c", "x " * 5000, "l\nl\n \n \nm\nl", "é#$ Ü\x0b<|>", "a\x85b\xa0c a\x85b\xa0c d"):
        assert q.counts_of(t) == counts(t), repr(t)


def test_against_brute_force(spark, tmp_path):
    def prose(i):
        return " ".join(f"w{(i * 7 + k * k) % 997}x{k % (3 + i % 5)}" for k in range(60 + i % 50))

    rows = [(i, prose(i), ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4]) for i in range(400)]
    rows += [(1000 + i, "### " * 10 + prose(i), "en", "s0") for i in range(5)] + [(1100 + i, prose(i).upper(), "de", "s9") for i in range(4)]
    rows += [(1200, None, None, None), (1201, "", "en", "s0"), (1202, "a b c " * 40, "en", "s0"), (1203, "word " * 20_000, "en", "rare")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words int, _extra string")
    df.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:8] for r in q.op6_quality_rules(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got == want and any(not w[5] and not w[6] for w in want.values())
    kept = q.filter_quality(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if w[6]}
    assert q.filter_quality(df.limit(0)).count() == 0
