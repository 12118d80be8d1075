"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits
have a segment that differs in fewer still, so each one looks up, for every
segment, all values within a small Hamming ball of its own and checks the
complete distance of what it meets there.

Distances link distinct fingerprints only, so copies of a text are one node.
Where very many fingerprints share a segment, pairs are not enumerated; each
function says how such a bucket is linked exactly all the same. Links become
components by alternating large and small stars over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, file_at, shared_dir, short_batches, temporary, written

HOT = 256  # fingerprints that share a segment, beyond which their pairs aren't enumerated


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words of a whole text, repeats included; A-Z are lower-cased."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = ends - [len(x) + 1 for x in w]
    n = max(1, len(w) - words + 1)
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, of which each is 1 if it is set in over half the hashes; as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(words: int):
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingles(t, words)) for t in texts], dtype="int64")

    return of


def ball(bits: int, radius: int) -> list[int]:
    """All masks of so many bits with at most radius ones."""
    out = {0}
    for _ in range(radius):
        out |= {m | 1 << i for m in out for i in range(bits)}
    return sorted(out)


def _within(value: Column, bits: int, radius: int) -> Column:
    """The values within a Hamming ball, as an array of (key, away)."""
    masks = F.array(*(F.lit(m).cast("long") for m in ball(bits, radius)))
    return F.transform(masks, lambda m: F.struct(value.bitwiseXOR(m).alias("key"), F.bit_count(m).alias("away")))


def _half(fp: str, half: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))


def links_within_3(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints fp (distinct longs) of 3 or fewer differing bits.

    Of two such fingerprints one 32-bit half differs in one bit at most: table
    rows hold each half, look-ups the ball of radius 1 around it. In a bucket
    of more than HOT rows a pair is told by meeting in the middle instead: with
    x a value of the other half, rows with x in their ball of radius 1 and
    look-ups with x in theirs of radius 2 (1, if the first half was one bit
    away) are all within 3 bits of each other row, so a group of such an x gets
    links to one of its rows. The geometry bounds these groups, whatever the
    number of copies.

    Spark sizes the look-ups as if each array had one element, a 33rd of what
    they are, and would broadcast them; so that join is told to sort.
    """
    halves = lambda cols: F.inline(F.array(*(F.struct(F.lit(s).alias("half"), *cols(s)) for s in range(2))))
    table = nodes.select("fp", halves(lambda s: [_half("fp", s).alias("key")]))
    look = nodes.select("fp", halves(lambda s: [_within(_half("fp", s), 32, 1).alias("near")])).select("fp", "half", F.inline("near"))
    size = table.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(size.filter(F.col("n") > HOT).drop("n"), "simhash-hot")
    cold = table.join(hot, ["half", "key"], "left_anti").withColumnRenamed("fp", "a")
    pairs = look.withColumnRenamed("fp", "b").hint("merge").join(cold, ["half", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)).select("a", "b")

    other = F.when(F.col("half") == 0, _half("fp", 1)).otherwise(_half("fp", 0))
    rows = table.join(hot, ["half", "key"], "left_semi").select("half", "key", "fp", F.lit(True).alias("row"), _within(other, 32, 1).alias("x"))
    asks = look.join(hot, ["half", "key"], "left_semi").select("half", "key", "fp", F.lit(False).alias("row"), F.when(F.col("away") == 0, _within(other, 32, 2)).otherwise(_within(other, 32, 1)).alias("x"))
    groups = rows.unionByName(asks).select("half", "key", "fp", "row", F.explode("x.key").alias("x")).groupBy("half", "key", "x")
    stars = groups.agg(F.min(F.when(F.col("row"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all")).filter(F.col("a").isNotNull() & (F.size("all") > 1))
    return pairs.unionByName(stars.select("a", F.explode("all").alias("b")).filter("a != b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links (a, b) the least node that it is connected with.

    Alternates two steps until nothing changes: each node passes the least of
    its neighbours and itself on to its larger neighbours, then to its smaller
    ones. Rounds grow with the logarithm of a component's size. Stars meet in a
    join that Spark may split, after a partial minimum.
    """
    now = written(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct(), "components")
    state = None
    while True:
        both = now.union(now.select("u", "v").toDF("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u != v").distinct()
        large = written(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).union(low.select(F.col("m").alias("v"), "u")).filter("u != v").distinct()
        now = written(small, "components")
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def simhash_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text): fingerprint, and smallest doc_id reachable by links.

    Null text counts as empty; texts without a word have fingerprint zero and
    link like any other; rows that repeat link with each other; a component
    whose doc_ids are all null has a null id; an empty table stays empty.
    """
    short_batches(docs.sparkSession)
    fps = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints(words)("text").alias("fp")), "simhash-fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = components(links_within_3(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    g = simhash_groups(docs_of(spark, sf_dir).select("doc_id", "text"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by Jaccard similarity: fingerprints link the nearest texts, and an exact similarity join finds the other links.

WORDS = 5
#: Similarity of 0.8 or more, as a fraction, so that limits on set sizes are whole numbers.
TOP, UNDER = 4, 5
COMMON_LEAST = 2  # texts of a task's stretch of CHUNK shingles in which a shingle counts as common
CHUNK = 4_000_000
RANKS = 1 << 22  # buckets by hash of the table of how common shingles are, a byte each; it sets an order and changes no result
MARKS = 1 << 26  # bits by hash of the table of texts that are in a pair; it keeps most others from being sent and changes no result
STEP = 1.12  # set sizes whose ratio is below this are one class


BLOCK = 1 << 16  # bytes of a text whose words are hashed at once
BITS = 1024  # of the bitmap that tells most dissimilar sets apart
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(BLOCK, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(line: bytes) -> np.ndarray:
    """64-bit hashes of words with one space between them, from running sums over the bytes; words of BLOCK bytes or more by XXH64."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(line):
        end = len(line) if len(line) - at < BLOCK else line.rfind(b" ", at, at + BLOCK)
        if end > at:
            a = np.frombuffer(line, np.uint8, end - at, at)
            ends = np.append(np.flatnonzero(a == 32), end - at)
            starts = np.append(0, ends[:-1] + 1)
            sums = np.append(np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _UP[: len(a)], dtype=np.uint64))
            out.append(_mixed((sums[ends] - sums[starts]) * _DOWN[starts]))
        else:
            end = line.find(b" ", at) if b" " in line[at:] else len(line)
            out.append(np.array([xxhash.xxh64_intdigest(line[at:end])], np.uint64))
        at = end + 1
    return np.concatenate(out)


def word_shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the runs of WORDS words of a whole text, repeats included; A-Z are lower-cased; fewer words: the whole sequence."""
    w = _word_hashes(b" ".join((text or "").encode("utf-8", "replace").lower().split()))
    n = len(w) - WORDS + 1
    h = np.zeros(max(n, min(len(w), 1)), np.uint64)
    for k in range(min(WORDS, len(w))):
        h += w[k : k + len(h)] * np.uint64(_BASE * (2 * k + 3) & (1 << 64) - 1 | 1)
    return _mixed(h)


def _fields(text: Column, salted: list[int]) -> list[Column]:
    """copy (MD5) and id (64 bits) of a text. Ids of different texts that were found equal are drawn anew."""
    plain = F.xxhash64(text)
    return [F.md5(text).alias("copy"), (F.when(plain.isin(salted), F.xxhash64(F.md5(text), text)).otherwise(plain) if salted else plain).alias("id")]


SKETCH = "id long, fp long, shingle long, texts long"


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row with the fingerprint of each text, and rows (shingle, texts) of the shingles that many texts of a task have."""
    held: dict[int, np.ndarray] = {}
    n = 0

    def common():
        values, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held.values()]), return_counts=True)
        held.clear()
        often = times >= COMMON_LEAST
        return pd.DataFrame({"id": None, "fp": None, "shingle": values[often], "texts": times[often]})

    for pdf in batches:
        fps = {}
        for key, text in dict(zip(pdf["id"].tolist(), pdf["text"], strict=True)).items():
            h = word_shingles(text)
            fps[key] = fingerprint(h)
            if key not in held:
                held[key] = np.unique(h).view(np.int64)
                n += len(h)
        yield pd.DataFrame({"id": fps.keys(), "fp": fps.values(), "shingle": None, "texts": None})
        if n > CHUNK:
            yield common()
            n = 0
    yield common()


def _ranks(path: str) -> np.ndarray:
    """The table of ranks by bucket, from the files below path; 0 where no shingle is common."""
    fs, name = file_at(path)
    ranks = np.zeros(RANKS, np.uint8)
    for batch in ds.dataset(name, filesystem=fs, format="parquet").to_batches():
        ranks[batch.column("bucket").to_numpy()] = batch.column("rank").to_numpy()
    return ranks


def _prefixes(path: str):
    """The shingles of which two texts of enough similarity have one in common: (key, id, at, n).

    A text's n distinct shingles are ordered by the rank of their bucket (how
    common the commonest shingle in it is), then by their value. Two sets of
    similarity 4/5 share four fifths of either, so of each the first
    n - ceil(4n / 5) + 1 suffice. at counts those before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = _ranks(path)
        for pdf in batches:
            out = []
            for key, text in dict(zip(pdf["id"].tolist(), pdf["text"], strict=True)).items():
                s = np.unique(word_shingles(text)).view(np.int64)
                if not len(s):
                    continue
                m = len(s) - -(-TOP * len(s) // UNDER) + 1
                s = s[np.lexsort((s, ranks[s % RANKS]))]
                out.append((s[:m], np.full(m, key), np.arange(m), np.full(m, len(s))))
            if out:
                yield pd.DataFrame(dict(zip(("key", "id", "at", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


@F.pandas_udf(T.StructType([T.StructField("s", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType()))]))
def _sets(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        s = np.unique(word_shingles(text))
        bits = np.zeros(BITS, bool)
        bits[s % np.uint64(BITS)] = True
        out.append((s.view(np.int64).tolist(), len(s), np.packbits(bits).view(np.int64).tolist()))
    return pd.DataFrame(out, columns=["s", "n", "bits"])


def _marked(path: str):
    """Whether an id may be among those of the files below path: never false for one of them, seldom true for another."""

    @F.pandas_udf(T.BooleanType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fs, name = file_at(path)
        marks = np.zeros(MARKS // 8, np.uint8)
        for batch in ds.dataset(name, filesystem=fs, format="parquet").to_batches():
            at = batch.column("id").to_numpy() & (MARKS - 1)
            np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for ids in batches:
            at = ids.to_numpy() & (MARKS - 1)
            yield pd.Series((marks[at >> 3] >> (at & 7)) & 1 == 1)

    return of


def _in_pairs(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those rows (id, ..) whose id may be in a pair (a, b), told in their own task before anything is sent, and the ids of pairs."""
    path = shared_dir(rows.sparkSession, "near-ids")
    pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().write.parquet(path)
    return rows.filter(_marked(path)("id")), rows.sparkSession.read.schema("id long").parquet(path)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text ids whose shingle sets have enough similarity; only sets of texts in pairs are made.

    Each bit in which the bitmaps of two sets differ is an element that only
    one of them has, and similar sets have a ninth of both sizes of these at
    most. Pairs that differ more go before the sets are fetched. Texts that are
    in no pair, and copies of a text, are dropped in each task before they are
    sent.
    """
    pairs = written(pairs, "near-pairs")
    some, ids = _in_pairs(texts, pairs)
    held = written(some.dropDuplicates(["id"]).join(ids, "id", "left_semi").select("id", _sets("text").alias("x")).select("id", "x.*"), "near-sets")
    side = lambda c, *cols, of=held: of.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in cols))
    both = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(BITS // 64)))
    near = written(both.filter((TOP + UNDER) * apart <= (UNDER - TOP) * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "near-pairs")
    left = _in_pairs(held.select("id", "s"), near)[0]
    both = near.join(side("a", "s", of=left), "a").join(side("b", "s", of=left), "b")
    shared = F.size(F.array_intersect("a_s", "b_s"))
    return written(both.filter(UNDER * shared >= TOP * (F.size("a_s") + F.size("b_s") - shared)).select("a", "b"), "near-links")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (id, ..) with the component of each id by links."""
    root = components(links).withColumnRenamed("node", "id")
    return rows.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))


def fingerprint_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of similar texts among those whose fingerprints differ in 3 bits or fewer; nodes are (id, fp).

    Texts of equal fingerprints meet the least one of them, and these meet by
    multi-index hashing.
    """
    firsts = written(nodes.groupBy("fp").agg(F.min("id").alias("a")), "near-firsts")
    equal = nodes.withColumnRenamed("id", "b").join(firsts, "fp").filter("a != b").select("a", "b")
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("a").alias(f"{c}_id"))
    near = links_within_3(firsts.select("fp")).join(side("a"), "a").join(side("b"), "b").select("a_id", "b_id")
    return _similar(equal.union(near), texts)


def similarity_links(nodes: DataFrame, texts: DataFrame, ranks: str, links: DataFrame) -> DataFrame:
    """links, and those that connect all other texts of enough similarity: an exact join over prefixes of ordered shingles.

    Two rows of a key can only belong to similar texts if what is left of both
    orders is enough for the least common part (4/9 of both sizes). Texts of a
    key first meet its most central one, that with the least share of rarer
    shingles, which links a group of near copies by as many pairs as it has
    texts. Then, where a key still has texts of different components, those
    outside its largest component meet all that aren't in their own; for that,
    each looks up the size classes that texts similar to it can have. Spark
    sizes these look-ups as one a text, so they are kept from being broadcast.
    """
    prefixes = texts.mapInPandas(_prefixes(ranks), "key long, id long, at int, n int")
    shared = prefixes.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("key")
    rows = _rooted(prefixes.join(shared, "key").distinct(), links)
    rows = written(rows.select("key", "id", "root", "n", (F.col("n") - F.col("at")).alias("rest")), "near-rows")

    def enough(a: str, b: str) -> Column:
        need = TOP * (F.col(f"{a}n") + F.col(f"{b}n"))
        return ((TOP + UNDER) * F.col(f"{a}rest") >= need) & ((TOP + UNDER) * F.col(f"{b}rest") >= need)

    central = F.min(F.struct((1 - F.col("rest") / F.col("n")).alias("off"), "id", "root", "n", "rest"))
    heads = rows.groupBy("key").agg(central.alias("h")).select("key", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("id", "root", "n", "rest")))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = rows.join(heads, "key").filter((F.col("root") != F.col("h_root")) & enough("", "h_")).select(*pair("id", "h_id")).distinct()
    links = links.unionByName(_similar(stars, texts))

    rows = _rooted(rows.drop("root"), links)
    size = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    rows = written(rows.join(size.drop("roots"), "key"), "near-rows")
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")
    lo, hi = F.ceil(F.col("o_n") * TOP / UNDER), F.floor(F.least(F.col("o_n") * UNDER / TOP, F.col("o_rest") * (TOP + UNDER) / TOP - F.col("o_n")))
    out = rows.filter("root != most").select("key", *(F.col(c).alias(f"o_{c}") for c in ("id", "root", "n", "rest")))
    out = out.filter(hi >= lo).withColumn("class", F.explode(F.sequence(step(lo), step(hi))))
    inner = rows.withColumn("class", step(F.col("n"))).drop("most")
    rest = out.hint("merge").join(inner, ["key", "class"]).filter((F.col("root") != F.col("o_root")) & enough("", "o_")).select(*pair("id", "o_id")).distinct()
    return links.unionByName(_similar(rest, texts))


def near_links(sketch: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all texts (id, text) of enough similarity, from what _sketched() gave."""
    nodes = sketch.filter("shingle is null").select("id", "fp").distinct()
    frequent = sketch.filter("shingle is not null").groupBy("shingle").agg(F.sum("texts").alias("n"))
    ranks = frequent.groupBy(F.pmod("shingle", F.lit(RANKS)).cast("int").alias("bucket")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("rank"))
    path = shared_dir(texts.sparkSession, "near-ranks")
    ranks.write.parquet(path)
    return similarity_links(nodes, texts, path, fingerprint_links(nodes, texts))


def _staying(docs: DataFrame, text: Column) -> DataFrame:
    """Of each group of near-duplicates of docs by text the row that stays: its copy (MD5), doc_id, and how many rows have both."""
    salted: list[int] = []
    while True:
        fields = _fields(text, salted)
        occurrences = docs.select(*fields, F.col("doc_id").cast("long").alias("doc_id")).groupBy("id", "copy", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rows")).alias("first")
        copies = written(occurrences.groupBy("id", "copy").agg(first), "near-copies")
        clash = [r[0] for r in copies.groupBy("id").count().filter("count > 1").select("id").collect()]  # one for 2^65 pairs of texts
        if not clash:
            break
        salted += clash
    texts = docs.select(fields[1], text.alias("text"))
    sketch = written(texts.mapInPandas(_sketched, SKETCH), "near-sketch")
    found = components(near_links(sketch, texts))
    rooted = copies.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rooted.groupBy("root").agg(F.min(F.struct("first", "copy")).alias("k")).select(F.col("k.copy").alias("_stay"), F.col("k.first.doc_id").alias("_first"), F.col("k.first.rows").alias("_rows"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group linked at a similarity of 0.8 of 5-word shingles one row stays, that of the smallest doc_id.

    Copies of a text are told by its MD5 and are one node of the group; of
    repeated rows one stays; null doc_ids come last; null text counts as empty,
    and texts without a word are one group. Very long texts count whole: their
    shingles are held one text at a time. An empty table stays empty. The
    columns of docs come back; those that begin with an underscore are refused.
    What is written on the way is removed, but for the table of rows that stay.
    """
    if bad := [c for c in docs.columns if c.startswith("_")]:
        raise ValueError(f"columns {bad} begin with an underscore")
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    short_batches(spark)
    path = shared_dir(spark, "near-stays")
    with temporary():
        stays = _staying(docs, text)
        stays.write.parquet(path)
    stays = spark.read.schema(stays.schema).parquet(path)
    rows = docs.withColumn("_copy", F.md5(text)).join(stays, F.col("_copy") == F.col("_stay")).filter(F.col("doc_id").cast("long").eqNullSafe(F.col("_first")))
    if not stays.filter("_rows > 1").isEmpty():
        rows = rows.dropDuplicates(["_copy"])
    return rows.select(*(docs[c] for c in docs.columns))
