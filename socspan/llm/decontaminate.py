"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item become candidates when they share a seed of
LEAST_MATCH consecutive tokens. The pair is then tiled: the longest common
stretch of tokens not yet in a tile is marked, again and again, found by
running Karp-Rabin hashes over the unmarked tokens, until none of LEAST_MATCH
tokens is left. Tiles may stand in any order, so a reordered passage counts as
much as a verbatim one. An item leaks where its tiles cover COVERAGE of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, refuse, short_batches, written

LEAST_MATCH = 4  # tokens
COVERAGE = 0.6
#: Items are sent to every executor while they hold this many tokens at most (about 100 MB); beyond that, seeds are joined.
TOKENS_SENT = 5_000_000

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TILED = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("tiles", T.IntegerType())]))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in lower case."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in _TOKEN.findall((text or "").lower())], np.uint64)


def windows(t: np.ndarray, k: int) -> np.ndarray:
    """Running Karp-Rabin hash of each window of k tokens, modulo 2^64; t's values are random already."""
    n = len(t) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + t[i : i + n]
    return out


def tile(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length), longest first; ties go to the first place in item, then in text."""
    k = min(LEAST_MATCH, len(item))
    if not k:
        return []
    places = defaultdict(list)
    for i, h in enumerate(windows(item, k).tolist()):
        places[h].append(i)
    hashes = windows(text, k)
    seeds = [(i, j) for j in np.flatnonzero(np.isin(hashes, np.fromiter(places, np.uint64))).tolist() for i in places[int(hashes[j])]]
    item_l, marked, used, tiles = item.tolist(), bytearray(len(item)), set(), []
    at = {j: int(text[j]) for _, j0 in seeds for j in range(j0, min(j0 + len(item), len(text)))}
    while seeds:
        best, found, left = 0, [], []
        longest: dict[tuple[int, int], int] = {}
        for i, j in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
            if any(marked[i : i + k]) or any(x in used for x in range(j, j + k)):
                continue
            left.append((i, j))
            if (i - 1, j - 1) in longest:  # part of the match that the seed before it gave
                longest[i, j] = longest[i - 1, j - 1] - 1
                continue
            n = 0
            while i + n < len(item_l) and not marked[i + n] and j + n not in used and at.get(j + n) == item_l[i + n]:
                n += 1
            longest[i, j] = n
            if n > best:
                best, found = n, []
            if n == best:
                found.append((i, j))
        if best < k:
            break
        for i, j in sorted(found):
            if not any(marked[i : i + best]) and not any(x in used for x in range(j, j + best)):
                tiles.append((i, j, best))
                marked[i : i + best] = b"\x01" * best
                used.update(range(j, j + best))
        seeds = left
    return tiles


def tiled(item_id: int, item: np.ndarray, text: np.ndarray) -> dict | None:
    """The pair's coverage, or None where it stays below COVERAGE."""
    found = tile(item, text)
    covered = sum(n for _, _, n in found)
    return {"item_id": item_id, "n_tokens": len(item), "covered": covered, "tiles": len(found)} if len(item) and covered >= COVERAGE * len(item) else None


class Items:
    """The benchmark's tokens, and the items of each seed."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.items = {i: t for i, x in rows if len(t := tokens(x))}
        self.windows = {i: windows(t, min(LEAST_MATCH, len(t))) for i, t in self.items.items()}
        self.seeds: dict[int, set[int]] = defaultdict(set)
        for i, w in self.windows.items():
            for h in w.tolist():
                self.seeds[h].add(i)
        self.lengths = sorted({min(LEAST_MATCH, len(t)) for t in self.items.values()})
        self.known = np.sort(np.fromiter(self.seeds, np.uint64, len(self.seeds)))

    def _reach(self, item: int, seeds: np.ndarray) -> int:
        """Tokens of the item within its windows that the text has: no tiling covers more."""
        hit = np.flatnonzero(np.isin(self.windows[item], seeds))
        covered = np.zeros(len(self.items[item]), bool)
        for k in range(min(LEAST_MATCH, len(covered))):
            covered[hit + k] = True
        return int(covered.sum())

    def leaks(self, text: str | None) -> list[dict]:
        if not self.lengths:
            return []
        t = tokens(text)
        got = []
        for k in self.lengths:
            w = windows(t, k)
            at = np.minimum(np.searchsorted(self.known, w), len(self.known) - 1)
            got.append(np.unique(w[self.known[at] == w]))
        seeds = np.concatenate(got)
        items = {i for h in seeds.tolist() for i in self.seeds[h]}
        return [x for i in sorted(items) if self._reach(i, seeds) >= COVERAGE * len(self.items[i]) and (x := tiled(i, self.items[i], t))]


def _by_broadcast(docs: DataFrame, bench: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in bench.collect()])
    held: list[Items] = []

    @F.pandas_udf(_TILED)
    def leaks(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Items(shared.value))
        return pd.Series([held[0].leaks(t) for t in texts])

    return docs.withColumn("_leaks", leaks(F.col("text")))


def _seeds(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                t = tokens(text)
                # of an item its own seeds; of a text those that an item shorter than LEAST_MATCH could have, too
                sizes = range(1, LEAST_MATCH + 1) if with_text else [min(LEAST_MATCH, len(t)) or 1]
                h = np.unique(np.concatenate([windows(t, k) for k in sizes]))
                if len(h):
                    yield pd.DataFrame({"key": key, "seed": h.view(np.int64)})

    return run


def _by_join(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Candidates from a join on seeds, for benchmarks too large to send to every executor.

    A text is known by its hash here, and each distinct one is tiled once; a
    seed that many texts share meets the few items that have it.
    """
    keyed = docs.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select(F.col("_key").alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    mine = texts.mapInPandas(_seeds(True), "key string, seed long")
    theirs = bench.select(F.col("item_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_seeds(False), "key long, seed long")
    pairs = written(mine.join(theirs.withColumnRenamed("key", "item_id"), "seed").select("key", "item_id").distinct(), "leak-candidates")
    full = pairs.join(texts, "key").join(bench.select("item_id", F.col("text").alias("item")), "item_id")

    @F.pandas_udf(_TILED)
    def tiles(ids: pd.Series, items: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([[x] if (x := tiled(i, tokens(a), tokens(b))) else [] for i, a, b in zip(ids, items, whole, strict=True)])

    found = full.select("key", F.inline(tiles("item_id", "item", "text"))).groupBy(F.col("key").alias("_found")).agg(F.sort_array(F.collect_list(F.struct("item_id", "n_tokens", "covered", "tiles"))).alias("_leaks"))
    return keyed.join(found, F.col("_key") == F.col("_found"), "left").withColumn("_leaks", F.coalesce("_leaks", F.array().cast(_TILED))).drop("_key", "_found")


def find_leaks(docs: DataFrame, bench: DataFrame, tokens_sent: int = TOKENS_SENT) -> DataFrame:
    """docs with the array _leaks: the items (item_id, n_tokens, covered, tiles) that leak into a row's text.

    Null text counts as empty; items without a token or without an id never
    leak; an item shorter than LEAST_MATCH must be there whole; repeated rows
    get equal results and repeated item_ids are one item, that of the greatest
    text; an empty table of either kind gives no leaks; texts of any length are
    looked through whole. Columns _leaks, _key and _found are refused.
    """
    refuse(docs, "_leaks", "_key", "_found")
    short_batches(docs.sparkSession)
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    return (_by_broadcast if size <= 4 * tokens_sent else _by_join)(docs, bench)  # a token and its gap take two characters at least


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that leaks into it."""
    docs = find_leaks(docs_of(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select("doc_id", F.inline("_leaks")).withColumn("coverage", F.round(F.col("covered") / F.col("n_tokens"), 6))
