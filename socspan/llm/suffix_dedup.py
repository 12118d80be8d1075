"""Removal of repeated byte strings by a sparse suffix array, built by deep-shallow sorting.

A byte goes where a string of LENGTH bytes that covers it also starts earlier.
Sorting the suffixes of all positions would move many times the text, so
suffixes are sorted only where a repeat can be:

1. Each window of LENGTH bytes has an anchor, the place of the least hash among
   its GRAM-byte strings (the first one of equals). Equal windows have equal
   anchors, and an anchor serves about 35 windows in a row.
2. Anchors meet by the hash of their gram. A window reaches SIDE bytes or more
   beyond the gram on its left or on its right, so anchors without another one
   of equal gram and equal left or right side are done with; a task sends each
   side's hash once, so a common passage is not a large group.
3. The texts give the windows of the remaining anchors: one stretch of bytes
   for each anchor. A task sends equal stretches once and knows the later ones
   as repeats already.
4. Stretches meet by their anchor's bytes. Their suffixes are sorted by
   multikey quicksort, eight bytes at a time, to SHALLOW bytes; groups that are
   equal so far go to blind tries: each member is compared with the first one
   of its group only, and branches off at the first word that differs. Members
   that reach the same leaf are equal, and all but the earliest are repeats.
5. The texts lose the bytes that repeats cover.

Hashes only bring suffixes together; that they are equal is told from their
bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, short_batches, struct_of

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # GRAM-byte strings in a window
SIDE = (LENGTH - GRAM) // 2  # 34 bytes
SHALLOW = 16  # bytes, two words
PIECE = 128 << 10  # windows that are hashed at once
FLUSH_ANCHORS = 2_000_000  # anchors that a task holds before it sends them
FLUSH_BYTES = 64 << 20  # stretches that a task holds before it sends them
SUFFIXES = 2_000_000  # about as many are sorted at once

_TABLE = np.random.default_rng(8).integers(0, 2**32, 256, np.uint32)
_PLACE = np.dtype([("q", "<u4"), ("n", "u1"), ("o", "u1")])


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray(max(len(data) - 7, 0), kind, data, strides=(1,))


def _mixed(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size bytes from each place on; the last word may overlap the one before."""
    h = np.full(len(at), size, np.uint64)
    for depth in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = (h ^ words[at + depth]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of each window of some bytes: the first place of the least hash among its grams."""
    h, span = _TABLE[data], 1
    while span < GRAM:
        t = h[:-span] >> np.uint32(15)
        t ^= h[:-span]
        t *= np.uint32(0x9E3779B1 + 2 * span)
        t += h[span:]
        h, span = t, 2 * span
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    # hash and place in one number, so that the least one tells both
    least = h.astype(np.uint64)
    least <<= np.uint64(32)
    least |= np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sides(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams at some places with SIDE bytes before, and after, each; no two alike where the text ends (lo, hi) before that."""
    words, out = _words(data), []
    for first in (at - SIDE, at):
        there = (first >= lo) & (first + GRAM + SIDE <= hi)
        side = (at.astype(np.uint64) + np.uint64(salt << 24 & (1 << 63) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        side[there] = _mixed(words, first[there], GRAM + SIDE)
        out.append(side)
    return out[0], out[1]


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(a)))


class _Sender:
    """Collects a task's anchors and packs them by bucket. Short texts are hashed together, long ones in pieces."""

    def __init__(self, buckets: int):
        self.buckets, self.ids, self.parts, self.n, self.salt = buckets, [], [], 0, int.from_bytes(os.urandom(4), "little")
        self.pieces, self.size = [], 0

    def add(self, doc: int, data: bytes) -> None:
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            piece = data[at : at + PIECE + LENGTH - 1]
            self.pieces.append((doc, at, piece))
            self.size += len(piece)
            if self.size >= PIECE:
                self._hash()

    def _hash(self) -> None:
        """Anchors of the windows that lie within a piece."""
        doc, at, size = np.array([(d, at, len(x)) for d, at, x in self.pieces], np.int64).T
        data = np.frombuffer(b"".join(x for _, _, x in self.pieces), np.uint8)
        hi = np.cumsum(size)
        lo = hi - size
        a = anchors(data)
        piece = np.repeat(np.arange(len(size)), size)[: len(a)]
        whole = np.flatnonzero(np.arange(LENGTH, LENGTH + len(a)) <= hi[piece])
        a = a[whole]
        first, n = _runs(a)
        a, q = a[first], whole[first]
        piece = piece[q]
        place = np.zeros(len(first), _PLACE)
        place["q"], place["n"], place["o"] = q - lo[piece] + at[piece], n, a - q
        self.salt += 1
        self.parts.append((_mixed(_words(data), a, GRAM), *sides(data, a, lo[piece], hi[piece], self.salt), doc[piece], place))
        self.n += len(first)
        self.pieces, self.size = [], 0

    def send(self) -> pd.DataFrame:
        """Bucket rows with the first anchor of each side's hash (six bytes of it), and rows by document of those that repeat both."""
        out = []
        if self.pieces:
            self._hash()
        if self.parts:
            h, left, right, doc, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            send, more = np.zeros(len(h), bool), np.zeros(len(h), bool)
            for side in (left, right):
                _, first, index, times = np.unique(side, return_index=True, return_inverse=True, return_counts=True)
                send[first] = True
                more |= times[index] > 1
            bucket = ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
            i = np.flatnonzero(send)
            i = i[np.argsort(bucket[i], kind="stable")]
            for lo, n in zip(*_runs(bucket[i]), strict=True):
                j = i[lo : lo + n]
                docs, index = np.unique(doc[j], return_inverse=True)
                ids = np.array([self.ids[d] for d in docs], np.int64)
                rest = zlib.compress(b"".join([index.astype("<u4").tobytes(), place[j].tobytes(), more[j].tobytes(), ids.tobytes()]), 1)
                hashes = np.stack([left[j], right[j]]).astype("<u8").view(np.uint8).reshape(2, n, 8)[:, :, 2:]
                out.append((int(bucket[j[0]]), None, None, np.array([n, len(docs)], "<i8").tobytes() + hashes.tobytes() + rest))
            more = ~send
            out += [(d1 % self.buckets, d1, d2, places) for d1, d2, places in by_document(doc[more], place[more], self.ids)]
        self.ids, self.parts, self.n = [], [], 0
        return pd.DataFrame(out, columns=["bucket", "d1", "d2", "blob"]).astype({"bucket": "int32", "d1": "Int64", "d2": "Int64"})


def by_document(doc: np.ndarray, place: np.ndarray, ids) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    for lo, n in zip(*_runs(doc), strict=True):
        yield (*map(int, ids[doc[lo]]), place[lo : lo + n].tobytes())


def _send(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _Sender(buckets)
        for pdf in batches:
            for d1, d2, text in zip(pdf["d1"].tolist(), pdf["d2"].tolist(), pdf["text"], strict=True):
                s.ids.append((d1, d2))
                s.add(len(s.ids) - 1, text.encode("utf-8", "replace"))
                if s.n > FLUSH_ANCHORS:
                    yield s.send()
        yield s.send()

    return run


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's buckets the anchors with a side whose hash occurs twice or more, by document."""
    held: dict[int, list[bytes]] = {}
    for pdf in batches:
        there = pdf["d1"].notna()
        yield pdf[there][["d1", "d2", "blob"]]
        for bucket, blob in zip(pdf["bucket"][~there], pdf["blob"][~there], strict=True):
            held.setdefault(bucket, []).append(blob)
    while held:
        hashes, docs, places, again, ids, n_docs = [], [], [], [], [], 0
        for blob in held.popitem()[1]:
            n, d = map(int, np.frombuffer(blob[:16], "<i8"))
            six = np.zeros((2, n, 8), np.uint8)
            six[:, :, 2:] = np.frombuffer(blob[16 : 16 + 12 * n], np.uint8).reshape(2, n, 6)
            hashes.append(six.view("<u8").reshape(2, n))
            rest = zlib.decompress(blob[16 + 12 * n :])
            docs.append(np.frombuffer(rest[: 4 * n], "<u4").astype(np.int64) + n_docs)
            places.append(np.frombuffer(rest[4 * n : 10 * n], _PLACE))
            again.append(np.frombuffer(rest[10 * n : 11 * n], bool))
            ids.append(np.frombuffer(rest[11 * n :], np.int64).reshape(d, 2))
            n_docs += d
        doc, place, keep, ids = (np.concatenate(x) for x in (docs, places, again, ids))
        for side in np.concatenate(hashes, axis=1):
            _, index, times = np.unique(side, return_inverse=True, return_counts=True)
            keep = keep | (times[index] > 1)
        yield pd.DataFrame(list(by_document(doc[keep], place[keep], ids)), columns=["d1", "d2", "blob"]).astype({"d1": "int64", "d2": "int64"})


STRETCH = "key long, d1 long, d2 long, start long, n int, o int, bytes binary"


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the bytes of each anchor's n windows, the anchor at byte o; rows of n = 0 hold the ranges of whole stretches that are repeats."""
    held: dict[bytes, tuple] = {}
    size = 0

    def send():
        rows = [(*v, k) for k, v in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["key", "d1", "d2", "start", "n", "o", "bytes"])

    for pdf in batches:
        late: dict[tuple[int, int], list[int]] = {}
        for d1, d2, text, blobs in zip(pdf["d1"].tolist(), pdf["d2"].tolist(), pdf["text"], pdf["blobs"], strict=True):
            data = text.encode("utf-8", "replace")
            for q, n, o in np.frombuffer(b"".join(blobs), _PLACE).tolist():
                s = data[q : q + n + LENGTH - 1]
                other = held.get(s)
                if other is None:
                    held[s] = (xxhash.xxh3_64_intdigest(s[o : o + GRAM]) - (1 << 63), d1, d2, q, n, o)
                    size += len(s)
                elif (mine := (d1, d2, q)) != other[1:4]:
                    if mine < other[1:4]:
                        held[s], mine = (other[0], *mine, n, o), other[1:4]
                    late.setdefault(mine[:2], []).extend((mine[2], mine[2] + n + LENGTH - 1))
        yield pd.DataFrame([(d1 ^ d2, d1, d2, 0, 0, 0, np.array(r, "<i8").tobytes()) for (d1, d2), r in late.items()], columns=["key", "d1", "d2", "start", "n", "o", "bytes"])
        if size > FLUSH_BYTES:
            yield send()
            size = 0
    yield send()


def repeats(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each suffix the number of the first one with the same LENGTH bytes (its own, if it is the first).

    Suffixes are given in the order of their occurrence.
    """
    words = np.ascontiguousarray(_words(buffer))
    depths = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]  # the last word may overlap the one before
    first = np.arange(len(starts))
    left, group = first, np.zeros(len(starts), np.int64)

    def split(left: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members in groups of equal keys, without those that are alone."""
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        left = left[order]
        new = np.zeros(len(left), bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        again = ~new
        again[:-1] |= again[1:].copy()  # not alone: equal to the one before or after
        return left[again], (np.cumsum(new) - 1)[again]

    for depth in (d for d in depths if d < SHALLOW):  # multikey quicksort, a word at a time; byteswap makes the order that of the bytes
        word = words[starts[left] + depth].byteswap()
        left, group = split(left, group, word) if depth else split(left, word)
    deep = [d for d in depths if d >= SHALLOW]
    while len(left):  # blind tries, one branching of all groups at a time
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = np.repeat(np.minimum.reduceat(left, at), np.diff(np.append(at, len(left))))
        branch, word, same = np.full(len(left), -1, np.int64), np.zeros(len(left), np.uint64), np.arange(len(left))
        mine, heads = starts[left], starts[head]
        for depth in deep:
            w = words[mine + depth]
            off = w != words[heads + depth]
            if off.any():
                branch[same[off]], word[same[off]] = depth, w[off].byteswap()
                same, mine, heads = same[~off], mine[~off], heads[~off]
        first[left[same]] = head[same]
        rest = branch >= 0
        left, group = split(left[rest], group[rest], branch[rest], word[rest])
    return first


def _sorted_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Byte ranges of a partition's repeats, by document: (d1, d2, ranges), each as pairs of its first byte and its end."""
    rows = []
    for pdf in batches:
        known = pdf["n"] == 0
        yield pdf[known][["d1", "d2", "bytes"]].rename(columns={"bytes": "ranges"})
        rows.append(pdf[~known])
    if not rows or not (n := sum(map(len, rows))):
        return
    r = pd.concat(rows).sort_values(["d1", "d2", "start"], kind="stable", ignore_index=True)
    rows.clear()
    buffer = np.frombuffer(b"".join([*r["bytes"], bytes(8)]), np.uint8)
    size = np.fromiter(map(len, r["bytes"]), np.int64, n)
    count, anchor, begin = r["n"].to_numpy(), r["o"].to_numpy(), np.cumsum(size) - size
    d1, d2, start = (r[c].to_numpy() for c in ("d1", "d2", "start"))
    held, late = [], []
    for away in range(WINDOW):  # equal windows lie equally far before their anchors, so memory is bounded by sorting some distances at a time
        row = np.flatnonzero((anchor >= away) & (anchor - away < count))
        held.append((row, anchor[row] - away))
        if sum(len(x) for x, _ in held) > SUFFIXES or away == WINDOW - 1:
            row, i = map(np.concatenate, zip(*held, strict=True))
            first = repeats(buffer, begin[row] + i)
            again = np.flatnonzero(first != np.arange(len(first)))
            mine, other = row[again], row[first[again]]
            # a row of the table that is there twice is one occurrence
            again = again[(d1[mine] != d1[other]) | (d2[mine] != d2[other]) | (start[mine] + i[again] != start[other] + i[first[again]])]
            late.append(row[again] * WINDOW + i[again])
            held.clear()
    late = np.sort(np.concatenate(late))
    mine, i = late // WINDOW, late % WINDOW
    lo, m = _runs(mine * (2 * WINDOW) + i - np.arange(len(late)) + len(late))  # repeats in a row
    mine = mine[lo]
    q = start[mine] + i[lo]
    ranges = np.stack([q, q + m - 1 + LENGTH], axis=1).astype("<i8")
    at = np.flatnonzero(np.concatenate([[True], (d1[mine][1:] != d1[mine][:-1]) | (d2[mine][1:] != d2[mine][:-1])])) if len(mine) else mine
    ends = np.append(at[1:], len(mine))
    yield pd.DataFrame({"d1": d1[mine[at]], "d2": d2[mine[at]], "ranges": [ranges[a:b].tobytes() for a, b in zip(at, ends, strict=True)] if len(mine) else []})


def _cut(data: bytes, first, end) -> tuple[bytes, int]:
    """What is left of data without the ranges, and the number of maximal runs that went."""
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, np.asarray(first, np.int64), 1)
    np.add.at(gone, np.asarray(end, np.int64), -1)
    mask = np.cumsum(gone)[:-1] > 0
    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~mask].tobytes(), spans


@F.pandas_udf(struct_of("n_bytes long, n_removed long, n_spans long, kept binary"))
def _removed(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = []
    for text, r in zip(texts, ranges, strict=True):
        data = text.encode("utf-8", "replace")
        kept, spans = (data, 0) if r is None else _cut(data, *np.frombuffer(b"".join(r), "<i8").reshape(-1, 2).T)
        out.append((len(data), len(data) - len(kept), spans, kept))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of docs (doc_id, text); kept holds the bytes that are left.

    Null text counts as empty, a null doc_id is the smallest. Rows of one
    doc_id with different texts go by a checksum of the text; rows that repeat
    both are the same occurrence, so neither repeats the other. An empty table
    stays empty.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d1"), F.crc32(text).alias("d2"), text.alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.filter(F.octet_length("text") >= LENGTH).mapInPandas(_send(2 * n), "bucket int, d1 long, d2 long, blob binary")
    met = sent.repartition(n, "bucket").mapInPandas(_meet, "d1 long, d2 long, blob binary")
    places = met.groupBy("d1", "d2").agg(F.collect_list("blob").alias("blobs"))
    stretches = rows.join(places, ["d1", "d2"]).mapInPandas(_stretches, STRETCH)
    ranges = stretches.repartition(2 * n, "key").mapInPandas(_sorted_out, "d1 long, d2 long, ranges binary")
    gone = ranges.groupBy("d1", "d2").agg(F.collect_list("ranges").alias("ranges"))
    out = rows.join(gone, ["d1", "d2"], "left").select("d1", _removed("text", "ranges").alias("r"))
    return out.select(F.when(F.col("d1") != -(2**63), F.col("d1")).alias("doc_id"), "r.*")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and spans, and the checksum of what is left."""
    return dedup_bytes(docs_of(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
