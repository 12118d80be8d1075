"""Text features of notes (TXT-01..07, TXT-09, TXT-10)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import share, tokens
from ..functions.tables import settled, written
from ..params import DEFAULT, PLACEHOLDER, Params

BLANK = "empty note placeholder"


def _filled(notes: str = "notes") -> Column:
    """The note, or a stand-in where it is blank."""
    n = F.coalesce(F.col(notes), F.lit(""))
    return F.when(n.rlike("\\S"), n).otherwise(F.lit(BLANK))


BLOCK_CHARS = 1 << 20  # notes of a group are weighed in blocks of about so many characters
PART_CHARS = 4 << 20  # a part of a group's grams has those of about so many characters
GROUPS_AT_ONCE = 1 << 16  # groups with an open block in a task
RARE_BUCKETS = 1 << 20  # counts by which shingles are ordered; a power of two
FAMILY_BLOCK = 512  # sets of a block, about
SETS_AT_ONCE = 500  # notes whose sets a task holds
_TOKEN = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\w\w+", re.ASCII)
_SPACES = re.compile(r"\s\s+", re.ASCII)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _word_grams(note: str) -> np.ndarray:
    """Words of two or more word characters and pairs of neighbours, as hashes."""
    h = _hashes(_WORD.findall(note))
    return np.concatenate([h, (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))])


def _char_grams(note: str) -> np.ndarray:
    """Runs of two and three characters, white space runs counted as one space: 21 bits a character, so each number is one run."""
    c = np.frombuffer(_SPACES.sub(" ", note).encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    return np.concatenate([two, (two[:-1] << np.uint64(21)) | c[2:]])


def _weighed(notes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block as a sparse matrix: its distinct grams in ascending order, and by entry the note, the gram's place and 1 + ln of the count.

    Grams of words are negative numbers, those of characters aren't.
    """
    rows, found, counts = [], [], []
    for i, note in enumerate(notes):
        both = np.concatenate([_word_grams(note) | np.uint64(1 << 63), _char_grams(note)]).view(np.int64)
        g, n = np.unique(both, return_counts=True)
        rows.append(np.full(len(g), i, np.int32))
        found.append(g)
        counts.append(n)
    g, at = np.unique(np.concatenate(found), return_inverse=True)
    return g, np.concatenate(rows), at.astype(np.int32), 1 + np.log(np.concatenate(counts))


def _dealt(chars: int, groups: int):
    """Adds to notes the block that each belongs to: notes of a group that a task meets one after the other, of about so many characters."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, {}  # by group: its open block, and the characters in it
        for batch in batches:
            blocks = []
            for group, note in zip(batch.column("group").to_pylist(), batch.column("note").to_pylist(), strict=True):
                if group not in held:
                    if len(held) >= groups:
                        held.clear()
                    held[group] = [block, 0]
                    block += 1
                blocks.append(held[group][0])
                held[group][1] += len(note)
                if held[group][1] >= chars:
                    del held[group]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, "block"])

    return deal


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of zero or more in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(numbers.max(initial=0))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _packed_grams(g: np.ndarray) -> bytes:
    """Ascending grams as steps from one to the next, first all lowest bytes, then all second ones, and so on: steps are small, so the last compress."""
    return np.diff(g.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_grams(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64).view(np.int64)


def _parted(g: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending grams by part (a hash, of a power of two), and where in it each part ends."""
    if parts == 1:
        return np.arange(len(g)), np.array([len(g)])
    part = ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - parts.bit_length())).astype(np.int64)
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def _by_part(group: int, ends: np.ndarray, **columns: list[bytes]) -> pa.Table:
    """A row for each part that isn't empty, of columns that have a value a part."""
    some = np.flatnonzero(np.diff(ends, prepend=0))
    return pa.table({"group": np.full(len(some), group, np.int64), "part": some.astype(np.int32), **{c: pa.array([x[i] for i in some], pa.binary()) for c, x in columns.items()}})


def _tallied(rows: pa.Table) -> pa.Table:
    """Of a block: its grams by part, and how many of its notes have each."""
    g, _, at, _ = _weighed(rows.column("note").to_pylist())
    group, block, parts = (rows.column(c)[0].as_py() for c in ("group", "block", "parts"))
    order, ends = _parted(g, parts)
    c = np.bincount(at, minlength=len(g))
    of = lambda x, pack: [pack(y) for y in np.split(x[order], ends[:-1])]
    out = _by_part(group, ends, g=of(g, _packed_grams), c=of(c, _packed))
    return out.append_column("block", pa.array(np.full(len(out), block, np.int64)))


def _told(rows: pa.Table) -> pa.Table:
    """Of a part of a group's grams: for each block, how many notes of the others have each of its grams, in their order."""
    grams = [_unpacked_grams(x) for x in rows.column("g").to_pylist()]
    c = np.concatenate([_unpacked(x) for x in rows.column("c").to_pylist()])
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    others = np.bincount(at, c).astype(np.int64)[at] - c
    ends = np.cumsum([len(g) for g in grams])
    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "others": pa.array([_packed(x) for x in np.split(others, ends[:-1])], pa.binary())})


def _summed(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Of a block: the sums of its unit vectors by gram, for grams that other blocks of the group have too.

    known has the counts of other blocks' notes by part. A row of part -1 has
    what needs no other block: the squared sums of the other grams, less the
    number of vectors that aren't zero.
    """
    notes = rows.column("note").to_pylist()
    group, n, parts = (rows.column(c)[0].as_py() for c in ("group", "n", "parts"))
    g, row, at, w = _weighed(notes)
    order, ends = _parted(g, parts)
    others = np.zeros(len(g), np.int64)
    if len(g):
        others[order] = np.concatenate([_unpacked(x) for x in known.sort_by("part").column("others").to_pylist()])
    df, lone = np.bincount(at, minlength=len(g)) + others, others == 0
    w = w * (np.log((1 + n) / (1 + df)) + 1)[at]
    vector = row * 2 + (g < 0)[at]  # a note has two, of words and of characters
    norm = np.sqrt(np.bincount(vector, w * w, minlength=2 * len(notes)))
    s = np.bincount(at, w / norm[vector], minlength=len(g))
    own = (s[lone] ** 2).sum() - (norm > 0).sum()
    shared = [x[~lone[x]] for x in np.split(order, ends[:-1])]
    out = _by_part(group, np.cumsum([len(x) for x in shared]), g=[_packed_grams(g[x]) for x in shared], s=[s[x].tobytes() for x in shared])
    return pa.concat_tables([out, pa.table({"group": np.full(1, group, np.int64), "part": np.full(1, -1, np.int32), "g": pa.array([b""], pa.binary()), "s": pa.array([np.float64(own).tobytes()], pa.binary())})])


def _squared(rows: pa.Table) -> pa.Table:
    """Of a part of a group's grams: the squared length of the sum of its blocks' sums; of part -1: what the blocks have of their own."""
    group, part = (rows.column(c)[0].as_py() for c in ("group", "part"))
    s = np.concatenate([np.frombuffer(x, np.float64) for x in rows.column("s").to_pylist()])
    if part < 0:
        total = s.sum()
    else:
        _, at = np.unique(np.concatenate([_unpacked_grams(x) for x in rows.column("g").to_pylist()]), return_inverse=True)
        total = (np.bincount(at, s) ** 2).sum()
    return pa.table({"group": np.full(1, group, np.int64), "x": np.full(1, total)})


def note_similarity(notes: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-01, TXT-02: mean cosine of the TF-IDF vectors of all pairs of notes within a group; 0 for fewer than two.

    Sublinear term weights, smoothed idf and unit vectors, for words and
    characters apart; a pair's similarity is the mean of both. All pairs aren't
    formed: for unit vectors their sum follows from the length of the vectors'
    sum, (|sum|^2 - n1) / (n (n - 1)) with n1 vectors that aren't zero.

    Notes are dealt to blocks of a group; a block's grams are found twice, to
    count and to weigh them, so nothing larger than a note is stored or sent.
    What is exchanged is the notes and, for each gram of a block (not of a
    note), about 6 bytes on the way out, one or two for the count on the way
    back, and 14 for a sum if several blocks have it: grams are dealt to parts
    by hash, more where a group has more text, and a block's grams of a part
    are packed into one row. Words and groups are told apart by 64-bit hashes.
    """
    group = F.xxhash64(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    d = notes.select(*keys, group.alias("group"), F.lower(_filled()).alias("note"))
    placed = written(d.mapInArrow(_dealt(BLOCK_CHARS, GROUPS_AT_ONCE), T.StructType([*d.schema, T.StructField("block", T.LongType())])), "note-blocks")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.sum(F.length("note")) / F.lit(PART_CHARS))))).cast("int")
    n = written(placed.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")), "note-groups")
    sized = placed.join(n.select("group", "n", "parts"), "group").select("group", "block", "n", "parts", "note")
    each = sized.groupBy("block").applyInArrow(_tallied, "group long, part int, g binary, c binary, block long")
    known = written(each.groupBy("group", "part").applyInArrow(_told, "block long, part int, others binary"), "note-counts")
    sums = sized.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, "group long, part int, g binary, s binary")
    pairs = sums.groupBy("group", "part").applyInArrow(_squared, "group long, x double").groupBy("group").agg((F.sum("x") / 2).alias("pairs"))
    sim = F.coalesce(F.col("pairs") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return n.join(pairs, "group", "left").select(*keys, F.col("n").alias("n_notes"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim)).alias("similarity"))


def embedding_similarity(vectors: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """TXT-03: mean cosine of all pairs of given vectors within a group, by the same closed form; zero vectors count as unlike."""
    v = vectors.select(*keys, F.col(column).cast("array<double>").alias("v"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm") > 0).alias("n1"))
    unit = v.filter("norm > 0").select(*keys, "norm", F.posexplode("v").alias("i", "x"))
    sq = unit.groupBy(*keys, "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sim = F.coalesce((F.col("sq") - F.col("n1")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return n.join(sq, keys, "left").select(*keys, F.col("n").alias("n_vectors"), sim.alias("similarity"))


def richness() -> Column:
    """TXT-04: distinct tokens over tokens of a note, damped for short ones; null for a note without tokens."""
    t = tokens(F.col("notes"))
    n = F.size(t)
    return F.when(n > 0, F.size(F.array_distinct(t)) / n * (F.lit(0.5) + 0.5 * F.least(F.lit(1.0), n / F.lit(50.0))))


def is_placeholder() -> Column:
    """TXT-06: blank, or one of the phrases that say nothing."""
    n = F.coalesce("notes", F.lit(""))
    return n.rlike("^\\s*$") | n.rlike(PLACEHOLDER)


def _shingled(note: str) -> np.ndarray:
    """The set of 3-word shingles of a lower-case note (of all its words where there are fewer) as ascending 64-bit hashes."""
    w = _TOKEN.findall(note)
    t = [" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)] if len(w) >= 3 else [" ".join(w)] if w else []
    return np.unique(_hashes(list(set(t))).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each note that has words: its set, the set's size and two hashes of it."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        group, notes = batch.column("group").to_pylist(), batch.column("note").to_pylist()
        for lo in range(0, len(notes), SETS_AT_ONCE):
            out = [(g, s) for g, s in zip(group[lo : lo + SETS_AT_ONCE], map(_shingled, notes[lo : lo + SETS_AT_ONCE]), strict=True) if len(s)]
            ids = [[xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63) for _, s in out] for seed in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array(range(row, row + len(out)), pa.int64()), *(pa.array(i, pa.int64()) for i in ids), pa.array([len(s) for _, s in out], pa.int32()), pa.array([s for _, s in out], pa.list_(pa.int64()))], ["group", "row", "id", "id2", "k", "s"])
            row += len(out)


def _rarest(counts, share: float):
    """Of each set, the first shingles in the order of their buckets' counts: two sets that are similar share one of them."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for s in batch.column("s"):
                g = s.values.to_numpy()
                n = len(g) - math.ceil(len(g) * share - 1e-9) + 1
                out.append(g[np.lexsort((g, counts.value[g & (len(counts.value) - 1)]))[:n]])
            size = [len(g) for g in out[1:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("group", "row", "k")), pa.array(np.concatenate(out))], ["group", "row", "k", "g"])

    return first


def _alike(share: float):
    """Of the pairs of two blocks: how many pairs of notes are similar, by group."""

    def count(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {row: (m, s.values.to_numpy()) for row, m, s in zip(sets.column("row").to_pylist(), sets.column("m").to_pylist(), sets.column("s"), strict=True)}
        found: dict[int, int] = {}
        for group, a, b in zip(*(pairs.column(c).to_pylist() for c in ("group", "a_row", "b_row")), strict=True):
            (m, x), (n, y) = held[a], held[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= share * (len(x) + len(y) - common):
                found[group] = found.get(group, 0) + m * n
        return pa.table({"group": pa.array(found.keys(), pa.int64()), "alike": pa.array(found.values(), pa.int64())})

    return count


def copy_paste(notes: DataFrame, keys: list[str], p: Params = DEFAULT) -> DataFrame:
    """TXT-05: pairs of notes whose 3-word shingle sets have a Jaccard similarity of p.copy_paste or more, over all pairs.

    Notes of equal sets are counted together, so copies aren't paired with
    each other one by one. Sets that are similar share one of the rarest
    shingles of each (prefix filter) and have nearly equal sizes (length
    filter); pairs that pass both are compared exactly. Notes without words
    have no set and are similar to none.

    Sets are found once and written, a 64-bit hash for each shingle. How rare
    a shingle is comes from counts by the hash's low bits, a table of fixed
    size; any one order of shingles is right for the filter. Only the filter's
    shingles are exchanged. Sets that share a shingle with the same first set
    are a family, dealt to blocks of FAMILY_BLOCK; a set goes once to each
    block that it has a pair in, not once for each pair.
    """
    group = F.xxhash64(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    d = notes.select(*keys, group.alias("group"), F.lower(F.coalesce(F.col("notes"), F.lit(""))).alias("note"))
    all_n = d.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"))
    sets = written(d.select("group", "note").mapInArrow(_sets, "group long, row long, id long, id2 long, k int, s array<long>"), "note-sets")
    classes = written(sets.groupBy("group", "id", "id2", "k").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("row")), "note-classes")
    same = classes.groupBy("group").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(RARE_BUCKETS, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("s").flatten().to_numpy() & (RARE_BUCKETS - 1), minlength=RARE_BUCKETS)
        hit = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(held[hit])], ["b", "c"])

    few = sets.select("s").coalesce(max(1, notes.sparkSession.sparkContext.defaultParallelism))
    seen = few.mapInArrow(count, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()  # a row for each bucket
    counts = np.zeros(RARE_BUCKETS, np.int64)
    counts[seen.column("b").to_numpy()] = seen.column("c").to_numpy()
    sent = notes.sparkSession.sparkContext.broadcast(counts)
    rare = sets.select("group", "row", "k", "s").mapInArrow(_rarest(sent, p.copy_paste), "group long, row long, k int, g long")
    first = written(rare.join(classes.select("row"), "row", "left_semi"), "note-shingles")  # of one set of each class
    a, b = (first.select("group", "g", F.col("row").alias(f"{x}_row"), F.col("k").alias(f"{x}_k")) for x in "ab")
    pairs = written(a.join(b, ["group", "g"]).filter((F.col("a_row") < F.col("b_row")) & (F.least("a_k", "b_k") >= p.copy_paste * F.greatest("a_k", "b_k"))).select("group", "a_row", "b_row").distinct(), "note-pairs")
    lead = first.groupBy("group", "g").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    led = written(first.join(lead, ["group", "g"]).groupBy("row").agg(F.min("lead").alias("lead")), "note-leads")
    parts = led.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).alias("parts"))
    home = led.join(parts, "lead").select("row", F.xxhash64("lead", F.pmod(F.xxhash64("row"), "parts")).alias("home"))
    for x in "ab":
        pairs = pairs.join(home.select(F.col("row").alias(f"{x}_row"), F.col("home").alias(f"{x}_home")), f"{x}_row")
    meet = written(pairs.select("group", "a_row", "b_row", F.xxhash64(F.least("a_home", "b_home"), F.greatest("a_home", "b_home")).alias("meet")), "note-meetings")
    come = meet.select(F.col("meet").alias("at"), F.explode(F.array("a_row", "b_row")).alias("row")).distinct()
    brought = come.join(sets.select("row", "s"), "row").join(classes.select("row", "m"), "row").select("at", "row", "m", "s")
    alike = meet.groupBy("meet").cogroup(brought.groupBy("at")).applyInArrow(_alike(p.copy_paste), "group long, alike long").groupBy("group").agg(F.sum("alike").alias("alike"))
    d = all_n.join(same, "group", "left").join(alike, "group", "left")
    hits = F.coalesce("same", F.lit(0.0)) + F.coalesce(F.col("alike").cast("double"), F.lit(0.0))
    return d.select(*keys, F.coalesce(hits / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("copy_paste_ratio"))


def text_summary(investigations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """TXT-07: all text features by entity.

    The three comparisons of notes are done one after the other, and what each
    of them wrote and exchanged goes before the next: the disk holds one.
    """
    keys = ["entity_id"]
    alone = lambda name, f: settled(investigations.sparkSession, name, f)
    base = investigations.groupBy(*keys).agg(F.count(F.lit(1)).alias("note_count"), F.coalesce(F.avg(richness()), F.lit(0.0)).alias("vocabulary_richness"), share(is_placeholder()).alias("placeholder_ratio"))
    sim = alone("note-similarity", lambda: note_similarity(investigations, keys)).select("entity_id", F.col("similarity").alias("template_similarity"))
    own = alone("note-similarity", lambda: note_similarity(investigations, ["entity_id", "analyst_id"])).filter("n_notes > 1").groupBy("entity_id").agg(F.max("similarity").alias("analyst_similarity_max"))
    copied = alone("copy-paste", lambda: copy_paste(investigations, keys, p))
    return base.join(sim, "entity_id").join(own, "entity_id", "left").withColumn("analyst_similarity_max", F.coalesce("analyst_similarity_max", F.lit(0.0))).join(copied, "entity_id")


def topics(notes: DataFrame, id_col: str, k: int = 10, seed: int = 42, iterations: int = 10) -> DataFrame:
    """TXT-09: (id, topic): the likeliest of k topics of each note, by LDA over word counts.

    The counts are written once: each of LDA's iterations reads all of them,
    and would else join and cut up the notes again.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    d = notes.select(id_col, tokens(_filled()).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5000, minDF=2.0).fit(d)
    v = written(counts.transform(d).select(id_col, "features"), "note-counts")
    m = LDA(k=k, seed=seed, maxIter=iterations).fit(v)
    weights = vector_to_array("topicDistribution")
    return m.transform(v).select(id_col, (F.array_position(weights, F.array_max(weights)) - 1).cast("int").alias("topic"))


def topic_table(assigned: DataFrame) -> DataFrame:
    """TXT-09: size, largest entity's share and flag of each topic, from rows (topic, entity_id)."""
    n = assigned.groupBy("topic", "entity_id").agg(F.count(F.lit(1)).alias("n")).groupBy("topic").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("entity_id", F.struct("n", "entity_id")).alias("top_entity"))
    return n.select("topic", "size", "top_entity", (F.col("most") / F.col("size")).alias("concentration"), (F.col("most") / F.col("size") > 0.6).alias("concentrated"))


def topic_labels(assigned: DataFrame, top: int = 8) -> DataFrame:
    """TXT-10: the top terms of each topic by mean TF-IDF, from rows (topic, notes)."""
    d = assigned.select("topic", F.monotonically_increasing_id().alias("_id"), tokens(F.col("notes")).alias("w"))
    n = d.groupBy("topic").agg(F.count(F.lit(1)).alias("members"))
    tf = d.select("topic", "_id", F.explode("w").alias("term")).groupBy("topic", "_id", "term").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    w = tf.join(df, "term").crossJoin(F.broadcast(total))  # total is one row
    s = w.groupBy("topic", "term").agg(F.sum(F.col("c") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("s"))
    r = s.join(n, "topic").select("topic", "term", (F.col("s") / F.col("members")).alias("weight"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term"))).filter(F.col("rank") <= top)
