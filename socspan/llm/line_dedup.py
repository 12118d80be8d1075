"""Removal of repeated runs of lines, by winnowing over line hashes.

A run counts from RUN lines on, or with more than LONG words (lines without a
word are passed over). Every least window of such a run selects the position of
its least line hash, so equal runs always share a selected position. Positions
are joined on that fingerprint; those that meet no other one go no further.
The rest are extended line by line to either side, as far as the windows that
selected them reach, and each extent looks up the earliest place with the same
lines. Extents that occur earlier are deleted; those that touch or overlap
make up the whole repeated run. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, refuse, written

RUN = 3  # lines from which a run counts
LONG = 50  # words beyond which shorter runs count as well

_LINES = """filter(transform(_split, (l, i) -> named_struct('i', i, 'h', xxhash64(l), 'g', xxhash64(1, l), 'n', regexp_count(l, '[^ \\\\t-\\\\r]+'))), x -> x.n > 0)"""
#: Each line with its neighbours that share a least window with it; at is its place among them, pos its place in the text.
_NEAR = f"""transform(sequence(0, size(_lines) - 1), p -> named_struct('pos', p, 'at', least(p, {RUN - 1}),
    'near', slice(_lines, greatest(p - {RUN - 1}, 0) + 1, least(p, {RUN - 1}) + {RUN})))"""
#: The windows l..r of neighbours that count and have their leftmost least hash at the line.
_EXTENTS = f"""filter(flatten(transform(sequence(0, x.at), l -> transform(sequence(x.at, least(l + {RUN - 1}, size(x.near) - 1)), r -> named_struct('l', l, 'r', r)))), w ->
    not exists(slice(x.near, w.l + 1, x.at - w.l), y -> y.h <= x.near[x.at].h) and not exists(slice(x.near, x.at + 2, w.r - x.at), y -> y.h < x.near[x.at].h)
    and (w.r - w.l = {RUN - 1} or aggregate(slice(x.near, w.l + 1, w.r - w.l + 1), 0, (s, y) -> s + y.n) > {LONG}))"""
_SELECTED = f"""filter(transform(_near, x -> named_struct('fingerprint', x.near[x.at].h, 'extents', transform({_EXTENTS}, w -> named_struct('start', x.pos - x.at + w.l, 'end', x.pos - x.at + w.r,
    'c', xxhash64(transform(slice(x.near, w.l + 1, w.r - w.l + 1), y -> y.h)), 'd', xxhash64(transform(slice(x.near, w.l + 1, w.r - w.l + 1), y -> y.g)))))), x -> size(x.extents) > 0)"""
_COVERED = "coalesce(array_sort(array_distinct(flatten(transform(_late, x -> sequence(x.start, x.end))))), cast(array() as array<int>))"
#: Numbers of the lines with a word, where some of these are deleted.
_WORDED = "if(_late is null, cast(array() as array<int>), transform(filter(transform(_split, (l, i) -> named_struct('i', i, 'worded', l rlike '[^ \\\\t-\\\\r]')), x -> x.worded), x -> x.i))"
_GONE = "transform(_covered, k -> _worded[k])"
_RUNS = "aggregate(_covered, named_struct('n', 0L, 'last', -2), (a, k) -> named_struct('n', a.n + if(k > a.last + 1, 1L, 0L), 'last', k), a -> a.n)"
#: The stretches between deleted lines.
_KEPT = """array_join(flatten(transform(sequence(0, size(_gone)), k -> slice(_split, if(k = 0, 0, _gone[k - 1] + 1) + 1,
    if(k = size(_gone), size(_split), _gone[k]) - if(k = 0, 0, _gone[k - 1] + 1)))), '\\n')"""


_RESERVED = ["_id", "_hash", "_text", "_split", "_late_id", "_late_hash", "_late", "_covered", "_worded", "_gone", "_dedup"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64(text), "_text": text})


def _split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_split", F.split("_text", "\n"))


def selected_positions(docs: DataFrame) -> DataFrame:
    """(fingerprint, _id, _hash, extents): each position that is the least of a window, once, with the windows that selected it."""
    lines = _split(_keyed(docs.select("doc_id", "text"))).withColumn("_lines", F.expr(_LINES))
    near = lines.filter(F.size("_lines") > 0).select("_id", "_hash", F.expr(_NEAR).alias("_near"))
    return near.select("_id", "_hash", F.expr(f"inline({_SELECTED})"))


def repeated_extents(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _late): of each row of docs the extents (start, end) that occur earlier, by the numbers of their lines.

    Earlier is a smaller doc_id (null is the smallest; equal ones go by a hash
    of the text), or an earlier line of the same text. Lines are equal if two
    64-bit hashes of theirs are. Selected positions are written to a table of
    the shared folder first, as they are read by the count and by the join.
    """
    positions = written(selected_positions(docs), "line-positions")
    shared = positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = positions.join(shared, "fingerprint", "left_semi").select("_id", "_hash", F.inline("extents"))
    first = rows.groupBy("c", "d").agg(F.min(F.struct("_id", "_hash", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    late = rows.join(first, ["c", "d"]).filter(F.struct("_id", "_hash", "start") != F.col("first"))
    return late.groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "end")).alias("_late"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the struct _dedup: n_lines, n_removed (lines), n_runs (deleted runs) and text (what is left).

    Rows that repeat a doc_id and its text are the same occurrence: neither is
    the later one. Null text counts as empty; texts without a run that counts
    stay as they are; an empty table stays empty. Columns of docs may have any
    name but those added on the way (_RESERVED), which are refused.
    """
    refuse(docs, *_RESERVED)
    late = repeated_extents(docs).withColumnsRenamed({"_id": "_late_id", "_hash": "_late_hash"})
    rows = _keyed(docs).join(late, F.col("_id").eqNullSafe(F.col("_late_id")) & (F.col("_hash") == F.col("_late_hash")), "left")
    rows = _split(rows).withColumns({"_covered": F.expr(_COVERED), "_worded": F.expr(_WORDED)}).withColumn("_gone", F.expr(_GONE))
    facts = F.struct(F.size("_split").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"), F.expr(_RUNS).alias("n_runs"), F.expr(_KEPT).alias("text"))
    return rows.select(*(docs[c] for c in docs.columns), facts.alias("_dedup"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, removed lines and runs, and the checksum of what is left."""
    d = dedup_lines(docs_of(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "_dedup.n_lines", "_dedup.n_removed", "_dedup.n_runs", F.md5("_dedup.text").alias("kept_md5"))


OP9_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
w as (select *, row_number() over (partition by doc_id order by i) as r from (select doc_id, i, line, len(regexp_extract_all(line, '[^ \\t-\\r]+')) as n from l) where n > 0),
three as (select doc_id, r, line, n, lead(line, 1) over v as line2, lead(n, 1) over v as n2, lead(line, 2) over v as line3 from w window v as (partition by doc_id order by r)),
g as (
    select doc_id, r, r as e, line as run from three where n > {LONG}
    union all select doc_id, r, r + 1, line || chr(10) || line2 from three where n + n2 > {LONG}
    union all select doc_id, r, r + 2, line || chr(10) || line2 || chr(10) || line3 from three where line3 is not null),
late as (select doc_id, r, e from (select doc_id, r, e, row_number() over (partition by run order by doc_id, r) as k from g) where k > 1),
gone as (select distinct w.doc_id, w.i, w.r from w join late on w.doc_id = late.doc_id and w.r between late.r and late.e),
runs as (select doc_id, count(*) as n, count(*) filter (where p is distinct from r - 1) as n_runs from (select doc_id, r, lag(r) over (partition by doc_id order by r) as p from gone) group by 1),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i where gone.i is null group by 1)
select d.doc_id, cast(len(d.ls) as bigint) as n_lines, cast(coalesce(runs.n, 0) as bigint) as n_removed, cast(coalesce(runs.n_runs, 0) as bigint) as n_runs, md5(coalesce(kept.text, '')) as kept_md5
from d left join runs on d.doc_id = runs.doc_id left join kept on d.doc_id = kept.doc_id
"""
