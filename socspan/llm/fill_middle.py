"""Fill-in-middle: texts cut in prefix, middle and suffix, and put in prefix-suffix-middle or suffix-prefix-middle order.

Cuts fall between units, lines or code points, and are carried out on the
UTF-8 bytes of a whole Arrow batch. Code points and bytes differ only after
characters of several bytes, so the batch gets a sparse index of these: where
each starts, and how many excess bytes there are up to it. searchsorted on
that index converts a cut in either direction; over ASCII the two numbers are
the same but for a constant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, refuse, short_batches, struct_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = PREFIX, SUFFIX, MIDDLE
SEED = 7
RATE = 100  # of 100 texts are transformed
SPM = 50  # of 100 of these in suffix-prefix-middle order

FOUND = "n long, form string, prefix_chars long, middle_chars long, output string"


class Index:
    """The characters of several bytes in a stretch of UTF-8: their first bytes and the excess bytes before each."""

    def __init__(self, octets: np.ndarray):
        self.at = np.flatnonzero(octets >= 0xC0)
        lead = octets[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before these bytes, each the first of a character or the end."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def octets(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before these code points."""
        return chars + self.excess[np.searchsorted(self.at - self.excess[:-1], chars)]


def _draws(doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def _forms(rate: int, spm: int, unit: str):
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_fim_text").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
            data, index = memoryview(octets), Index(octets)
            starts, ends = offsets[:-1], offsets[1:]
            first = index.chars(starts)  # code points of the batch before each text
            if unit == "line":
                breaks = np.flatnonzero(octets == 10) + 1
                before = np.searchsorted(breaks, starts, "right")
                within = np.searchsorted(breaks, ends, "right") - before
                open_end = (ends > starts) & (octets[np.maximum(ends, 1) - 1] != 10) if len(octets) else np.zeros(len(ends), bool)
                n = within + open_end
            else:
                n = index.chars(ends) - first
            draws = np.array([_draws(d) for d in batch.column("_fim_id").to_pylist()], np.int64).reshape(-1, 4)
            cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            if unit == "line":
                ordinal = before[:, None] + cuts - 1
                at = np.where(cuts == 0, starts[:, None], np.where(cuts > within[:, None], ends[:, None], breaks[np.minimum(ordinal, len(breaks) - 1)] if len(breaks) else 0))
            else:
                at = index.octets(first[:, None] + cuts)
            chars = index.chars(at)
            form, outputs = [], []
            for i, (a, b, (p, m)) in enumerate(zip(starts.tolist(), ends.tolist(), at.tolist(), strict=True)):
                text = bytes(data[a:b])
                if not text or any(x.encode() in text for x in MARKS) or draws[i, 2] % 100 >= rate:
                    form.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = bytes(data[a:p]), bytes(data[p:m]), bytes(data[m:b])
                swapped = draws[i, 3] % 100 < spm
                form.append("spm" if swapped else "psm")
                outputs.append(b"".join((b"<S>", suffix, b"<P>", prefix) if swapped else (b"<P>", prefix, b"<S>", suffix)) + b"<M>" + middle)
            plain = np.array([f == "plain" for f in form], bool)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("_fim_text", "_fim_id")}
            found = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(chars[:, 0] - first, pa.int64(), mask=plain), pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), pa.array(outputs, pa.binary()).view(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])
            yield pa.RecordBatch.from_arrays([*columns.values(), found], [*columns, "_fim"])

    return transform


def fill_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, unit: str = "line") -> DataFrame:
    """docs with the struct _fim: n (units), form, prefix_chars, middle_chars and output.

    Cuts and form are drawn from a hash of SEED and doc_id, so repeated runs
    and repeated rows agree; a null doc_id draws as an empty one. A text that
    is null (counted as empty), empty, holds a mark, or isn't among the `rate`
    of a hundred stays plain, without prefix and middle. Rows are independent:
    no shuffle, an empty table stays empty, and a long text is held once with
    its output. Columns _fim, _fim_text and _fim_id are refused, all other
    columns are kept whatever their names.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    refuse(docs, "_fim", "_fim_text", "_fim_id")
    short_batches(docs.sparkSession)
    rows = docs.withColumns({"_fim_text": F.coalesce("text", F.lit("")), "_fim_id": F.col("doc_id").cast("long")})
    return rows.mapInArrow(_forms(rate, spm, unit), T.StructType([*docs.schema.fields, T.StructField("_fim", struct_of(FOUND))]))


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. Marks end at their first place, since no text with marks is cut."""
    s, m, p = (F.instr(output, x) for x in (SUFFIX, MIDDLE, PREFIX))
    piece = lambda a, b: F.substring(output, a, b - a)
    end = F.char_length(output) + 1
    psm = F.concat(piece(F.lit(4), s), piece(m + 3, end), piece(s + 3, m))
    spm = F.concat(piece(p + 3, m), piece(m + 3, end), piece(F.lit(4), p))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines: form, cuts, and the checksums of the output and of the text restored from it."""
    d = fill_middle(docs_of(spark, sf_dir).select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", sha(F.col("_fim.output")).alias("output_sha256"), sha(restore(F.col("_fim.output"), F.col("_fim.form"))).alias("restored_sha256"))


OP13_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
h as (select doc_id, t, string_split(t, chr(10)) as ls, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
n as (select *, len(ls) - if(ls[-1] = '', 1, 0) as n from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as c1, greatest(h1 % (n + 1), h2 % (n + 1)) as c2,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(ls[1:c1], chr(10)) || if(c1 > 0 and c1 < len(ls), chr(10), '') as prefix, array_to_string(ls[1:c2], chr(10)) || if(c2 > 0 and c2 < len(ls), chr(10), '') as through from c),
m as (select *, substr(through, length(prefix) + 1) as middle, substr(t, length(through) + 1) as suffix from p)
select doc_id, cast(n as bigint) as n, form, if(form = 'plain', null, length(prefix)) as prefix_chars, if(form = 'plain', null, length(middle)) as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256, sha256(t) as restored_sha256
from m
"""
