"""SentencePiece encoding and decoding by a table of distinct chunks.

With the marker standing for a space, a text is a row of chunks: markers, then
other characters. Where no piece of the model has a marker after another
character (checked on the vocabulary), nothing is ever merged across a chunk's
start, so chunks can be segmented one by one.

A task keeps a table of the distinct chunks it has met, each with a number.
The texts of a batch become numbers first; the chunks new to the table are
segmented by the library in one call, each once, and decoded once; then ids,
their decimals and the decoded text are joined back by position. Rows never
leave their task: a table for the whole corpus would send every chunk of every
task through three exchanges to save segmenting it a second time (see README
for figures). The table is begun anew at TABLE_CHARS characters, so memory is
bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import docs_of, refuse, short_batches, struct_of

MARKER = "▁"
TABLE_CHARS = 16 << 20  # a table with so many characters of chunks is given up for a new one
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")


class Codec:
    """The library's processor and what chunks need of it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces) or self.lib.normalize("  Ａ b ") != f"{MARKER * 3}Ａ{MARKER}b{MARKER}":
            raise ValueError("chunks need a model whose pieces have markers at the front only, that adds one marker before a text and changes nothing else")
        self.one = [self.lib.piece_to_id(MARKER)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The library adds a marker in front, so it is given the chunk without its first."""
        return [x if len(c) > 1 else self.one for c, x in zip(chunks, self.lib.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def surface(self, ids: list[list[int]]) -> list[str]:
        """What chunks are decoded to, with the space that decode() takes from the front of a text."""
        return [" " + x for x in self.lib.decode(ids, num_threads=1)] if ids else []


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec of a model file."""
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; none if it is empty."""
    return _CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else []


class ChunkTable:
    """Distinct chunks by number, with their ids, the decimals of these and the decoded text."""

    def __init__(self, of: Codec):
        self.codec = of
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.decimals: list[str] = []
        self.surface: list[str] = []
        self.chars = 0

    def place(self, texts: list[str]) -> list[list[int]]:
        """The texts as numbers of chunks; chunks not yet there are added."""
        if self.chars > TABLE_CHARS:
            self.clear()
        numbers, known, out = self.numbers, len(self.numbers), []
        for text in texts:
            found = chunks_of(text)
            for c in found:
                if c not in numbers:
                    numbers[c] = len(numbers)
            out.append([numbers[c] for c in found])
        new = list(numbers)[known:] if known < len(numbers) else []
        ids = self.codec.segment(new)
        self.ids += ids
        self.decimals += [",".join(map(str, x)) for x in ids]
        self.surface += self.codec.surface(ids)
        self.chars += sum(map(len, new))
        return out


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PIECES = T.StructType([*struct_of("n_tokens long, ids_sha256 string, decoded_sha256 string").fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, model: str, full: bool = True) -> DataFrame:
    """docs without text, with the struct _pieces: n_tokens, ids_sha256, decoded_sha256, and if full the ids and the decoded text.

    The ids are those of the library's encode() of the whole text without begin
    and end ids, the decoded text is that of its decode() of these ids. Null
    text counts as empty; repeated rows all stay; an empty table stays empty; a
    text without spaces is one chunk however long. Columns _pieces and _text
    are refused, all others are kept whatever their names.
    """
    refuse(docs, "_pieces", "_text")
    short_batches(docs.sparkSession)
    codec(model)  # refuses an unfit model here rather than in tasks
    kept = [c for c in docs.columns if c != "text"]
    pieces = to_arrow_schema(T.StructType([T.StructField("_pieces", PIECES)])).field("_pieces").type

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(codec(model))
        for batch in batches:
            found = []
            for codes in table.place(batch.column("_text").to_pylist()):
                decoded = "".join([table.surface[c] for c in codes])[1:]
                ids = list(chain.from_iterable([table.ids[c] for c in codes])) if full else None
                n = sum([len(table.ids[c]) for c in codes])
                found.append({"n_tokens": n, "ids_sha256": _sha256(",".join([table.decimals[c] for c in codes])), "decoded_sha256": _sha256(decoded), "ids": ids, "decoded": decoded if full else None})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pieces)], [*kept, "_pieces"])

    rows = docs.select(*(docs[c] for c in kept), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(encoded, T.StructType([*rows.drop("_text").schema.fields, T.StructField("_pieces", PIECES)]))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 32k model and decoded again: number of ids, and checksums of both."""
    import public_tokenizers

    d = encode(docs_of(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
    return d.select("doc_id", "_pieces.n_tokens", "_pieces.ids_sha256", "_pieces.decoded_sha256")
