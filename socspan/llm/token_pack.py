"""Token-ID output: fixed-width bit packing with block offsets.

A shard file holds the ids of consecutive documents, each id in the fewest
bits that hold the vocabulary, in blocks of BLOCK_IDS ids:

    "BITPACK1"                                   8 bytes
    blocks, each a whole number of bytes         little-endian bit order
    block offsets   n_blocks + 1 x u64           byte position of each block
    document ids    n_docs x i64
    id is there     n_docs x u8                  0 where doc_id is null
    document starts n_docs + 1 x u64             in ids, within the shard
    trailer         bits, n_blocks, n_docs, n_ids, footer position: 5 x u64, "BITPACK1"

Any range of ids is read by two look-ups in the block offsets and unpacked by
numpy as a whole.

A task writes its shard under a name of its own attempt and returns one
manifest row; Spark commits the manifest. Files of failed or repeated attempts
are in no manifest, so losing executors never adds or loses ids.
"""

from __future__ import annotations

import os
import re
import threading
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_at, shared_dir, short_batches, written

MAGIC = b"BITPACK1"
BLOCK_IDS = 16384  # a multiple of 8, so that every block ends on a byte
SPAN_IDS = 1 << 20  # ids unpacked at once when a shard is read through
ENCODE_CHARS = 1 << 20  # about as many characters are encoded at once
CACHE_WORDS = 1_800_000  # memory bound of the words whose ids a worker remembers
IDLE_S = 3  # seconds without token work after which a worker forgets them

MANIFEST = "shard long, path string, n_docs long, n_ids long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of bits-wide little-endian numbers, filled up to a byte."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of pack()'s output."""
    raw = np.frombuffer(data, np.uint8)
    octets = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        octets[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        flat = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits)
        octets[:, : (bits + 7) // 8] = np.packbits(flat, axis=1, bitorder="little")
    return octets.view("<u4").ravel()


class ShardWriter:
    """Appends documents to a shard; holds one unfinished block and the document index."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.n_rest = self.n_ids = 0
        self.blocks, self.docs, self.there, self.starts = [self.at], [], [], [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.there.append(doc_id is not None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= 16 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        data = pack(ids[:end], self.bits)
        self.out.write(data)
        step = BLOCK_IDS * self.bits // 8
        self.blocks += [self.at + min(i + step, len(data)) for i in range(0, len(data), step)]
        self.at += len(data)
        self.rest, self.n_rest = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.blocks, "<u8"), (self.docs, "<i8"), (self.there, "u1"), (self.starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(np.array([self.bits, len(self.blocks) - 1, len(self.docs), self.n_ids, self.at], "<u8").tobytes() + MAGIC)


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        tail = f.read_at(40 + len(MAGIC), size - 40 - len(MAGIC))
        if tail[40:] != MAGIC:
            raise ValueError("not a shard file, or cut short")
        self.bits, n_blocks, self.n_docs, self.n_ids, at = map(int, np.frombuffer(tail[:40], "<u8"))
        foot = f.read_at(size - at - len(tail), at)
        cut = np.cumsum([0, 8 * (n_blocks + 1), 8 * self.n_docs, self.n_docs, 8 * (self.n_docs + 1)])
        parts = [foot[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.blocks, self.docs, self.there, self.starts = (np.frombuffer(p, k) for p, k in zip(parts, ("<u8", "<i8", "u1", "<u8"), strict=True))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard; only their blocks are read."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS + 1
        at = int(self.blocks[first])
        data = self.f.read_at(int(self.blocks[last]) - at, at)
        n = min(last * BLOCK_IDS, self.n_ids) - first * BLOCK_IDS
        return unpack(data, self.bits, n)[start - first * BLOCK_IDS : end - first * BLOCK_IDS]


#: White space other than space and line ends, in which Python and the tokenizer may differ.
_RARE_SPACE = re.compile("[\x00\t\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(text: str) -> bool:
    """Whether each space stands alone between two words, so that words can be encoded one by one."""
    return not ("  " in text or "\n " in text or " \n" in text or text.startswith(" ") or text.endswith(" ") or _RARE_SPACE.search(text))


#: Marks that follow a word directly. After letters each is a stretch of its own.
_MARKS = frozenset(".,;:!?")


class _Words(dict):
    """The ids of words as bytes; a word that isn't there yet is encoded when it is looked up.

    Words are remembered in two generations of half of CACHE_WORDS each:
    common words move to the younger one, rare ones are forgotten with the
    older.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or "(?!)")
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # The letters that byte-level models show bytes as: printable bytes as themselves, the others from 256 up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.letters[32])
        self.older: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of a stretch within which the model may merge: its bytes, shown as the model's letters."""
        if part.isascii() and part.isprintable():
            letters = part.replace(" ", self.space)
        else:
            letters = part.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if (word[1:] or word).isalpha() and (word[0] == " " or word[0].isalpha()):
                ids = self._part(word)
            elif len(word) > 2 and word[-1] in _MARKS and word[1:-1].isalpha():
                ids = self[word[:-1]] + self[word[-1]]
            else:
                parts = self.split(word)
                ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self._part(word) if word else b""
        self[word] = ids
        return ids

    def age(self) -> None:
        """Make room for new words, if need be."""
        if len(self) > CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()

    def encode(self, text: str) -> np.ndarray:
        if _plain(text) and not self.special.search(text):
            return np.frombuffer(b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00"))), "<u4")
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


_WORDS: dict[str, _Words] = {}
_IDLE: list[threading.Timer] = []


def _forget_later() -> None:
    """Words and model go after IDLE_S, unless a next task asks for them: the worker lives on for other work."""
    _IDLE.append(timer := threading.Timer(IDLE_S, _WORDS.clear))
    timer.daemon = True
    timer.start()


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts, as the tokenizers library gives them.

    A byte-level BPE never merges over a single space between two words, so a
    text is cut there and the library's model encodes each distinct word once;
    texts with other spacing, or with the string of a special token, go to the
    library whole.
    """
    while _IDLE:
        _IDLE.pop().cancel()
    words = _WORDS.get(path) or _WORDS.setdefault(path, _Words(path))
    words.age()
    return [words.encode(t) for t in texts]


def _writer(folder: str, path: str, bits: int, end_id: int):
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, to, out, w = TaskContext.get().partitionId(), "", None, None
        for pdf in batches:
            if out is None:
                to = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bits"
                fs, name = file_at(to)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(name)
                w = ShardWriter(out, bits)
            ids = [d if there else None for d, there in zip(pdf["doc_id"].tolist(), pdf["there"].tolist(), strict=True)]
            texts = pdf["text"].tolist()
            i = 0
            while i < len(texts):
                j, chars = i + 1, len(texts[i])
                while j < len(texts) and chars < ENCODE_CHARS:
                    chars += len(texts[j])
                    j += 1
                for d, x in zip(ids[i:j], encode(texts[i:j], path), strict=True):
                    w.add(d, np.concatenate([x, end]))
                i = j
        if out is not None:
            w.close()
            out.close()
            _forget_later()
            yield pd.DataFrame({"shard": [shard], "path": [to], "n_docs": [len(w.docs)], "n_ids": [w.n_ids]})

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode the text of every row and write shards in ascending doc_id order; returns the manifest.

    tokenizer is the path of a byte-level BPE file of the tokenizers library,
    at the same place on every machine. A null text counts as empty, a null
    doc_id sorts first, equal doc_ids sort by a hash of the text. An empty table gives an
    empty manifest. Columns other than doc_id and text are not looked at.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    short_batches(spark)
    bits = max(1, (Tokenizer.from_file(tokenizer).get_vocab_size() - 1).bit_length())
    folder = folder or shared_dir(spark, "tokens")
    key = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key.isNotNull().alias("there"), F.coalesce(key, F.lit(0)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("there", "doc_id", "tie").sortWithinPartitions("there", "doc_id", "tie")
    return written(rows.mapInPandas(_writer(folder, tokenizer, bits, end_id), MANIFEST), "token-manifest")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, base in zip(pdf["path"], pdf["base"], strict=True):
            fs, name = file_at(path)
            with fs.open_input_file(name) as f:
                r = ShardReader(f)
                starts, crc = r.starts.astype(np.int64), [0] * r.n_docs
                d = 0
                for a in range(0, r.n_ids, SPAN_IDS):
                    b = min(a + SPAN_IDS, r.n_ids)
                    ids = r.ids(a, b)
                    while d < r.n_docs:
                        lo, hi = max(a, int(starts[d])), min(b, int(starts[d + 1]))
                        crc[d] = zlib.crc32(ids[lo - a : hi - a].tobytes(), crc[d])
                        if starts[d + 1] > b:
                            break
                        d += 1
                for i in range(0, r.n_docs, 50_000):
                    j = min(i + 50_000, r.n_docs)
                    ids_col = pd.array(r.docs[i:j], dtype="Int64")
                    ids_col[r.there[i:j] == 0] = pd.NA
                    yield pd.DataFrame({"doc_id": ids_col, "start": base + starts[i:j], "n_tokens": np.diff(starts[i : j + 1]), "ids_crc32": np.array(crc[i:j], np.int64), "bits": np.int32(r.bits), "shard_path": path})


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: place, length and checksum of the ids that the files hold.

    start counts the ids of all documents before it. The window that adds up
    the shards runs over one row a shard, not over documents.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.withColumn("base", before).select("path", "base").repartition(n, "path")
    return spread.mapInPandas(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long, bits int, shard_path string")


def op1_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written with the 50k byte-level BPE and end id 0, then read back."""
    import public_tokenizers

    from .common import docs_of

    return read_tokens(write_tokens(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
