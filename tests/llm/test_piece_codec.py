"""Encoding by chunks against the library on whole texts."""

import hashlib
import random

import pytest

from socspan.llm import piece_codec as pc

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["the", " ", "  ", "\n", "\t", "▁", "é", "中文", "😀", "\x00", "�", "\xa0", "　", "<s>", "</s>", "<0x0A>", "ab", "ing", "12.5", "\r\n", "é", "ﬁ", "ａ"]


@pytest.fixture(scope="module")
def lib():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(12)
    out = [None, "", " ", "  ", "   ", "▁", "▁▁", " a", "a ", "a  b", "x▁y", "<unk>", "w" * 70_000, "again and " * 9_000]
    return out + ["".join(r.choices(BITS, k=r.randint(1, 40))) for _ in range(500)]


def test_against_library(spark, lib):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())] + [(3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, ids string, block int").repartition(3)
    out = pc.encode(df, MODEL)
    assert out.columns == ["doc_id", "ids", "block", "_pieces"]
    got = sorted(((r.doc_id, r._pieces.n_tokens, r._pieces.ids, r._pieces.decoded) for r in out.collect()), key=str)
    ids = [(i, lib.encode(t or "")) for i, t in rows]
    assert got == sorted(((i, len(x), x, lib.decode(x)) for i, x in ids), key=str)


def test_query(spark, lib, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, t in rows for x in [lib.encode(t or "")]}
    assert {r[0]: tuple(r[1:]) for r in pc.op12_piece_codec(spark, str(tmp_path)).collect()} == want


def test_each_chunk_is_segmented_once(lib, monkeypatch):
    table, asked = pc.ChunkTable(pc.codec(MODEL)), []
    monkeypatch.setattr(table.codec, "segment", lambda chunks, f=table.codec.segment: asked.extend(chunks) or f(chunks))
    for batch in (["a b a", "", "b c", "a  b"], ["c a", "d"]):
        for text, codes in zip(batch, table.place(batch), strict=True):
            assert [i for c in codes for i in table.ids[c]] == lib.encode(text)
    assert asked == ["▁a", "▁b", "▁c", "▁▁b", "▁d"]
    monkeypatch.setattr(pc, "TABLE_CHARS", 3)
    assert [table.ids[c] for c in table.place(["d"])[0]] == [lib.encode("d")] and len(table.numbers) == 1


def test_empty_and_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pc.encode(df, MODEL).count() == 0
    assert pc.encode(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), MODEL).select("_pieces.n_tokens").collect() == [(0,), (0,)]
    with pytest.raises(ValueError, match="_text"):
        pc.encode(df.withColumnRenamed("doc_id", "_text"), MODEL)


def test_unfit_model_is_refused(monkeypatch):
    c = pc.codec(MODEL)
    assert c.segment(["▁", "▁▁", "▁the"]) == [c.one, c.lib.encode(" "), c.lib.encode("the")]
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="markers"):
        pc.Codec(MODEL)
