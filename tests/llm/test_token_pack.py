import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from socspan.llm import token_pack as tp

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80))
def test_pack_round_trip(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], "<u4")
    data = tp.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert (tp.unpack(data, bits, len(ids)) == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's\n\t.,1é ñ  \x00<|!"), max_size=40))
def test_encode_equals_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for x in (text, f"a{text}. <|endoftext|> b"):
        assert tp.encode([x], PATH)[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tp, "CACHE_WORDS", 10)
    t = Tokenizer.from_file(PATH)
    for i in range(30):
        text = f"word{i % 7}, common {i % 3}st don't. l'été! {i}"
        assert tp.encode([text], PATH)[0].tolist() == t.encode(text, add_special_tokens=False).ids


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("rows", [
    [],
    [(None, None)],
    [(3, "b c"), (1, None), (2, ""), (1, None), (None, "x  <|endoftext|>y"), (2**60 + 1, "big"), (4, "word " * 30_000)],
    [(i, f"text {i} and some more of it, é") for i in range(300)],
])
def test_written_and_read_back(spark, rows):
    df = spark.createDataFrame([(d, x, "q", 1) for d, x in rows], "doc_id long, text string, start string, bits int")
    got = tp.read_tokens(tp.write_tokens(df, PATH)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_random_access(tmp_path):
    ids = np.arange(100_000) % 50_257
    with open(tmp_path / "s", "wb") as f:
        w = tp.ShardWriter(f, 16)
        for i in range(0, len(ids), 777):
            w.add(i, ids[i : i + 777].astype("<u4"))
        w.close()
    fs, name = tp.file_at(str(tmp_path / "s"))
    with fs.open_input_file(name) as f:
        r = tp.ShardReader(f)
        assert (r.ids(50_001, 70_007) == ids[50_001:70_007]).all()
        assert len(r.ids(5, 5)) == 0 and r.n_ids == 100_000


def test_an_idle_worker_forgets_its_words(spark, tmp_path):
    def held(batches):
        import time

        time.sleep(tp.IDLE_S + 1)
        for pdf in batches:
            yield pd.DataFrame({"n": [len(tp._WORDS)] * len(pdf)})

    docs = spark.createDataFrame([(i, f"word{i} of a text") for i in range(40)], "doc_id long, text string")
    tp.write_tokens(docs, PATH, folder=str(tmp_path / "tokens")).count()
    assert {r.n for r in spark.range(0, 16, 1, 16).mapInPandas(held, "n long").collect()} == {0}
    first = tp.encode(["some words"], PATH)[0]
    tp._forget_later()
    assert (tp.encode(["some words"], PATH)[0] == first).all()
    assert not tp._IDLE and tp._WORDS  # work that goes on keeps them
