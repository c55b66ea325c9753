import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import cm_coder as c
from docloom.llm import token_files as t

PATH = P.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def brute(docs):
    out, start = [], 0
    for d, text in docs:
        ids = [*TOK.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in t.op8_token_files(spark, sf).collect())
    assert got == brute(docs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abé 'st1\n\t !.漢\x1c　 \u0085", "<|endoftext|>"]), max_size=60).map("".join), st.text(max_size=9))
def test_remembered_stretches_equal_the_library(text, more):
    texts = [text, more, "", text + more]
    raw = [x.encode() for x in texts]
    off = np.cumsum([0, *map(len, raw)])
    ids, bound = t._encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == [TOK.encode(x, add_special_tokens=False).ids for x in texts]


class Counted:
    """The library, counting the texts that it gets."""

    def __init__(self, tok):
        self.tok, self.texts = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tok.encode_batch_fast(texts, **how)


def buffers(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_new_stretches_are_encoded_together():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("aeinorstéß漢\x85", k=rnd.randrange(1, 12)))
    texts = [rnd.choice([" ", "", "\n"]).join(word() + rnd.choice(["", ",", " \u3000", "<|endoftext|>", "'s "]) for _ in range(300)) for _ in range(40)]
    texts[7:7] = [" ".join(word() for _ in range(40000)), "", " ", "x"]
    enc = t.TextEncoder(PATH)
    enc._t = Counted(enc._t)
    for run in (texts[:9], texts[9:], texts):
        ids, bound = enc.encode(*buffers(run))
        assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [TOK.encode(x, add_special_tokens=False).ids for x in run]
    assert enc._t.texts < len(enc._known) / 5  # each by itself before


def test_tokens_of_unknown_length():
    enc = t.TextEncoder(PATH)
    enc._bytes[:] = 1
    text = "one two three, four\nfive"
    ids, _ = enc.encode(*buffers([text]))
    assert ids.tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_coded_blocks_stay_as_they_are():
    rnd = np.random.default_rng(4)
    blocks = [rnd.integers(0, 1 << k, n) for k in (1, 3, 9, 16, 30) for n in (0, 1, 17, 700, 2048)] + [np.tile(rnd.integers(0, 50257, 60), 30)]
    coded = c.encode(blocks)
    assert zlib.crc32(b"".join(coded)) == 2826739524
    assert [x.tolist() for x in c.decode(coded)] == [x.tolist() for x in blocks]


def test_no_small_rests(monkeypatch):
    monkeypatch.setattr(t, "LANES", 64)
    together = []
    for name in ("encode", "decode"):
        monkeypatch.setattr(c, name, lambda blocks, own=getattr(c, name): together.append(len(blocks)) or own(blocks))
    for n in (1, 64, 67, 72, 73, 200):
        ids = np.arange(2048 * n - 5) % 50257
        (row,) = list(t._flush([([7, 9], [ids[:100], ids[100:]])], 3, 11))
        (got,) = list(t._documents(row.to_pylist(), {3: 1000}))
        assert b"".join(got["ids"].to_pylist()) == ids.astype("<u4").tobytes() and got["start"].to_pylist() == [1011, 1111]
    assert together == [1, 1, 64, 64, 67, 67, 72, 72, 36, 37, 36, 37, 66, 67, 67, 66, 67, 67]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 7, 300, 50256, 65535, 1 << 30]), max_size=200), max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    got = c.decode(c.encode(blocks))
    assert [x.tolist() for x in got] == [x.tolist() for x in blocks]


def test_coder_compresses_and_checks():
    rnd = random.Random(5)
    repeated = np.array([rnd.randrange(1000) for _ in range(64)] * 32)
    spread = np.array([rnd.randrange(50257) for _ in range(2048)])
    coded = c.encode([repeated, spread, repeated[:100], repeated[:0]])
    assert len(coded[0]) < 2048 / 2 and len(coded[1]) < 2048 * 3
    bad = bytearray(coded[1])
    bad[-9] ^= 5
    with pytest.raises(ValueError):
        c.decode([coded[0], bytes(bad)])
    with pytest.raises(ValueError):
        c.decode([coded[0][:-2]])


def test_edges(spark, make_docs):
    texts = {5: "b c", 3: None, 4: "", 9: "x " * 70000, 10: "hello <|endoftext|> world"}
    docs = make_docs(texts).withColumn("start", F.lit(1)).withColumn("part", F.lit("p"))
    rows = sorted((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in t.read_token_files(t.write_token_files(docs, PATH, 2)).collect())
    assert rows == brute(sorted(texts.items()))
    twice = t.read_token_files(t.write_token_files(docs.union(docs), PATH, 2)).collect()
    assert sorted(r.start for r in twice) == [x[1] for x in brute(sorted([*texts.items()] * 2, key=lambda x: x[0]))]
    assert t.read_token_files(t.write_token_files(docs.limit(0), PATH, 2)).count() == 0
