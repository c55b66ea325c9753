import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe_tree as b

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = b.TreeCodec(PATH, P.PATTERN, leaf=7)


def test_whole_table(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in b.op9_bpe_tree(spark, sf).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé 'st12\n\t 　!?.漢\U0001f600-\x1c")), max_size=120))
def test_small_leaves_equal_the_library(text):
    ids = SMALL.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


def naive(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in RANKS:
        return (RANKS[piece],)
    while True:
        best = min(((RANKS.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return tuple(RANKS[x] for x in parts)
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70) | st.text(alphabet="abcdeinrst", min_size=1, max_size=70).map(str.encode), min_size=1, max_size=60))
def test_merging_by_rank(pieces):
    m = SMALL._merger
    want = [naive(x) for x in pieces]
    assert m.many(pieces) == want and [m.one(x) for x in pieces if x not in RANKS] == [w for x, w in zip(pieces, want) if x not in RANKS]


def test_patterns_must_cover():
    import pytest

    with pytest.raises(ValueError):
        b.TreeCodec(PATH, r"[a-z]+").encode("a b")


def test_long_texts_without_cuts():
    for text in ("a" * 30000, "ab c" * 9000, "\n" * 20000, "漢字" * 9000, " " * 9000 + "x"):
        got = b.codec(PATH, P.PATTERN).encode(text)
        assert got == PLAIN.encode_ordinary(text)
        assert b.codec(PATH, P.PATTERN).decode(got) == text.encode()


def test_edges(spark, make_docs):
    docs = make_docs([None, "", "<|endoftext|>", "x"]).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("y"))
    got = b.digest_documents(docs.union(docs)).collect()
    assert len(got) == 8 and [r.n_tokens for r in got][:2] == [0, 0]
    assert b.digest_documents(docs.limit(0)).count() == 0


def test_operators_agree_with_the_round_trip(spark, make_docs):
    docs = make_docs(["one two", None, "été " * 4000])
    path, pattern = PATH, P.PATTERN
    ids = {r.doc_id: list(r.ids) for r in b.encode_documents(docs, path, pattern).collect()}
    plain = {r.doc_id: bytes(r.decoded) for r in b.decode_documents(b.encode_documents(docs, path, pattern), path, pattern).collect()}
    for r in b.round_trip(docs, path, pattern).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id] and bytes(r.decoded) == plain[r.doc_id]
