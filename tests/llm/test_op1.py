import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import media, vp8l, vp8l_batch


def image(seed, h, w, colours=256, alpha=True):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, colours, (h, w, 4)).astype(np.uint8) * np.uint8(200 // colours if 1 < colours < 256 else 1)
    if not alpha:
        px[..., 3] = 255
    return px


def blocks(h, w, bits):
    return (h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = image(mode, 9, 11, 8)
    got = vp8l.decode(vp8l.encode(px, predictor=np.full(blocks(9, 11, 2), mode)))
    assert (got == px).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 12), st.integers(1, 20), st.sampled_from([1, 2, 3, 4, 8, 256]), st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.integers(0, 7), st.booleans())
def test_all_features_round_trip(seed, h, w, colours, alpha, palette, green, cross, predictor, cache, lz):
    rng = np.random.default_rng(seed)
    px = image(seed, h, w, colours, alpha)
    bh, bw = blocks(h, w, 2)
    palette = palette and len(np.unique(px.reshape(-1, 4), axis=0)) <= 256
    options = {"palette": palette, "cache_bits": cache, "lz": lz}
    if not palette:
        options |= {
            "subtract_green": green,
            "cross": rng.integers(-128, 128, (bh, bw, 3)) if cross else None,
            "predictor": rng.integers(0, 14, (bh, bw)) if predictor else None,
            "meta": rng.permutation(np.arange(bh * bw) % 3).reshape(bh, bw) if seed % 2 and bh * bw > 2 else None,
        }
    data = vp8l.encode(px, **options)
    assert (vp8l_batch.decode_many([data])[0] == px).all()


def test_back_references_of_every_near_code():
    rng = np.random.default_rng(3)
    px = image(1, 40, 30)
    flat = px.reshape(-1, 4)
    for i in range(300, 1150, 7):
        d = int(rng.integers(1, 280))
        flat[i : i + 6] = flat[i - d : i - d + 6].copy()
    assert (vp8l.decode(vp8l.encode(px)) == px).all()


def test_prefix_codes_are_complete_and_limited():
    counts = np.array([1 << min(k, 40) for k in range(60)])
    lengths = vp8l.code_lengths(counts, 10)
    assert lengths.max() <= 10 and sum(2.0 ** -int(x) for x in lengths) == 1
    with pytest.raises(ValueError):
        vp8l.decode_table(np.array([1, 2, 0]))
    with pytest.raises(ValueError):
        vp8l.decode(b"RIFF....WEBPVP8X" + b"\0" * 30)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def brute(docs):
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        out[d] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    return out


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = media.op1_webp(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == brute(docs)
    assert sum(r.media_bytes for r in got) < 0.8 * sum(r.payload_bytes for r in got)


def test_edges(spark, make_docs):
    texts = [None, "", "a", "same " * 3000, "é漢\U0001f600" * 400, "x" * 3_200_000 + "tail", " " * 192, "b" * 193]
    docs = make_docs(texts).withColumn("media", F.lit("m")).withColumn("payload", F.lit(1))
    got = media.load_documents(media.store_documents(docs)).collect()
    want = brute(list(enumerate(texts)))
    assert {r.doc_id: (r.n_bytes, len(r.payload), hashlib.sha256(r.payload).hexdigest(), zlib.crc32(r.payload[-16:])) for r in got} == want
    assert media.load_documents(media.store_documents(docs.limit(0))).count() == 0
    by_text = {}
    for r in media.load_documents(media.store_documents(docs.union(docs))).collect():
        assert by_text.setdefault(r.doc_id, (r.media, r.feature)) == (r.media, r.feature)


def crafted():
    """Payloads for which each transform is the best one, and mixtures."""
    rng = np.random.default_rng(8)
    h = 60
    noise = lambda n: rng.integers(0, n, (h, 64, 3))
    grey = rng.integers(0, 256, (h, 64, 1))
    ramp = np.cumsum(noise(3), axis=1)
    slope = np.cumsum(noise(3), axis=0)
    signed = grey.astype(np.uint8).view(np.int8).astype(np.int64)
    bent = np.concatenate([signed * 50 >> 5, signed, signed * -20 >> 5], axis=2)
    words = np.frombuffer(b"the same line of words again and again, " * 400, np.uint8)[: 192 * h].reshape(h, 64, 3)
    few = rng.integers(0, 200, (40, 3))[rng.integers(0, 40, (h, 64))]
    return {"green": grey + noise(2), "left": ramp, "top": slope, "cross": bent, "words": words, "few": few, "noise": noise(256), "one": noise(1)}


def test_every_transform_is_chosen_and_both_decoders_agree():
    forms = {k: (v & 255).astype(np.uint8).reshape(-1) for k, v in crafted().items()}
    forms["short"] = np.full(192, 32, np.uint8)
    forms["long"] = np.concatenate([forms["words"], forms["left"], forms["noise"]] * 3)
    files = vp8l_batch.encode_many(list(forms.values()), 64)
    many = vp8l_batch.decode_many(files * 40)
    for k, (name, p) in enumerate(forms.items()):
        for px in (vp8l.decode(files[k]), many[k], many[k + len(files)]):
            assert (px[..., :3].reshape(-1) == p).all() and (px[..., 3] == 255).all(), name
    kinds = {name: [u[0] for u in vp8l_batch._opened(f)[5]] for name, f in zip(forms, files)}
    modes = {name: int(vp8l_batch._opened(f)[5][0][1][0, 0, 1]) for name, f in zip(forms, files) if kinds[name] == [0]}
    assert kinds["green"] == [2] and kinds["cross"] == [1] and modes["left"] == 1 and modes["top"] == 2 and kinds["noise"] == []
    assert vp8l_batch._opened(files[list(forms).index("few")])[7] and len(files[list(forms).index("words")]) < 1500


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900) | st.text(alphabet="ab \n", max_size=900).map(str.encode), min_size=1, max_size=40))
def test_batches_round_trip(texts):
    payloads = [media._payload_of(np.frombuffer(t, np.uint8)) for t in texts]
    stored = media.store(payloads)
    for images, p, m in zip(media.load(stored), payloads, stored):
        assert (np.concatenate([x[..., :3].reshape(-1) for x in images]) == p).all()
        assert (np.concatenate([vp8l.decode(f)[..., :3].reshape(-1) for f in media.split_files(m)]) == p).all()


def test_code_lengths_are_complete():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(0.4, (200, 344)) * rng.integers(0, 2, (200, 344))).astype(np.int64)
    counts[:5] = 0
    counts[1, 7] = 3
    counts[2, [3, 340]] = 1, 10**9
    lengths = vp8l_batch.complete_lengths(counts)
    for c, x in zip(counts, lengths):
        assert ((x > 0) == (c > 0)).all() and x.max() <= vp8l_batch.BITS
        assert np.count_nonzero(c) < 2 or (2.0 ** -x[x > 0]).sum() == 1


def test_damaged_files_are_refused_or_read():
    files = media.store([media._payload_of(np.frombuffer(b"some words and more words " * 60, np.uint8))])
    rng = np.random.default_rng(1)
    for _ in range(60):
        bad = bytearray(files[0])
        bad[int(rng.integers(20, len(bad)))] ^= int(rng.integers(1, 256))
        try:
            vp8l_batch.decode_many([bytes(bad)] * 30)
        except (ValueError, IndexError):
            pass
