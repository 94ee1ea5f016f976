import hashlib
import random
import zlib

from gridloom.llm.media import BLOCK, LEAST, MOST, chunks_of, feature_of, from_media, gear_hashes, payload_of, store_and_read, to_media

import numpy as np


def test_chunks_put_together_and_follow_content():
    rng = random.Random(1)
    body = rng.randbytes(300_000)
    parts = chunks_of(body)
    assert b"".join(parts) == body and max(map(len, parts)) <= MOST and min(map(len, parts[:-1])) >= LEAST
    moved = chunks_of(b"xyz" * 100 + body)
    assert len(set(parts) & set(moved)) > 0.8 * len(parts)
    for n in (0, 1, LEAST, LEAST + 1, MOST, MOST + 1, 3 * MOST):
        assert b"".join(chunks_of(b"a" * n)) == b"a" * n


def test_gear_hash_is_the_rolling_one():
    from gridloom.llm.media import _GEAR

    data, h = random.Random(2).randbytes(500), 0
    got = gear_hashes(np.frombuffer(data, np.uint8))
    for k, b in enumerate(data):
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFFFFFF
        assert got[k] == h


def test_store_and_read_against_brute_force(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé \n") for _ in range(200_000))
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, long, long + "tail", long, "\0"]
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in store_and_read(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        payload = payload_of((text or "").encode())
        media = to_media(payload)
        assert from_media(media) == payload and len(payload) % BLOCK == 0 and payload
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len((text or "").encode()), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and bytes(r.media) == hashlib.sha256(media).digest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature == feature_of(payload)
    assert store_and_read(docs.limit(0)).count() == 0
