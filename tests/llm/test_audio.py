import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from quillspark.llm import audio


def test_wav_round_trip():
    for n in (192, 384, 193):
        data = bytes(random.Random(n).randbytes(n))
        assert audio.from_wav(audio.to_wav(data)) == data
    import io
    import wave

    with wave.open(io.BytesIO(audio.to_wav(b"\x80" * 192))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 1, 16000, 192)
    for bad in (b"", b"RIFF", audio.to_wav(b"x" * 192)[:-1], audio.to_wav(b"x" * 192).replace(b"data", b"dada")):
        with pytest.raises(ValueError):
            audio.from_wav(bad)


def test_resample_is_direct_convolution():
    x = np.random.default_rng(1).normal(size=400).astype(np.float32)
    n = audio.TAPS * audio.UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / audio.DOWN) * np.hamming(n) / audio.DOWN * audio.UP
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    full = np.convolve(stuffed, h)
    got = audio.resample(x)
    assert len(got) == 300
    # the same samples, at the delay of the centred filter
    off = [float(np.abs(full[d :: audio.DOWN][:300] - got).max()) for d in range(n)]
    assert min(off) < 1e-4 and abs(int(np.argmin(off)) - (n - 1) / 2) <= audio.UP


def test_tone_lands_in_its_filter():
    t = np.arange(16000) / 16000
    tone = lambda f: bytes((128 + 100 * np.sin(2 * math.pi * f * t)).astype(np.uint8))
    peak = [int(audio.features(tone(f)).mel.mean(0).argmax()) for f in (200, 800, 2500, 5000)]
    assert peak == sorted(set(peak))


def test_hysteresis():
    loud, mid, low = [0.0] * audio.MELS, [-75.0] * audio.MELS, [-100.0] * audio.MELS
    mel = np.array([mid, loud, mid, mid, low, mid, loud, loud, low], np.int16)
    assert audio.segments(mel) == [(1, 4), (6, 8)]
    rng = np.random.default_rng(3)
    for _ in range(20):
        mel = rng.integers(-150, 0, (60, 1)).repeat(audio.MELS, 1).astype(np.int16)
        e = 10 * np.log10((10.0 ** (mel / 100)).sum(1))
        on, want = False, []
        for x in e:
            on = True if x >= e.max() - audio.BEGIN_DB else False if x < e.max() - audio.END_DB else on
            want.append(on)
        got = np.zeros(60, bool)
        for a, b in audio.segments(mel):
            got[a:b] = True
        assert got.tolist() == want


def test_tables(spark, tmp_path):
    texts = [None, "", "é" * 100, "x" * 192, "word " * 5000, "word " * 5000]
    df = spark.createDataFrame([(i if i != 3 else None, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    media = audio.store(df)
    got = {r.id: r for r in audio.digests(media).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        p = data + b" " * ((-len(data)) % 192 if data else 192)
        r = got[i if i != 3 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(p) + 44, hashlib.sha256(audio.to_wav(p)).hexdigest())
    assert got[4].feature == got[5].feature and got[0].feature == got[1].feature != got[2].feature
    rows = audio.tensors(media).orderBy("id", "begin_s").toArrow()
    out = audio.as_tensor_column(rows)
    assert out.column("tensor").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
    own = [x for x in rows.to_pylist() if x["id"] == 4]
    want = list(audio.features(("word " * 5000).encode().ljust(25152, b" ")).tensors())
    assert [(x["segment"], x["begin_s"], x["end_s"]) for x in own] == [w[:3] for w in want]
    assert all(np.array_equal(np.array(x["tensor"], np.float32).reshape(64, 24), w[3]) for x, w in zip(own, want))
    import pyarrow.parquet as pq

    pq.write_table(out, tmp_path / "t.parquet")
    assert pq.read_table(tmp_path / "t.parquet").column("tensor").type == out.column("tensor").type
    assert audio.digests(audio.store(df.limit(0))).count() == 0
    assert audio.as_tensor_column(audio.tensors(audio.store(df.limit(0))).toArrow()).num_rows == 0


def test_stored_tensors(spark):
    import pyarrow.parquet as pq

    texts = [None, "", "x" * 192, "word " * 5000, "word " * 5000, "é" * 100]
    media = audio.store(spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    stored = audio.store_tensors(media)
    places = stored.collect()
    for r, m in ((r, m) for r in places for m in media.collect() if m.id == r.id):
        t = pq.ParquetFile(r.path.removeprefix("file://")).read_row_group(r.row_group)
        assert t.schema.field("tensor").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
        own, want = t.slice(r["first"], r.tensors), list(audio.features(audio.from_wav(m.media)).tensors())
        assert list(zip(*(own.column(c).to_pylist() for c in ("segment", "begin_s", "end_s")))) == [w[:3] for w in want]
        assert np.array_equal(own.column("tensor").combine_chunks().to_numpy_ndarray(), np.stack([w[3] for w in want]))
    got = {r.id: r for r in audio.stored_digests(stored).collect()}
    assert len(got) == len(texts) and got[3].feature == got[4].feature and got[0].feature == got[1].feature != got[5].feature
    for r in audio.digests(media).collect():
        assert r[:-1] == got[r.id][:-1] and r.feature.split(";")[1:3] == got[r.id].feature.split(";")[1:3]
    assert audio.stored_digests(audio.store_tensors(audio.store(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_rows_without_media(spark):
    stored = audio.store(spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string"))
    from pyspark.sql import functions as F

    some = stored.withColumn("media", F.when(F.col("id") == 1, F.col("media")))
    assert [r.id for r in audio.digests(some).collect()] == [1]
    assert [r.id for r in audio.store_tensors(some).collect()] == [1]
    assert {r.id for r in audio.tensors(some).collect()} <= {1}
