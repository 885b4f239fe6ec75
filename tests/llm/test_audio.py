import hashlib
import zlib

import numpy as np
import pyarrow as pa

from ledgerline.llm import audio
from ledgerline.llm.queries import op6_audio_of


def test_tables():
    """Values of ITU-T G.711."""
    assert [int(audio.MULAW[i]) for i in (0x00, 0x7F, 0x80, 0xFF, 0x0F, 0xF0)] == [-32124, 0, 32124, 0, -16764, 120]
    assert [int(audio.ALAW[i]) for i in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert sorted(audio.MULAW[128:]) == sorted(-audio.MULAW[:128].astype(int)) and len({*audio.ALAW.tolist()}) == 256


def plain_adpcm(block):
    now = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            move = (2 * (code & 7) + 1) * step >> 3
            now = max(-32768, min(32767, now - move if code & 8 else now + move))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(now)
    return out


def test_adpcm_against_plain():
    data = np.random.default_rng(0).integers(0, 256, 5 * audio.UNIT, dtype=np.uint8)
    got = audio.decode_adpcm(data)
    assert got.tolist() == [plain_adpcm(bytes(b)) for b in data.reshape(-1, audio.UNIT).tolist()]


def test_round_trip_of_every_codec():
    payload = bytes(range(256)) * 9
    for codec in audio.FORMATS:
        name, rate, back = audio.read(audio.encode(payload, codec))
        assert (name, rate, bytes(back)) == (codec, 8000, payload)


def test_resample():
    x = np.array([0, 10, -4], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 5, 10, 3, -4, -4]
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist() and len(audio.resample(x[:0], 8000, 16000)) == 0


def test_query(odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = {}
    for d, t in rows:
        data = t.encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        media = audio.encode(payload)
        want[d, t] = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    found = op6_audio_of(odd).collect()
    got = sorted(((r.doc_id or -1), r[1:7]) for r in found)
    assert got == sorted(((d or -1), want[d, t]) for d, t in rows)
    assert len({r.feature for r in found if r.n_bytes == 0}) == 1
    assert op6_audio_of(none).count() == 0
    both = [sorted(map(str, x.collect())) for x in (audio.features(audio.to_media(odd)), audio.stored_features(odd))]
    assert both[0] == both[1]


def plain_energy(pcm):
    return f"{sum(x * x for x in pcm) // len(pcm)}:{sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))}:{max(abs(x) for x in pcm)}"


def test_feature_and_pcm_of_what_is_stored(spark, odd, monkeypatch):
    """Recomputed sample by sample from the stored form of the query's own rows."""
    texts = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 5000] + [(99, "a long é text " * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    media = {bytes(hashlib.sha256(m).digest()).hex(): m for m in (bytes(r.media) for r in audio.to_media(df).collect())}
    for r in op6_audio_of(df).collect():
        payload = bytes(audio.read(media[r.media_sha256])[2])
        own = {"mulaw": [int(audio.MULAW[b]) for b in payload], "alaw": [int(audio.ALAW[b]) for b in payload], "adpcm": [x for k in range(0, len(payload), 576) for x in plain_adpcm(payload[k : k + 576])]}
        x = own["mulaw"]
        pcm = [v for a, b in zip(x, x[1:]) for v in (a, (a + b) >> 1)] + [x[-1]] * 2
        assert np.frombuffer(bytes(r.pcm), "<i2").tolist() == pcm and r.rate == 16000
        assert r.feature == f"pcm=16000:{len(pcm)}:{zlib.crc32(bytes(r.pcm))};" + ";".join(f"{k}={plain_energy(v)}" for k, v in own.items())


def test_slices_make_no_difference(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 7 * 576, dtype=np.uint8)
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3]), "n_bytes": pa.array([1, 2, 3]), "media": pa.array([audio.encode(bytes(data)), audio.encode(bytes(data[:576])), audio.encode(bytes(data), "adpcm")])})
    want = pa.Table.from_batches(audio._features(16000)(iter([batch])))
    monkeypatch.setattr(audio, "BLOCKS", 2)
    monkeypatch.setattr(audio, "SLICE", 5)
    assert pa.Table.from_batches(audio._features(16000)(iter([batch]))).equals(want)


def test_pcm(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    for codec in audio.FORMATS:
        r = audio.to_pcm(audio.to_media(df, codec), 16000).first()
        raw = np.frombuffer(b"abc" + b"\xff" * 573, np.uint8)
        assert np.frombuffer(bytes(r.pcm), "<i2").tolist() == audio.resample(audio.samples(raw, codec), 8000, 16000).tolist()
