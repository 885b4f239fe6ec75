"""Operator 6: telephony audio columns.

A payload is stored as 8-bit mu-law, A-law or IMA ADPCM samples in a WAV
container, so every byte is a sample (or half of two) and nothing is lost.
Reading expands mu-law and A-law by tables of 256 entries; ADPCM blocks are
decoded sample by sample with numpy across all blocks of a batch at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, byte_text

UNIT = 576
RATE = 8000
#: WAVE format numbers.
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: ADPCM blocks decoded at once, and samples handled at once where one row may hold very many.
BLOCKS = 2048
SLICE = 1 << 20


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = ((u & 15) * 8 + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    step, low = a >> 4 & 7, (a & 15) * 16
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(data: np.ndarray, align: int = UNIT) -> np.ndarray:
    """int16 samples, a row for each block of ``align`` bytes.

    A block begins with its first sample (16 bits) and its step index (one
    byte, at most 88 counts) and has two samples in each byte after the fourth.
    """
    out = np.empty((len(data) // align, 1 + 2 * (align - 4)), np.int16)
    for at in range(0, len(out), BLOCKS):
        out[at : at + BLOCKS] = _decoded(data.reshape(-1, align)[at : at + BLOCKS])
    return out


def _decoded(blocks: np.ndarray) -> np.ndarray:
    now = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    now = (now ^ 0x8000) - 0x8000
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)  # a row holds one sample of all blocks
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    steps = np.empty((len(codes) + 1, len(blocks)), np.int16)
    steps[0] = now
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        move = (2 * (code & 7).astype(np.int32) + 1) * step >> 3
        now = np.clip(np.where(code & 8, now - move, now + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        steps[k] = now
    return steps.T


def encode(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A WAV file whose data chunk is the payload."""
    head = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate if codec != "adpcm" else rate * UNIT // (2 * (UNIT - 4) + 1), UNIT if codec == "adpcm" else 1, 4 if codec == "adpcm" else 8)
    extra = struct.pack("<HH", 2, 2 * (UNIT - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    samples = len(payload) // UNIT * (2 * (UNIT - 4) + 1) if codec == "adpcm" else len(payload)
    chunks = b"".join(name + struct.pack("<I", len(body)) + body for name, body in ((b"fmt ", head + extra), (b"fact", struct.pack("<I", samples))))
    pad = b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunks) + len(payload) + len(pad)) + b"WAVE" + chunks + b"data" + struct.pack("<I", len(payload)) + payload + pad


def read(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, payload) of a WAV file, by its chunks."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(view):
        name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        body = view[at + 8 : at + 8 + n]
        if name == b"fmt ":
            number, _, rate = struct.unpack_from("<HHI", body)
            codec = next((k for k, v in FORMATS.items() if v == number), None)
        elif name == b"data":
            if codec is None:
                raise ValueError("no known sample format before the data")
            return codec, rate, body
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def samples(payload: np.ndarray, codec: str) -> np.ndarray:
    """int16 samples of a payload of whole bytes (ADPCM: of whole blocks)."""
    if codec == "adpcm":
        return decode_adpcm(payload).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; the last sample holds."""
    if to == 2 * rate and len(pcm):
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        for k in range(0, len(pcm) - 1, SLICE):
            here, after = pcm[k : k + SLICE], pcm[k + 1 : k + 1 + SLICE]
            out[2 * k + 1 : 2 * (k + len(after)) : 2] = (here[: len(after)].astype(np.int32) + after) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.floor(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16) if len(pcm) else pcm


def _energy(parts: Iterable[np.ndarray]) -> str:
    """Mean square, zero crossings and peak of all parts, all integers."""
    square = crossings = peak = n = 0
    last = None
    for part in parts:
        for k in range(0, len(part), SLICE):
            wide = part[k : k + SLICE].astype(np.int64)
            below = wide < 0
            square += int(wide @ wide)
            crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (last is not None and last != below[0])
            peak = max(peak, int(np.abs(wide).max()))
            n, last = n + len(wide), below[-1]
    return f"{square // max(1, n)}:{crossings}:{peak}"


def _through(table: np.ndarray, payload: np.ndarray) -> Iterator[np.ndarray]:
    return (table[payload[k : k + SLICE]] for k in range(0, len(payload), SLICE))


def _encode(codec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer() for x in batch["text"]]
            for at, end in _together([len(x) // UNIT for x in texts]):
                media, size = [], []
                for x in texts[at:end]:
                    data = x.to_pybytes()
                    fill = max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)
                    size.append(len(data))
                    media.append(encode(data + b"\xff" * fill, codec))
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(at, end - at), "n_bytes": pa.array(size, pa.int64()), "media": pa.array(media, pa.binary())})

    return run


def to_media(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each text as a WAV file.

    Bytes 255 fill up to a positive multiple of 576.  A null text is empty; a
    null doc_id is kept; repeated rows are rows of their own; columns besides
    doc_id and text are not read.
    """
    return bounded(docs).select(F.col("doc_id").cast("long"), byte_text().alias("text")).mapInArrow(_encode(codec), "doc_id long, n_bytes long, media binary")


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows from, to of about BLOCKS blocks; a larger row stands alone."""
    at = 0
    while at < len(sizes):
        end, blocks = at, 0
        while end < len(sizes) and (end == at or blocks + sizes[end] <= BLOCKS):
            blocks += sizes[end]
            end += 1
        yield at, end
        at = end


def _features(to: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codecs, rates, payloads = zip(*(read(x.as_buffer()) for x in batch["media"]))
            arrays = [np.frombuffer(p, np.uint8) for p in payloads]
            for at, end in _together([len(x) // UNIT for x in arrays]):
                joined = np.concatenate(arrays[at:end]).reshape(-1, UNIT) if end - at > 1 else arrays[at].reshape(-1, UNIT)
                decoded = _decoded(joined) if end - at > 1 else None
                out, row = [], 0
                for codec, rate, payload in zip(codecs[at:end], rates[at:end], arrays[at:end]):
                    n = len(payload) // UNIT
                    own = [decoded[row : row + n].ravel()] if decoded is not None else (_decoded(joined[k : k + BLOCKS]).ravel() for k in range(0, n, BLOCKS))
                    row += n
                    pcm = resample(samples(payload, codec), rate, to).astype("<i2", copy=False)
                    parts = (("pcm", f"{to}:{len(pcm)}:{zlib.crc32(pcm)}"), ("mulaw", _energy(_through(MULAW, payload))), ("alaw", _energy(_through(ALAW, payload))), ("adpcm", _energy(own)))
                    out.append((payload.tobytes(), zlib.crc32(payload[-32:].tobytes()), ";".join(f"{k}={v}" for k, v in parts), pcm.tobytes()))
                payload, crc, feature, pcm = zip(*out)
                rows = batch.slice(at, end - at)
                yield pa.record_batch(
                    {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "media": rows["media"].cast(pa.binary()), "payload": pa.array(payload, pa.binary()), "tail_crc32": pa.array(crc, pa.int64()), "feature": pa.array(feature, pa.string()), "rate": pa.array([to] * len(out), pa.int32()), "pcm": pa.array(pcm, pa.binary())}
                )

    return run


def features(media: DataFrame, to: int = 2 * RATE) -> DataFrame:
    """media of to_media() with what its stored bytes give: payload, tail_crc32, feature, rate and pcm.

    pcm is the sound as 16-bit little-endian samples at ``rate``.  feature holds rate, length and CRC-32 of the resampled PCM, and mean
    square, zero crossings and peak of the payload as mu-law, A-law and ADPCM.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(to), _READ)


_READ = "doc_id long, n_bytes long, media binary, payload binary, tail_crc32 long, feature string, rate int, pcm binary"


def stored_features(docs: DataFrame, codec: str = "mulaw", to: int = 2 * RATE) -> DataFrame:
    """features(to_media(docs)), where one worker of a task does both."""
    encode_all, read_all = _encode(codec), _features(to)
    return bounded(docs).select(F.col("doc_id").cast("long"), byte_text().alias("text")).mapInArrow(lambda batches: read_all(encode_all(batches)), _READ)


def _pcm(to: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch["media"]:
                codec, rate, payload = read(x.as_buffer())
                out.append(resample(samples(np.frombuffer(payload, np.uint8), codec), rate, to).astype("<i2").tobytes())
            yield pa.record_batch({"doc_id": batch["doc_id"], "rate": pa.array([to] * len(out), pa.int32()), "pcm": pa.array(out, pa.binary())})

    return run


def to_pcm(media: DataFrame, to: int = 2 * RATE) -> DataFrame:
    """doc_id, rate, pcm: each media row decoded and resampled, as 16-bit little-endian samples to store."""
    return media.select("doc_id", "media").mapInArrow(_pcm(to), "doc_id long, rate int, pcm binary")
