"""Telephony audio (op 3): mu-law and A-law by lookup tables, IMA ADPCM decoded with numpy across blocks.

Media columns hold WAV files (8 kHz mono) in one of three telephony codings. ``store`` puts a payload of bytes in
such a file without loss: as 8-bit samples of a companding law, or as the nibbles of ADPCM blocks behind block
headers of silence. ``load`` reads the stored bytes back, ``expand`` makes 16-bit PCM, ``double_rate`` resamples it
to 16 kHz with integer arithmetic, so equal bytes give equal samples everywhere.

Defined results: a null text is empty; an empty payload is one unit of padding; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lodestrata.llm.common import text_map

UNIT, PAD, RATE = 576, 255, 8000
ALAW, ULAW, IMA = 6, 7, 17  # format tags of WAV
NAMES = {ALAW: "alaw", ULAW: "ulaw", IMA: "ima"}
BLOCK = 64  # bytes of nibbles in an ADPCM block
HEAD = 4  # bytes before them: predictor, step index, reserved
# Changes of the step index by nibble (sign bit dropped).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Quantiser steps of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
#: Half of the odd phase of a two-times interpolator (Hamming-windowed sinc, 12 taps), in 1/32768.
TAPS = 6


@lru_cache(1)
def taps() -> np.ndarray:
    k = np.arange(TAPS) + 0.5
    w = np.sinc(k) * (0.54 + 0.46 * np.cos(np.pi * k / TAPS))
    q = np.round(w / w.sum() * 16384).astype(np.int64)
    q[0] += 16384 - q.sum()
    return q


@lru_cache(2)
def law_table(tag: int) -> np.ndarray:
    """16-bit values of the 256 codes of a companding law (ITU-T G.711)."""
    out = np.zeros(256, np.int16)
    for code in range(256):
        if tag == ULAW:
            c = ~code & 0xFF
            v = ((((c & 0x0F) << 3) + 0x84) << ((c >> 4) & 7)) - 0x84
            out[code] = -v if c & 0x80 else v
        else:
            c = code ^ 0x55
            e, m = (c >> 4) & 7, (c & 0x0F) << 4
            v = m + 8 if e == 0 else (m + 0x108) << (e - 1)
            out[code] = v if c & 0x80 else -v
    return out


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, a row a block: steps run in time, each across all blocks."""
    n, width = blocks.shape
    data = blocks[:, HEAD:]
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((2 * (width - HEAD) + 1, n), np.int16)
    out[0] = value
    for t in range(2 * (width - HEAD)):
        nib = ((data[:, t >> 1] >> (4 * (t & 1))) & 15).astype(np.int32)
        step = STEPS[index]
        size = nib & 7
        diff = (step >> 3) + ((size & 1) * (step >> 2)) + (((size >> 1) & 1) * (step >> 1)) + ((size >> 2) * step)
        value = np.clip(np.where(nib & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[size], 0, 88)
        out[t + 1] = value
    return np.ascontiguousarray(out.T)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the sampling rate: samples stay, those between come from a symmetric filter; edges repeat."""
    if not len(pcm):
        return pcm
    x = np.pad(pcm.astype(np.int32), (TAPS - 1, TAPS), mode="edge")
    n = len(pcm)
    acc = np.full(n, 16384, np.int64)
    for k, c in enumerate(taps().tolist()):
        acc += c * (x[TAPS - 1 - k : TAPS - 1 - k + n] + x[TAPS + k : TAPS + k + n])
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(acc >> 15, -32768, 32767)
    return out


def store(payload: bytes, tag: int) -> bytes:
    """A WAV file whose samples (or nibbles) are the payload."""
    if tag == IMA:
        body = np.zeros((len(payload) // BLOCK, HEAD + BLOCK), np.uint8)
        body[:, HEAD:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data, per = body.tobytes(), 2 * BLOCK + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * (HEAD + BLOCK) // per, HEAD + BLOCK, 4, 2, per)
        samples = per * len(body)
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    chunks = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)]
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def load(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, block size, data) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found.setdefault(media[at : at + 4], media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    tag, _, _, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return tag, align, found[b"data"]


def payload_of(tag: int, align: int, data: bytes) -> bytes:
    """What ``store`` was given."""
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, HEAD:].tobytes() if tag == IMA else data


def expand(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each file; the ADPCM blocks of all files (of one block size) are decoded together."""
    out: list = [None] * len(files)
    for tag in (ULAW, ALAW):
        own = [i for i, f in enumerate(files) if f[0] == tag]
        flat = law_table(tag)[np.frombuffer(b"".join(files[i][2] for i in own), np.uint8)]
        for i, part in zip(own, np.split(flat, np.cumsum([len(files[i][2]) for i in own])[:-1]), strict=False):
            out[i] = part
    for align in {f[1] for f in files if f[0] == IMA}:
        own = [i for i, f in enumerate(files) if f[:2] == (IMA, align)]
        blocks = np.frombuffer(b"".join(files[i][2] for i in own), np.uint8).reshape(-1, align)
        pcm = decode_ima(blocks)
        ends = np.cumsum([len(files[i][2]) // align for i in own])
        for i, part in zip(own, np.split(pcm, ends[:-1]), strict=False):
            out[i] = part.reshape(-1)
    return out


def describe(tag: int, pcm: np.ndarray) -> str:
    """Coding, samples, peak, rounded root mean square, zero crossings and CRC-32 of the resampled PCM."""
    wide = pcm.astype(np.int64)
    rms = int(round(float(np.sqrt((wide * wide).sum() / max(1, len(pcm))))))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[tag]};n={len(pcm)};peak={int(np.abs(wide).max()) if len(pcm) else 0};rms={rms};zc={crossings};crc={zlib.crc32(pcm.astype('<i2')):08x}"


def to_audio(df: DataFrame, text: str = "text", doc_id: str = "doc_id", with_media: bool = False, with_pcm: bool = False) -> DataFrame:
    """Store each text's padded bytes as audio, read it back, expand and resample.

    The coding is mu-law, A-law or IMA ADPCM by the payload's CRC-32. With ``with_pcm`` the 16 kHz PCM (16-bit, little
    endian) comes as a binary column to be stored, with ``with_media`` the file too.
    """
    schema = f"doc_id {dict(df.dtypes)[doc_id]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if with_media:
        schema += ", media binary"
    if with_media or with_pcm:
        schema += ", pcm binary"

    def make():
        def kernel(texts, kept):
            raw = [t.encode() for t in texts]
            padded = [b + bytes([PAD]) * (-len(b) % UNIT if b else UNIT) for b in raw]
            media = [store(p, (ULAW, ALAW, IMA)[zlib.crc32(p) % 3]) for p in padded]
            files = [load(m) for m in media]
            back = [payload_of(*f) for f in files]
            pcm = [double_rate(x) for x in expand(files)]
            sha = lambda items: [hashlib.sha256(x).hexdigest() for x in items]
            out = {"doc_id": kept[doc_id], "n_bytes": list(map(len, raw)), "payload_bytes": list(map(len, back)), "payload_sha256": sha(back), "tail_crc32": [zlib.crc32(b[-32:]) for b in back], "media_bytes": list(map(len, media)), "media_sha256": sha(media), "feature": [describe(f[0], x) for f, x in zip(files, pcm, strict=True)]}
            if with_media:
                out["media"] = media
            if with_media or with_pcm:
                out["pcm"] = [x.astype("<i2").tobytes() for x in pcm]
            return out

        return kernel

    return text_map(df, schema, make, text, (doc_id,))
