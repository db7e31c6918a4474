"""WAV, AIFF and raw PCM: headers and samples, with the standard library and numpy only."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

FORMATS = ("wav", "aiff", "raw")
#: Sample types by name: numpy type of the stored values.
STREAMS = {"int16": "<i2", "int16be": ">i2", "float32": "<f4", "float32be": ">f4"}


@dataclass(frozen=True)
class Spec:
    """What a header says: where the frames are and how to read them."""

    format: str
    bit_stream: str
    n_channels: int
    sample_rate: float
    data_start: int
    data_bytes: int

    @property
    def frame_bytes(self) -> int:
        return np.dtype(STREAMS[self.bit_stream]).itemsize * self.n_channels

    @property
    def n_frames(self) -> int:
        return self.data_bytes // self.frame_bytes


def extended_to_float(b: bytes) -> float:
    """An 80-bit extended number of an AIFF header."""
    exponent, mantissa = struct.unpack(">HQ", b)
    sign = -1.0 if exponent & 0x8000 else 1.0
    return sign * mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def float_to_extended(v: float) -> bytes:
    if v <= 0:
        return bytes(10)
    mantissa, exponent = np.frexp(v)
    return struct.pack(">HQ", int(exponent) + 16382, int(mantissa * 2.0**64))


def _chunks(head: bytes, at: int, order: str):
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack(order + "I", head[at + 4 : at + 8])[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse(head: bytes, total: int, kind: str = "auto", sample_rate: float = 48000.0, n_channels: int = 2, bit_stream: str = "int16") -> Spec:
    """Spec from the first bytes of a file of ``total`` bytes; raw files take the given one."""
    if kind == "auto":
        kind = "wav" if head[:4] == b"RIFF" else "aiff" if head[:4] == b"FORM" else "raw"
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(FORMATS)}")
    if kind == "raw":
        if bit_stream not in STREAMS or n_channels < 1 or sample_rate <= 0:
            raise ValueError("a raw file needs a sample rate, channels and one of " + ", ".join(STREAMS))
        return Spec("raw", bit_stream, n_channels, float(sample_rate), 0, total)
    if kind == "wav":
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise OSError("not a WAV file")
        fmt = None
        for name, at, size in _chunks(head, 12, "<"):
            if name == b"fmt ":
                tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at : at + 16])
                if tag == 0xFFFE:  # extensible: the real tag leads the sub-format
                    tag = struct.unpack("<H", head[at + 24 : at + 26])[0]
                if (tag, bits) not in {(1, 16), (3, 32)}:
                    raise OSError(f"WAV samples of type {tag} with {bits} bits are not supported")
                fmt = ("int16" if tag == 1 else "float32", channels, float(rate))
            elif name == b"data":
                if fmt is None:
                    raise OSError("the WAV file has data before its format")
                return Spec("wav", *fmt, at, min(size, total - at))
        raise OSError("the WAV file has no data")
    if head[:4] != b"FORM" or head[8:12] not in (b"AIFF", b"AIFC"):
        raise OSError("not an AIFF file")
    comm = None
    data = None
    for name, at, size in _chunks(head, 12, ">"):
        if name == b"COMM":
            channels, _, bits = struct.unpack(">hIh", head[at : at + 8])
            code = head[at + 18 : at + 22] if head[8:12] == b"AIFC" else b"NONE"
            streams = {(b"NONE", 16): "int16be", (b"sowt", 16): "int16", (b"fl32", 32): "float32be", (b"FL32", 32): "float32be"}
            if (code, bits) not in streams:
                raise OSError(f"AIFF samples of type {code!r} with {bits} bits are not supported")
            comm = (streams[code, bits], channels, extended_to_float(head[at + 8 : at + 18]))
        elif name == b"SSND":
            offset = struct.unpack(">I", head[at : at + 4])[0]
            data = (at + 8 + offset, size - 8 - offset)
        if comm and data:
            return Spec("aiff", *comm, data[0], min(data[1], total - data[0]))
    raise OSError("the AIFF file has no data")


def decode(data: bytes, spec: Spec) -> np.ndarray:
    """(channels, frames) of float64; integers are scaled by 1/32768."""
    x = np.frombuffer(data[: len(data) // spec.frame_bytes * spec.frame_bytes], dtype=STREAMS[spec.bit_stream]).reshape(-1, spec.n_channels).T.astype(np.float64)
    return x / 32768 if spec.bit_stream.startswith("int16") else x


def encode(x: np.ndarray, bit_stream: str = "int16", clip: bool = True) -> bytes:
    """Interleaved frames of (channels, frames); integers are rounded half away from zero."""
    if clip:
        x = np.clip(x, -1.0, 1 - 2.0**-15 if bit_stream.startswith("int16") else 1.0)
    if bit_stream.startswith("int16"):
        v = x * 32768
        x = np.clip(np.copysign(np.floor(np.abs(v) + 0.5), v), -32768, 32767)
    return np.ascontiguousarray(x.T).astype(STREAMS[bit_stream]).tobytes()


def header(spec: Spec) -> bytes:
    """The bytes before the frames of a new file."""
    if spec.format == "raw":
        return b""
    width = np.dtype(STREAMS[spec.bit_stream]).itemsize
    if spec.format == "wav":
        tag = 1 if spec.bit_stream == "int16" else 3
        fmt = struct.pack("<HHIIHH", tag, spec.n_channels, int(spec.sample_rate), int(spec.sample_rate) * spec.frame_bytes, spec.frame_bytes, 8 * width)
        return b"RIFF" + struct.pack("<I", 36 + spec.data_bytes) + b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", spec.data_bytes)
    if spec.bit_stream == "int16be":
        comm = struct.pack(">hIh", spec.n_channels, spec.n_frames, 16) + float_to_extended(spec.sample_rate)
        kind = b"AIFF"
    else:
        code = {"int16": b"sowt", "float32be": b"fl32"}[spec.bit_stream]
        comm = struct.pack(">hIh", spec.n_channels, spec.n_frames, 8 * width) + float_to_extended(spec.sample_rate) + code + b"\x00\x00"
        kind = b"AIFC"
    body = kind + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", 8 + spec.data_bytes, 0, 0)
    return b"FORM" + struct.pack(">I", len(body) + spec.data_bytes) + body
