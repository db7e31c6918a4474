"""Audio files as DataFrames.

``spark.read.format("audio")`` (after ``register(spark)``) is a Python data source for files on a
shared mount: a file is cut into frame-aligned byte ranges, one row and task slot each, so a long
file is read in parallel with constant memory. Filters on ``start_frame`` and ``path`` are pushed into
the scan. Files that fit one range are not opened for planning; the heads of longer ones are read by
several threads. ``read_files`` reads through Spark's own file readers, for stores that only Spark reaches.

Writing puts one file per row into a folder of the target that only the commit empties: files appear
when the whole job has succeeded, an aborted job leaves those of earlier ones alone, and ``overwrite``
removes the files that were there.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import codec

SCHEMA = "path string, format string, bit_stream string, sample_rate double, n_channels int, n_frames bigint, chunk_idx bigint, start_frame bigint, channels array<array<double>>"
HEAD_BYTES = 1 << 16
#: Ranges up to this number are a task each. More of them are dealt to about as many tasks, runs of ranges of up to TASK_BYTES.
MOST_TASKS, TASK_BYTES = 128, 1 << 26


def _options(options) -> dict:
    return {"kind": options.get("fileformat", options.get("fileFormat", "auto")), "sample_rate": float(options.get("samplerate", options.get("sampleRate", 48000))), "n_channels": int(options.get("nchannels", options.get("nChannels", 2))), "bit_stream": options.get("bitstream", options.get("bitStream", "int16"))}


@dataclass
class Range(InputPartition):
    path: str
    spec: codec.Spec | None  # None: a whole file, whose head is read with it
    chunk_idx: int
    start: int
    frames: int
    chunk: int = 0  # frames of a row, if the range holds several


@dataclass
class Files(InputPartition):
    """Whole files that one task reads, one after the other."""

    parts: list[Range]


class AudioReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.chunk = int(options.get("chunkframes", options.get("chunkFrames", 1 << 20)))
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("start_frame",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
                elif isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), f.value if self.high is None else min(self.high, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = {f.value} if self.paths is None else self.paths & {f.value}
            yield f  # Spark checks every filter again; ranges only skip work

    def partitions(self):
        path = self.options.get("path")
        if not path:
            raise ValueError("the audio source needs a path")
        found = sorted(glob.glob(path.removeprefix("file://")) if any(c in path for c in "*?[") else [path.removeprefix("file://")])
        files = [f for p in found for f in (sorted(os.path.join(p, x) for x in os.listdir(p) if not x.startswith(("_", "."))) if os.path.isdir(p) else [p])]
        files = [f for f in files if self.paths is None or f in self.paths]
        sizes = [os.path.getsize(f) for f in files]
        # no sample has less than two bytes, so such a file has one range
        long = [f for f, n in zip(files, sizes, strict=True) if n > 2 * self.chunk]
        with ThreadPoolExecutor(32) as pool:
            specs = dict(zip(long, pool.map(self._spec, long), strict=True))
        wanted = {f: self._wanted(s) for f, s in specs.items()}
        whole = [f for f in files if f not in specs and self.chunk >= self.low and (self.high is None or self.high >= 0)]
        # short ranges share a task, so that tasks do not grow with the number of ranges
        each = -(-(sum(map(len, wanted.values())) + len(whole)) // MOST_TASKS)
        out = []
        for f in files:
            if f in specs:
                spec = specs[f]
                run = max(1, min(each, TASK_BYTES // (self.chunk * spec.frame_bytes)))
                for k in wanted[f][::run]:
                    start, last = k * self.chunk, min(k + run, wanted[f].stop)
                    out.append(Range(f, spec, k, start, min(last * self.chunk, spec.n_frames) - start, self.chunk))
        single = [Range(f, None, 0, 0, -1) for f in whole]
        if each == 1:
            return sorted(out + single, key=lambda r: (r.path, r.start))
        at = 0
        while at < len(single):
            # sizes are below two bytes a frame of a range
            n = max(1, min(each, TASK_BYTES // (2 * self.chunk)))
            out.append(Files(single[at : at + n]))
            at += n
        return out

    def _wanted(self, spec: codec.Spec) -> range:
        """The chunks of a long file that the pushed filters leave."""
        last = -(-spec.n_frames // self.chunk) if self.high is None else min(-(-spec.n_frames // self.chunk), self.high // self.chunk + 1)
        return range(min(max(0, -(-self.low // self.chunk)), max(last, 0)), max(last, 0))

    def _spec(self, path: str) -> codec.Spec:
        with open(path, "rb") as h:
            return codec.parse(h.read(HEAD_BYTES), os.path.getsize(path), **_options(self.options))

    def read(self, part: Range | Files):
        for r in part.parts if isinstance(part, Files) else [part]:
            s = r.spec or self._spec(r.path)
            frames = s.n_frames if r.frames < 0 else r.frames
            with open(r.path, "rb") as h:
                h.seek(s.data_start + r.start * s.frame_bytes)
                for k, at in enumerate(range(0, frames, r.chunk or max(frames, 1))):
                    x = codec.decode(h.read(min(r.chunk or frames, frames - at) * s.frame_bytes), s)
                    yield (r.path, s.format, s.bit_stream, s.sample_rate, s.n_channels, s.n_frames, r.chunk_idx + k, r.start + at, [c.tolist() for c in x])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class AudioWriter(DataSourceWriter):
    """One file per row of (signal_id, sample_rate, channels); clipped unless ``clip`` is false."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.kind = options.get("fileformat", options.get("fileFormat", "wav"))
        self.stream = options.get("bitstream", options.get("bitStream", "int16be" if self.kind == "aiff" else "int16"))
        self.clip = options.get("clip", "true").lower() != "false"
        self.overwrite = overwrite
        self.staging = os.path.join(self.path, f"_staging-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        own = os.path.join(self.staging, uuid.uuid4().hex)  # of this attempt
        os.makedirs(own, exist_ok=True)
        files = []
        for r in rows:
            x = np.array(r["channels"], dtype=float)
            data = codec.encode(x, self.stream, self.clip)
            spec = codec.Spec(self.kind, self.stream, len(x), float(r["sample_rate"]), 0, len(data))
            name = os.path.join(own, f"{r['signal_id']}.{self.kind}")
            with open(name, "wb") as h:
                h.write(codec.header(spec) + data)
            files.append(name)
        return Written(files)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for x in os.scandir(self.path):
                if x.is_file() and not x.name.startswith(("_", ".")):
                    os.remove(x.path)
        for m in messages:
            for f in m.files if m else []:
                os.replace(f, os.path.join(self.path, os.path.basename(f)))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


class AudioSource(DataSource):
    @classmethod
    def name(cls):
        return "audio"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return AudioReader(self.options)

    def writer(self, schema, overwrite):
        return AudioWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AudioSource)


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per file, read by Spark's binary reader; a file must fit in a task."""
    given = _options(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                s = codec.parse(data[:HEAD_BYTES], len(data), **given)
                x = codec.decode(data[s.data_start : s.data_start + s.data_bytes], s)
                row = [p, s.format, s.bit_stream, s.sample_rate, s.n_channels, s.n_frames, 0, 0, x.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def read_chunks(spark: SparkSession, path: str, chunk_frames: int = 1 << 20, **options) -> DataFrame:
    """Mono signals in chunks (signal_id, sample_rate, chunk_idx, samples), each read by its own task; for ``blocks_from_chunks``."""
    register(spark)
    return mono(spark.read.format("audio").options(**options).option("chunkFrames", chunk_frames).load(path))


def mono(audio: DataFrame) -> DataFrame:
    """(signal_id, sample_rate, chunk_idx, samples): mean over the channels."""
    from ..operators.framing import downmix_arrays

    return audio.select(F.col("path").alias("signal_id"), "sample_rate", "chunk_idx", downmix_arrays("channels").alias("samples"))
