"""Filterbank files: headers, channel windows, and Spark data sources over them.

Header: the keyword HEADER_START, then keyword and value pairs to HEADER_END; keywords and text values
are a 32-bit length and ASCII, numbers are little-endian 32-bit integers or doubles. Samples follow row by
row: all channels of the first time step (of each IF), then of the next. So a window of channels is one
short read a row, and nothing else of the file is touched.
"""

from __future__ import annotations

import contextlib
import json
import math
import operator
import os
import struct
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, Filter, InputPartition, IsNotNull, WriterCommitMessage

# Fixed values of the format.
INTS = frozenset("machine_id telescope_id data_type barycentric pulsarcentric nbits nsamples nchans nifs nbeams ibeam".split())
DOUBLES = frozenset("az_start za_start src_raj src_dej tstart tsamp fch1 foff refdm period".split())
STRINGS = frozenset("source_name rawdatafile".split())
KINDS = {8: np.uint8, 16: np.uint16, 32: np.float32, 64: np.float64}
SUFFIXES = (".fil", ".h5", ".hdf5")
CHUNK = 4096
#: How old the newest entry of a folder is before it is taken.
SETTLED_NS = 50_000_000


@dataclass
class Header:
    fch1: float = 0.0
    foff: float = 0.0
    nchans: int = 0
    tsamp: float = 0.0
    nsamples: int = 0
    nifs: int = 1
    nbits: int = 32
    tstart: float = 0.0
    source_name: str = ""
    data_offset: int = 0
    extra: dict = field(default_factory=dict)

    def row_bytes(self) -> int:
        return self.nchans * self.nifs * self.nbits // 8


def parse_header(buf: bytes, file_size: int | None = None) -> Header:
    """EOFError where the buffer ends too soon; ValueError for what isn't a header."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(buf):
            raise EOFError("the header goes on beyond the buffer")
        at += n
        return buf[at - n : at]

    def text() -> str:
        (n,) = struct.unpack("<i", take(4))
        if not 0 <= n <= 255:
            raise ValueError("not a filterbank header")
        return take(n).decode("ascii", "replace")

    if text() != "HEADER_START":
        raise ValueError("not a filterbank header")
    found: dict = {}
    while (key := text()) != "HEADER_END":
        if key in INTS:
            (found[key],) = struct.unpack("<i", take(4))
        elif key in DOUBLES:
            (found[key],) = struct.unpack("<d", take(8))
        elif key in STRINGS:
            found[key] = text()
        else:
            raise ValueError(f"unknown header keyword {key!r}")
    known = {k: found.pop(k) for k in list(found) if k in Header.__dataclass_fields__}
    h = Header(**known, data_offset=at, extra=found)
    if h.nbits not in KINDS:
        raise ValueError(f"{h.nbits} bits a sample are not supported")
    if not h.nsamples and file_size is not None and h.row_bytes():
        h.nsamples = (file_size - at) // h.row_bytes()
    return h


def header_bytes(h: Header) -> bytes:
    word = lambda s: struct.pack("<i", len(s)) + s.encode("ascii")
    out = [word("HEADER_START")]
    for k, v in ({k: v for k, v in asdict(h).items() if k not in ("extra", "data_offset")} | h.extra).items():
        out.append(word(k) + (struct.pack("<i", int(v)) if k in INTS else struct.pack("<d", float(v)) if k in DOUBLES else word(str(v))))
    return b"".join([*out, word("HEADER_END")])


def write_file(path: str, data: np.ndarray, h: Header) -> None:
    """Single-precision samples [time, channel] of one IF."""
    h = Header(**{**asdict(h), "nsamples": data.shape[0], "nchans": data.shape[1], "nifs": 1, "nbits": 32})
    with open(f"{path}.part", "wb") as f:
        f.write(header_bytes(h))
        f.write(np.ascontiguousarray(data, "<f4").tobytes())
    os.replace(f"{path}.part", path)


class RangeNotSupported(OSError):
    """The server sent the whole file where a part was asked for."""


def http_get(url: str, start: int | None = None, stop: int | None = None, timeout: float = 60.0, tries: int = 3, pause: float = 1.5) -> tuple[bytes, int | None]:
    """Bytes [start, stop) of a file and, if the server tells, its size."""
    wait = threading.Event()
    for n in range(tries):
        req = urllib.request.Request(url, headers={} if start is None else {"Range": f"bytes={start}-{'' if stop is None else stop - 1}"})
        try:
            with urllib.request.urlopen(req, timeout=timeout) as r:
                if start is not None and r.status != 206:
                    raise RangeNotSupported(url)
                total = (r.headers.get("Content-Range") or "").rpartition("/")[2]
                return r.read(), int(total) if total.isdigit() else None
        except RangeNotSupported:
            raise
        except (urllib.error.URLError, OSError):
            if n + 1 == tries:
                raise
            wait.wait(pause**n)
    raise AssertionError


def is_remote(location: str) -> bool:
    return location.startswith(("http://", "https://"))


def read_header(location: str, most_requests: int = 64) -> Header:
    """Reads on until the header ends."""
    if location.lower().endswith((".h5", ".hdf5")):
        return _h5(location)[0]
    if not is_remote(location):
        size, buf = os.path.getsize(location), b""
        with open(location, "rb") as f:
            while True:
                more = f.read(CHUNK)
                buf += more
                try:
                    return parse_header(buf, size)
                except EOFError:
                    if not more:
                        raise
    buf, total = b"", None
    for _ in range(most_requests):
        more, total = http_get(location, len(buf), len(buf) + 4 * CHUNK)
        buf += more
        try:
            return parse_header(buf, total)
        except EOFError:
            if not more or len(buf) >= (total or 1 << 62):
                raise
    raise EOFError("no end of the header")


def _h5(location: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 filterbanks needs h5py") from e
    f = h5py.File(location, "r")
    data = f["data"]
    name = lambda v: v.decode() if isinstance(v, bytes) else v
    known = {k: name(data.attrs[k]) for k in Header.__dataclass_fields__ if k in data.attrs}
    return Header(**known | {"nsamples": data.shape[0], "nchans": data.shape[-1], "nifs": data.shape[1] if data.ndim == 3 else 1}), data


def read_window(location: str, c0: int, c1: int, h: Header | None = None, if_index: int = 0, threads: int = 8) -> np.ndarray:
    """[time, channel] of channels [c0, c1) in single precision; one read or Range request a time step."""
    if location.lower().endswith((".h5", ".hdf5")):
        _, data = _h5(location)
        return np.asarray(data[:, if_index, c0:c1] if data.ndim == 3 else data[:, c0:c1], np.float32)
    h = h or read_header(location)
    kind, size = KINDS[h.nbits], h.nbits // 8
    first = lambda t: h.data_offset + (t * h.nifs + if_index) * h.nchans * size + c0 * size
    n = (c1 - c0) * size
    if is_remote(location):
        with ThreadPoolExecutor(threads) as pool:
            rows = list(pool.map(lambda t: http_get(location, first(t), first(t) + n)[0], range(h.nsamples)))
    else:
        with open(location, "rb") as f:
            rows = [(f.seek(first(t)), f.read(n))[1] for t in range(h.nsamples)]
    if any(len(r) != n for r in rows):
        raise EOFError(f"{location} ends before its header says")
    return np.stack([np.frombuffer(r, kind).astype(np.float32) for r in rows]) if rows else np.zeros((0, c1 - c0), np.float32)


def load_bounded(location: str, most_mb: float, c0: int = 0, c1: int | None = None) -> np.ndarray:
    """A window, if it isn't above so many megabytes."""
    h = read_header(location)
    c1 = h.nchans if c1 is None else c1
    if (mb := (c1 - c0) * h.nsamples * 4 / (1 << 20)) > most_mb:
        raise ValueError(f"{mb:.0f} MB are above the limit of {most_mb} MB")
    return read_window(location, c0, c1, h)


def download(url: str, dest: str, most_mb: float) -> str:
    """Whole file, checked against the limit while it comes; it has its name only once it is complete."""
    most = int(most_mb * (1 << 20))
    with urllib.request.urlopen(url, timeout=60) as r, open(f"{dest}.part", "wb") as f:
        if int(r.headers.get("Content-Length") or 0) > most:
            raise ValueError("the file is above the limit")
        got = 0
        while block := r.read(1 << 20):
            if (got := got + len(block)) > most:
                raise ValueError("the file is above the limit")
            f.write(block)
    os.replace(f"{dest}.part", dest)
    return dest


@dataclass
class Unit(InputPartition):
    location: str
    header: dict
    unit_id: str
    chan_start: int
    chan_stop: int
    core_start: int
    core_stop: int
    if_index: int = 0
    error: str | None = None


def files_in(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.lower().endswith(SUFFIXES))


def guard_band(h: Header, rate: float, steps: int) -> int:
    """Channels of padding on each side of a unit's core that a tone can drift through: at `rate` Hz/s, and at most
    `steps` channels a sample."""
    hz = abs(h.foff) * 1e6
    k = math.ceil(rate * h.tsamp / hz) if hz else 1
    return max(1, min(k, max(1, steps))) * max(h.nsamples, 1) + 8


@dataclass
class Cut:
    """How files are cut into units. pad: channels on either side, or None for what the header and the drift limits ask
    for; most_mb: the largest unit; ranges: first and end channel of some files; lenient: a file that can't be cut is
    a unit that says why."""

    width: int = 262144
    pad: int | None = 0
    c0: int = 0
    c1: int | None = None
    rate: float = 4.0
    steps: int = 32
    most_mb: float | None = None
    ranges: dict[str, list[int]] | None = None
    lenient: bool = False

    @classmethod
    def of(cls, o: dict) -> Cut:
        return cls(
            int(o.get("width", 262144)), None if o.get("pad") == "drift" else int(o.get("pad", 0)), int(o.get("c0", 0)), int(o["c1"]) if "c1" in o else None, float(o.get("drift_rate", 4.0)),
            int(o.get("drift_steps", 32)), float(o["most_mb"]) if "most_mb" in o else None, json.loads(o["ranges"]) if "ranges" in o else None, o.get("lenient", "false") == "true")

    def units(self, location: str) -> list[Unit]:
        try:
            return self._units(location)
        except Exception as e:  # noqa: BLE001
            if not self.lenient:
                raise
            return [Unit(location, {}, f"{stem(location)}:", 0, 0, 0, 0, error=f"{type(e).__name__}: {e}")]

    def _units(self, location: str) -> list[Unit]:
        h = read_header(location)
        c0, c1 = (self.ranges or {}).get(location, (self.c0, self.c1))
        c1 = h.nchans if c1 is None else min(c1, h.nchans)
        pad = guard_band(h, self.rate, self.steps) if self.pad is None else self.pad
        mb = min(min(self.width, h.nchans) + 2 * pad, h.nchans) * h.nsamples * 4 / (1 << 20)
        if self.most_mb is not None and mb > self.most_mb:
            raise ValueError(f"a unit would be {math.ceil(mb)} MB; the limit is {self.most_mb:g}")
        cores = [(a, min(a + self.width, c1)) for a in range(c0, c1, self.width)]
        return [Unit(location, asdict(h), f"{stem(location)}:{a}-{b}", max(0, a - pad), min(h.nchans, b + pad), a, b) for a, b in cores]


def stem(location: str) -> str:
    return os.path.splitext(os.path.basename(location.split("?")[0]))[0]


def units_of(location: str, width: int, pad: int, c0: int = 0, c1: int | None = None) -> list[Unit]:
    return Cut(width, pad, c0, c1).units(location)


SCHEMA = "unit_id string, location string, n_t int, n_f int, chan_start long, core_start long, core_stop long, nchans long, f_low double, f_high double, fch1 double, foff double, tsamp double, tstart double, source_name string, z binary, error string"


def described(u: Unit) -> dict:
    """What a unit's row holds but for its samples, known before anything of them is read. f_low and f_high are the
    outermost frequencies of its core."""
    if u.error:
        return {"unit_id": u.unit_id, "location": u.location, "error": u.error}
    h = Header(**u.header)
    ends = [h.fch1 + h.foff * c for c in (u.core_start, u.core_stop - 1)]
    return {
        "unit_id": u.unit_id, "location": u.location, "n_t": h.nsamples, "n_f": u.chan_stop - u.chan_start, "chan_start": u.chan_start, "core_start": u.core_start, "core_stop": u.core_stop,
        "nchans": h.nchans, "f_low": min(ends), "f_high": max(ends), "fch1": h.fch1, "foff": h.foff, "tsamp": h.tsamp, "tstart": h.tstart, "source_name": h.source_name}


#: How filters that Spark hands over compare a known value; columns with samples and errors aren't known yet.
COMPARED = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda x, values: x in values, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": str.__contains__}
KNOWN = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("z", "error")]


def _passes(known: dict, f: Filter) -> bool:
    value = known.get(f.attribute[0])
    if isinstance(f, IsNotNull):
        return value is not None
    return value is not None and COMPARED[type(f).__name__](value, f.value)


def _rows(units: list[Unit]) -> Iterator[pa.RecordBatch]:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    kind = pa.schema([(n, types[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
    for u in units:
        row, z, error = described(u), None, u.error
        if not error:
            try:
                z = read_window(u.location, u.chan_start, u.chan_stop, Header(**u.header), u.if_index).astype("<f8").tobytes()
            except Exception as e:  # noqa: BLE001 - one unit that can't be read is a row that says why
                error = f"{type(e).__name__}: {e}"
        row |= {"z": z, "error": error}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in kind], schema=kind)


def read_blocks(asked: DataFrame, width: int, rate: float, steps: int) -> DataFrame:
    """asked(location, block) as units of `width` channels with guard bands, read where the rows are."""
    cut = Cut(width, None, rate=rate, steps=steps)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location, block in zip(*(batch.column(k).to_pylist() for k in range(2))):
                yield from _rows(Cut(**vars(cut) | {"c0": block * width, "c1": (block + 1) * width, "lenient": True}).units(location))

    n = asked.sparkSession.sparkContext.defaultParallelism
    return asked.select("location", "block").repartition(max(n, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(task, SCHEMA)


class FilterbankReader(DataSourceReader):
    """Filters on what headers say are answered before a partition is planned, so files and windows beside the asked
    frequencies aren't opened for their samples."""

    def __init__(self, options: dict):
        self.paths = [p for x in options["path"].split(",") for p in (files_in(x) if os.path.isdir(x) else [x])]
        self.cut, self.filters = Cut.of(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in KNOWN and (isinstance(f, IsNotNull) or type(f).__name__ in COMPARED):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Unit]:
        paths = self.cut.ranges if self.cut.ranges is not None else self.paths
        return [u for p in paths for u in self.cut.units(p) if all(_passes(described(u), f) for f in self.filters)]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        return _rows([partition] if partition else [])  # Spark asks for nothing where there are no partitions


class FilterbankStream(DataSourceStreamReader):
    """Files of a folder, in the order in which they came there. An offset is the place in that order up to which files
    are taken: the time at which the last one came (when its entry last changed, which copying or moving it sets anew
    whatever time its content has) and its name. So offsets stay small, a batch is what came after an earlier offset, a
    file that is written anew is searched again, and one that is taken away leaves no gap. Files named by `done`
    (comma-separated) are passed over; names that end in .part are not yet complete. files_per_batch bounds a batch of
    a stream that has just begun; a stream that goes on takes all that came meanwhile at first."""

    def __init__(self, options: dict):
        self.folder, self.options = options["path"], options
        self.done = set(filter(None, options.get("done", "").split(",")))
        self.most = int(options["files_per_batch"]) if "files_per_batch" in options else None
        self.taken: dict | None = None  # the last offset that was given out, once it is known

    def initialOffset(self) -> dict:
        self.taken = {"at": 0, "path": ""}
        return self.taken

    def came(self) -> list[tuple[int, str]]:
        """When each file came, and its name; no file comes later with a place before the last one of these."""
        while True:
            out = []
            for p in files_in(self.folder):
                with contextlib.suppress(FileNotFoundError):  # taken away meanwhile
                    out.append((os.stat(p).st_ctime_ns, p))
            out.sort()
            if not out or time.time_ns() - out[-1][0] > SETTLED_NS:
                return [x for x in out if x[1] not in self.done]
            time.sleep(SETTLED_NS / 1e9)  # clocks of file systems tick in some milliseconds; another file may come in the same tick

    def latestOffset(self) -> dict:
        files = self.came()
        if self.taken is not None:
            files = [x for x in files if x > (self.taken["at"], self.taken["path"])][: self.most]
        if files:
            self.taken = {"at": files[-1][0], "path": files[-1][1]}
        return self.taken or {"at": 0, "path": ""}

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        cut = Cut.of(self.options | {"lenient": "true"})  # a file that can't be read is a unit that says why
        after, upto = ((o["at"], o["path"]) for o in (start, end))
        return [u for at, p in self.came() if after < (at, p) <= upto for u in cut.units(p)]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        return _rows([partition] if partition else [])  # Spark asks for nothing where there are no partitions

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FilterbankWriter(DataSourceWriter):
    """A file a row: the unit's samples in single precision. Files of tasks that fail are taken away."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, rows) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        out = []
        for r in rows:
            path = os.path.join(self.folder, r["unit_id"].replace(":", "_") + ".fil")
            z = np.frombuffer(r["z"], "<f8").reshape(r["n_t"], r["n_f"])
            write_file(path, z, Header(fch1=r["fch1"], foff=r["foff"], tsamp=r["tsamp"], tstart=r["tstart"], source_name=r["source_name"] or ""))
            out.append(path)
        return Written(out)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            for p in m.paths if m else []:
                if os.path.exists(p):
                    os.remove(p)


class Filterbank(DataSource):
    """spark.read.format("filterbank").option("width", ...).load(folder or files): a row a work unit."""

    @classmethod
    def name(cls) -> str:
        return "filterbank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilterbankReader:
        return FilterbankReader(dict(self.options))

    def streamReader(self, schema) -> FilterbankStream:
        return FilterbankStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FilterbankWriter:
        return FilterbankWriter(dict(self.options))


def header_table(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file of a folder, or for the one file or URL named: what its header says, or why it can't be read."""
    rows = []
    for p in files_in(folder) if os.path.isdir(folder) else [folder]:
        try:
            h = asdict(read_header(p))
            rows.append((p, *(h[k] for k in ("fch1", "foff", "nchans", "tsamp", "nsamples", "nifs", "nbits", "tstart", "source_name", "data_offset")), {k: str(v) for k, v in h["extra"].items()}, None))
        except Exception as e:  # noqa: BLE001
            rows.append((p, *[None] * 11, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "location string, fch1 double, foff double, nchans long, tsamp double, nsamples long, nifs long, nbits long, tstart double, source_name string, data_offset long, extra map<string,string>, error string")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of small files, through Spark's own reader."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fil").load(folder).select(F.col("path"), F.col("length"), F.sha2("content", 256).alias("sha256"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Filterbank)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader answers filters
