"""Binary event logs: a codec, a PySpark data source, and format detection.

A log is a magic, a u32 count of series, and messages. A message begins with a
series number of 1 to 4 bytes (wider once the count needs it). Number 0 is control:
a byte 0 and a definition (u16 name, u32 type description), or a byte 1, which
clears the symbols (not in version 1). Any other number is an event: a time, then
the value by its type. Times are differences from the last one in steps of two
microseconds, or absolute. A description is coded by u32 constructor tags with u64
lengths. All numbers are little-endian.

The data source `binary_log` writes and reads folders of logs. Each segment is a file
of its own, since a log can only be read from its start, and a line of the folder's
index: file, segment, first position, events and series. A reader takes the index
and makes a partition for each segment that it was not told to skip (options
`segments` and `series`); files without an index are a partition each. Rows are file,
seg, seq (the segment's first position and on), series, ts_us and the value as JSON.

Writing takes rows of seg, seq, series, ts_us and value, in order of seq within a
partition and all of a segment in one, and the series with their descriptions
(option `definitions`). A folder with files in it is refused. Tasks write under names
of their attempts and rename, so that repeated ones leave whole files only.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import types as ty
from .shared import folder

# Fixed values of the formats.
PLAIN, PLAIN_OLD, SEGMENTED = b"HTRACEV2", b"HTRACEV1", b"HCTRACE9"
TAGS = {"Prim": 0, "Var": 2, "FixedArray": 4, "Array": 5, "Variant": 6, "Record": 7, "Nat": 11, "App": 12, "Recursive": 13, "Fn": 15}
CODES = {"bool": "?", "byte": "B", "char": "c", "short": "h", "int": "i", "long": "q", "ushort": "H", "uint": "I", "ulong": "Q", "float": "f", "double": "d"}


class Out:
    def __init__(self) -> None:
        self.buffer = bytearray()

    def put(self, code: str, *x) -> None:
        self.buffer += struct.pack("<" + code, *x)

    def text(self, s: str) -> None:
        raw = s.encode()
        self.put("Q", len(raw))
        self.buffer += raw


class In:
    def __init__(self, f) -> None:
        self.f = f

    def bytes(self, n: int) -> bytes:
        raw = self.f.read(n)
        if len(raw) < n:
            raise EOFError("the log ends inside a message")
        return raw

    def get(self, code: str):
        return struct.unpack("<" + code, self.bytes(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.bytes(self.get("Q")).decode()


def put_type(d: ty.Desc, out: Out) -> None:
    out.put("I", TAGS[type(d).__name__])
    match d:
        case ty.Nat(n):
            out.put("Q", n)
        case ty.Prim(n, rep):
            out.text(n)
            out.put("?", rep is not None)
            if rep is not None:
                put_type(rep, out)
        case ty.Var(n):
            out.text(n)
        case ty.FixedArray(t, n):
            put_type(t, out)
            put_type(n, out)
        case ty.Array(t):
            put_type(t, out)
        case ty.Variant(cs):
            out.put("Q", len(cs))
            for i, (n, t) in enumerate(cs):
                out.text(n)
                out.put("I", i)
                put_type(t, out)
        case ty.Record(fs):
            at = dict(ty.offsets(d))
            out.put("Q", len(fs))
            for n, t in fs:
                out.text(n)
                out.put("I", at[n])
                put_type(t, out)
        case ty.Recursive(v, t):
            out.text(v)
            put_type(t, out)
        case ty.Fn(args, t):
            out.put("Q", len(args))
            for a in args:
                out.text(a)
            put_type(t, out)
        case ty.App(f, args):
            put_type(f, out)
            out.put("Q", len(args))
            for a in args:
                put_type(a, out)


def get_type(s: In) -> ty.Desc:
    kind = {v: k for k, v in TAGS.items()}[s.get("I")]
    match kind:
        case "Nat":
            return ty.Nat(s.get("Q"))
        case "Prim":
            name = s.text()
            return ty.Prim(name, get_type(s) if s.get("?") else None)
        case "Var":
            return ty.Var(s.text())
        case "FixedArray":
            return ty.FixedArray(get_type(s), get_type(s))
        case "Array":
            return ty.Array(get_type(s))
        case "Variant" | "Record":
            parts = []
            for _ in range(s.get("Q")):
                name = s.text()
                s.get("I")  # a constructor's number or a field's offset
                parts.append((name, get_type(s)))
            return ty.Variant(tuple(parts)) if kind == "Variant" else ty.Record(tuple(parts))
        case "Recursive":
            return ty.Recursive(s.text(), get_type(s))
        case "Fn":
            args = tuple(s.text() for _ in range(s.get("Q")))
            return ty.Fn(args, get_type(s))
    f = get_type(s)
    return ty.App(f, tuple(get_type(s) for _ in range(s.get("Q"))))


def _tag(n: int) -> str:
    return next(code for code, limit in (("B", 1 << 8), ("H", 1 << 16), ("I", 1 << 32), ("Q", 1 << 64)) if n < limit)


def put_value(d: ty.Desc, x, out: Out) -> None:
    match d:
        case ty.Prim("()", _):
            return
        case ty.Prim("int128", _):
            out.buffer += int(x).to_bytes(16, "little", signed=True)
        case ty.Prim("char", _):
            out.put("c", x.encode("latin-1"))
        case ty.Prim(n, rep):
            if n in CODES:
                out.put(CODES[n], x)
            else:
                put_value(rep, x, out)
        case ty.Array(ty.Prim("char", _)):
            out.text(x)
        case ty.Array(t):
            out.put("Q", len(x))
            for v in x:
                put_value(t, v, out)
        case ty.FixedArray(t, ty.Nat(n)):
            if len(x) != n:
                raise ValueError(f"{len(x)} values for {ty.text(d)}")
            for v in x:
                put_value(t, v, out)
        case ty.Record(fs):
            for (n, t), v in zip(fs, x if isinstance(x, list | tuple) else [x[n] for n, _ in fs], strict=True):
                put_value(t, v, out)
        case ty.Variant(cs):
            name, v = (x, None) if isinstance(x, str) else x
            at = [n for n, _ in cs].index(name)
            out.put(_tag(len(cs)), at)
            put_value(cs[at][1], v, out)
        case _:
            raise TypeError(f"no codec: {ty.text(d)}")


def get_value(d: ty.Desc, s: In):
    match d:
        case ty.Prim("()", _):
            return None
        case ty.Prim("int128", _):
            return int.from_bytes(s.bytes(16), "little", signed=True)
        case ty.Prim("char", _):
            return s.bytes(1).decode("latin-1")
        case ty.Prim(n, rep):
            return s.get(CODES[n]) if n in CODES else get_value(rep, s)
        case ty.Array(ty.Prim("char", _)):
            return s.bytes(s.get("Q")).decode("utf-8", "replace")
        case ty.Array(t):
            return [get_value(t, s) for _ in range(s.get("Q"))]
        case ty.FixedArray(t, ty.Nat(n)):
            return [get_value(t, s) for _ in range(n)]
        case ty.Record(fs) if ty.is_tuple(d):
            return [get_value(t, s) for _, t in fs]
        case ty.Record(fs):
            return {n: get_value(t, s) for n, t in fs}
        case ty.Variant(cs):
            name, t = cs[s.get(_tag(len(cs)))]
            return name if t == ty.UNIT else [name, get_value(t, s)]
    raise TypeError(f"no codec: {ty.text(d)}")


def put_time(ts: int, last: int, out: Out) -> int:
    """Returns the time that a reader will have."""
    half = (ts - last) >> 1
    if ts < last or half >= 1 << 30:
        out.put("BQ", 0, ts)
        return ts
    code = 1 if half < 1 << 14 else 2 if half < 1 << 22 else 3
    out.buffer += (code | half << 2).to_bytes(code + 1, "little")
    return last + 2 * half


def get_time(last: int, s: In) -> int:
    first = s.get("B")
    code = first & 3
    if not code:
        return s.get("Q")
    return last + 2 * (int.from_bytes(s.bytes(code), "little") << 6 | first >> 2)


def encoded(series: list[tuple[str, ty.Desc]], events: Iterable[tuple[str, int, object]], flush: int = 1 << 17) -> Iterator[bytes]:
    """A log of these series with (series, ts_us, value) events, in parts of about flush bytes."""
    out, last, width = Out(), 0, 1
    out.buffer += PLAIN
    out.put("I", len(series))
    for i, (name, d) in enumerate(series):
        own = Out()
        put_type(d, own)
        raw = name.encode()
        out.buffer += bytes(width) + b"\0"
        out.put("H", len(raw))
        out.buffer += raw
        out.put("I", len(own.buffer))
        out.buffer += own.buffer
        width += i + 1 == 1 << 8 * width
    number = {name: i + 1 for i, (name, _) in enumerate(series)}
    of = dict(series)
    for name, ts, value in events:
        out.buffer += number[name].to_bytes(width, "little")
        last = put_time(ts, last, out)
        put_value(of[name], value, out)
        if len(out.buffer) >= flush:
            yield bytes(out.buffer)
            out.buffer.clear()
    yield bytes(out.buffer)


def encode(series: list[tuple[str, ty.Desc]], events: Iterable[tuple[str, int, object]]) -> bytes:
    """A whole log as bytes."""
    return b"".join(encoded(series, events))


def decode(f, expected: list[tuple[str, ty.Desc]] | None = None) -> Iterator[tuple[str, int, object]]:
    """(series, ts_us, value) of a log. expected: what the reader takes; other series are then errors."""
    s = In(f)
    magic = s.bytes(8)
    if magic not in (PLAIN, PLAIN_OLD):
        raise ValueError("not an event log")
    s.get("I")
    found: list[tuple[str, ty.Desc]] = []
    last, width = 0, 1
    while True:
        head = f.read(width)
        if len(head) < width:
            return  # the end between events; inside one it is an error
        number = int.from_bytes(head, "little")
        if number:
            name, d = found[number - 1]
            last = get_time(last, s)
            yield name, last, get_value(d, s)
        elif magic == PLAIN and s.get("B") == 1:
            continue
        else:
            name = s.bytes(s.get("H")).decode()
            found.append((name, get_type(In(io.BytesIO(s.bytes(s.get("I")))))))
            if expected is not None:
                ty.validate(expected, found)
            width += len(found) == 1 << 8 * width


def kind(head: bytes) -> str | None:
    """Which format a file's first bytes tell."""
    return {PLAIN: "plain", PLAIN_OLD: "plain, version 1", SEGMENTED: "segmented"}.get(head[:8])


def definitions(f) -> list[tuple[str, ty.Desc]]:
    """The series that a log defines before its first event: what a reader knows of it without any type of its own."""
    s, found = In(f), []
    if s.bytes(8) not in (PLAIN, PLAIN_OLD):
        raise ValueError("not an event log")
    n, width = s.get("I"), 1
    while len(found) < n:
        if any(s.bytes(width)) or s.get("B"):
            raise ValueError("an event before the definitions")
        name = s.bytes(s.get("H")).decode()
        found.append((name, get_type(In(io.BytesIO(s.bytes(s.get("I")))))))
        width += len(found) == 1 << 8 * width
    return found


def told(series: list[tuple[str, ty.Desc]]) -> str:
    """Definitions as the text of an option."""
    out = []
    for name, d in series:
        own = Out()
        put_type(d, own)
        out.append((name, own.buffer.hex()))
    return json.dumps(out)


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")
    return store, path


INDEX = "index.json"


class BinaryLog(DataSource):
    """spark.dataSource.register(BinaryLog); spark.read.format("binary_log").load(path); df.write.format("binary_log").mode("append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "binary_log"

    def schema(self) -> str:
        return "file string, seg long, seq long, series string, ts_us long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


@dataclass
class _Segment(InputPartition):
    file: str
    seg: int | None
    first: int


@dataclass
class _Done(WriterCommitMessage):
    lines: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.series = options["path"], [(n, bytes.fromhex(d)) for n, d in json.loads(options["definitions"])]
        from pyarrow import fs

        store, path = _open(self.path)
        if any(x.is_file for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True))):
            raise ValueError(f"{path} already has files")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = _open(self.path)
        store.create_dir(path)
        series, lines = [(n, get_type(In(io.BytesIO(d)))) for n, d in self.series], []
        for seg, own in groupby(rows, lambda r: r["seg"]):
            line = {"file": f"seg-{seg:012d}", "seg": seg, "first_seq": None, "events": 0, "series": set()}

            def events(own=own, line=line) -> Iterator[tuple]:
                for r in own:
                    if not line["events"]:
                        line["first_seq"] = r["seq"]
                    line["events"] += 1
                    line["series"].add(r["series"])
                    yield r["series"], r["ts_us"], json.loads(r["value"])

            name = line["file"]
            with store.open_output_stream(f"{path}/.{name}.{TaskContext.get().taskAttemptId()}") as out:
                for part in encoded(series, events()):
                    out.write(part)
            store.move(f"{path}/.{name}.{TaskContext.get().taskAttemptId()}", f"{path}/{name}")
            lines.append(line | {"series": sorted(line["series"])})
        return _Done(lines)

    def commit(self, messages: list) -> None:
        store, path = _open(self.path)
        store.create_dir(path)
        lines = sorted((x for m in messages if m for x in m.lines), key=lambda x: x["seg"])
        with store.open_output_stream(f"{path}/{INDEX}") as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())

    def abort(self, messages: list) -> None:
        """Files without an index line are of no job that ended; the next writer refuses the folder."""


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.series = options["path"], options.get("series")
        self.segments = {int(x) for x in options["segments"].split(",")} if "segments" in options else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _open(self.path)
        info = store.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith("."))
        if not files or not files[-1].endswith(f"/{INDEX}") and f"{path}/{INDEX}" not in files:
            return [_Segment(f, None, 1) for f in files]
        with store.open_input_stream(f"{path}/{INDEX}") as f:
            lines = [json.loads(x) for x in f.read().splitlines()]
        kept = (x for x in lines if (self.segments is None or x["seg"] in self.segments) and (self.series is None or self.series in x["series"]))
        return [_Segment(f"{path}/{x['file']}", x["seg"], x["first_seq"]) for x in kept]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # all segments are skipped
            return
        store, _ = _open(self.path)
        with store.open_input_stream(partition.file, buffer_size=1 << 17) as f:
            for seq, (series, ts, value) in enumerate(decode(f), partition.first):
                if self.series in (None, series):
                    yield partition.file.rsplit("/", 1)[-1], partition.seg, seq, series, ts, json.dumps(value)


def save(log: DataFrame, series: list[tuple[str, ty.Desc]], path: str | None = None) -> str:
    """Write rows of seg, seq, series, ts_us, value (JSON) as segments of a new folder; returns it."""
    spark = log.sparkSession
    spark.dataSource.register(BinaryLog)
    path = path or folder(spark, "log")
    rows = log.select("seg", "seq", "series", "ts_us", "value").repartition("seg").sortWithinPartitions("seg", "seq")
    rows.write.format("binary_log").option("definitions", told(series)).mode("append").save(path)
    return path


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a folder. segments: numbers of segments, series: a name; others are not opened or left out."""
    spark.dataSource.register(BinaryLog)
    return spark.read.format("binary_log").options(**options).load(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, seg, first_seq, events, series: a row for each segment."""
    return spark.read.schema("file string, seg long, first_seq long, events long, series array<string>").json(f"{path}/{INDEX}")


def defined(path: str, file: str) -> list[tuple[str, ty.Desc]]:
    """What a file of a folder defines."""
    store, base = _open(path)
    with store.open_input_stream(f"{base}/{file}") as f:
        return definitions(f)


def typed(rows: DataFrame, d: ty.Desc) -> DataFrame:
    """seg, seq, series, ts_us and the value by a description that only the log knows, as columns of a struct."""
    return rows.select("seg", "seq", "series", "ts_us", F.from_json("value", ty.to_spark(d)).alias("value"))


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """file, format of the files of a folder, from their first eight bytes."""
    from pyarrow import fs

    store, base = _open(path)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.is_file]

    def heads(batches):
        import pyarrow as pa

        store, base = _open(path)
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}") as f:
                    found.append(kind(f.read(8)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["file", "format"])

    return spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names) // 64)).mapInArrow(heads, "file string, format string")


def with_other_formats(path: str) -> str:
    """Adds files of an old log, a segmented log and of no log to a folder."""
    store, base = _open(path)
    for name, head in (("old", PLAIN_OLD), ("segmented", SEGMENTED), ("other", b"PAR1")):
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(head + bytes(8))
    return path
