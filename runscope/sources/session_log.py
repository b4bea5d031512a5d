"""Session logs: discovery, admission, complete lines in batch, and an incremental source.

``register(spark)`` adds the stream format ``session_log``.  Besides Spark's checkpoint it
keeps a folder of its own (``statePath``): numbered snapshots of where every file has been
read to, the last offset that it gave, and for every CELL_BYTES of a file a link, the hash of
what was read there.  An offset names a snapshot and the files that changed since.

A task reads one cell of one file: the lines that begin there.  The tasks of a changed
file hash all its cells again; where a link holds only lines behind the old end leave, where
it does not (cut off, replaced, changed in the middle, grown again) all lines of the cell do,
and the event ids of the normalised rows let the store drop what it has.  With ``verify`` as
``last`` only the cell of the old end is looked at.  ``maxBytesPerTrigger`` bounds a batch (by
whole lines, one at least), the first one after a restart included.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from runscope.operators.events import file_session

NAME = re.compile(r"rollout-.*\.jsonl$")
LINES = T.StructType([T.StructField("source_path", T.StringType()), T.StructField("source_offset", T.LongType()), T.StructField("line", T.StringType())])
#: Bytes of a file that a task reads and a link covers; changed files that an offset names before there is a new snapshot; snapshots kept.
CELL_BYTES, CHANGED, SNAPSHOTS = 16 << 20, 1000, 4


def discover_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, day) of the logs below ``root/YYYY/MM/DD``; no row where the root is missing."""
    day = F.regexp_extract("path", r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/[^/]+$", 0)
    found = None
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "rollout-*.jsonl").load(root)
    except Exception as e:  # only a missing root is no error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, size long, mtime timestamp, day date")
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.try_to_timestamp(F.regexp_extract(day, "^/(.{10})", 1), F.lit("yyyy/MM/dd")).cast("date").alias("day"))


def admit_files(files: DataFrame, max_bytes: int, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, rejected): within the size limit and below the root."""
    below = F.startswith(F.regexp_replace("path", "^file:/+", "/"), F.lit(root.rstrip("/") + "/"))
    fine = (F.col("size") <= max_bytes) & below & ~F.contains("path", F.lit("/../"))
    return files.where(fine), files.where(~fine)


def read_complete_lines(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """LINES of every log (of at most ``max_bytes``, if given): newline-terminated records with their byte offsets; a partial last line waits.

    Spark splits large files, so no task holds a whole one.  A line's offset is its
    place within its split and the bytes of the splits before it.  Blank lines are
    left out; bytes that are no UTF-8 stay as they are.
    """
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "rollout-*.jsonl").text(root)
    rows = found.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    if max_bytes is not None:
        rows = rows.where(F.col("size") <= max_bytes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for b in batches:
            sizes = pc.binary_length(pc.cast(b.column(0), pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            names = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            begin = np.flatnonzero([True, *[x != y for x, y in zip(names, names[1:], strict=False)]]) if names else np.zeros(0, np.int64)
            ends, within = np.cumsum(sizes), np.zeros(len(names), np.int64)
            for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(names)], strict=True):
                first = at if names[a] == split else 0
                within[a:z] = first + ends[a:z] - sizes[a:z] - (ends[a] - sizes[a])
                split, at = names[a], int(within[z - 1] + sizes[z - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(within)], names=["value", "path", "block", "size", "within"])

    lines = rows.mapInArrow(placed, "value string, path string, block long, size long, within long")
    splits = rows.groupBy("path", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))  # one row for each split
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    offset = F.col("start") + F.col("within")
    whole = lines.join(starts, ["path", "block"]).where((offset + F.octet_length("value") + 1 <= F.col("size")) & (F.trim("value") != ""))
    return whole.select(F.col("path").alias("source_path"), offset.alias("source_offset"), F.col("value").alias("line"))


def session_meta(raw: DataFrame) -> DataFrame:
    """(session_id, workspace, started_at, source, model): each log's first metadata record; what is missing is null."""
    v = raw.select("source_path", "source_offset", F.try_parse_json("line").alias("v"))
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    meta = v.where(get("type") == "session_meta").select(
        F.coalesce(get("payload.id"), file_session(F.col("source_path"))).alias("session_id"), "source_offset", get("payload.workspace").alias("workspace"),
        F.try_to_timestamp(get("timestamp")).alias("started_at"), get("payload.source").alias("source"), get("payload.model").alias("model"),
    )
    first = meta.groupBy("session_id").agg(F.min_by(F.struct("workspace", "started_at", "source", "model"), "source_offset").alias("m"))
    return first.select("session_id", "m.*", F.lit("unknown").alias("state"))


class _Cell(InputPartition):
    """The lines of a file that begin within a cell; before ``old`` they have been read once."""

    def __init__(self, path: str, cell: int, old: int, end: int):
        self.path, self.cell, self.old, self.end = path, cell, old, end


class SessionLogReader(DataSourceStreamReader):
    """Reads through the file systems that Arrow knows (local paths, hdfs, s3, gs).

    Of each file is kept: the end of what was read, its size and time of change then, and
    whether there was more than the batch had room for.
    """

    def __init__(self, options: dict):
        self.root, self.state = options["path"], options.get("statepath")
        if not self.state:
            raise ValueError("session_log needs a folder of its own: set the option statePath")
        self.limit = int(options.get("maxbytespertrigger", 0)) or None
        self.size = int(options.get("cellbytes", CELL_BYTES))
        self.whole = options.get("verify", "all") != "last"
        self.at: dict | None = None  # the last offset given
        self.known: tuple[int, dict] = (0, {})  # a snapshot's number and files

    def __getstate__(self) -> dict:
        """What tasks need."""
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "known")} | {"at": None, "known": (0, {})}

    @staticmethod
    def _system(uri: str):
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))

    def _put(self, name: str, data: dict) -> None:
        system, folder = self._system(self.state)
        path = f"{folder}/{name}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex[:8]}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(data).encode())
        system.move(part, path)

    def _get(self, name: str) -> dict | None:
        system, folder = self._system(self.state)
        try:
            with system.open_input_stream(f"{folder}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _drop(self, name: str) -> None:
        system, folder = self._system(self.state)
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(f"{folder}/{name}")

    def _files(self, offset: dict) -> dict[str, list]:
        """Where every file was read to."""
        number = offset["snapshot"]
        if number and self.known[0] != number:
            found = self._get(f"snapshots/{number}")
            if found is None:
                raise ValueError(f"snapshot {number} of the stream's offsets is not in {self.state}")
            self.known = number, found
        return {**(self.known[1] if number else {}), **offset["files"]}

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "files": {}}

    def _end(self, system, path: str, at: int, size: int, room: int | None) -> int:
        """Where the last complete line within ``room`` bytes behind ``at`` ends; the first line's end if it is longer."""
        with system.open_input_file(path) as f:
            stop = size if room is None else min(size, at + room)
            back = stop
            while back > at:
                step = min(back - at, 1 << 16)
                f.seek(back - step)
                k = f.read(step).rfind(b"\n")
                if k >= 0:
                    return back - step + k + 1
                back -= step
            while stop < size:
                f.seek(stop)
                chunk = f.read(min(size - stop, 1 << 20))
                k = chunk.find(b"\n")
                if k >= 0:
                    return stop + k + 1
                stop += len(chunk)
        return at

    def latestOffset(self) -> dict:
        system, root = self._system(self.root)
        if self.at is None:  # a restart goes on from what was given last
            self.at = self._get("given") or self.initialOffset()
        before, room, changed, there = self._files(self.at), self.limit, {}, set()
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not NAME.search(info.base_name) or os.path.islink(info.path):
                continue
            there.add(info.path)
            end, size, time, more = before.get(info.path, [0, 0, 0, False])
            if (size, time) == (info.size, info.mtime_ns) and not more or room == 0:
                continue
            low = min(end, info.size)
            low = low if low == end else self._end(system, info.path, 0, low, None)  # cut off: to the last line end before
            now = self._end(system, info.path, low, info.size, room)
            more = room is not None and now < info.size and self._end(system, info.path, now, info.size, None) > now
            changed[info.path] = [now, info.size, info.mtime_ns, more]
            room = None if room is None else max(0, room - (now - low))
        if changed:
            files = {**self.at["files"], **changed}
            self.at = {"snapshot": self.at["snapshot"], "files": files}
            if len(files) > CHANGED:
                number = self.at["snapshot"] + 1
                full = {p: v for p, v in self._files(self.at).items() if p in there}
                self._put(f"snapshots/{number}", full)
                self.known, self.at = (number, full), {"snapshot": number, "files": {}}
            self._put("given", self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Cell]:
        if start["snapshot"] == end["snapshot"]:
            names = [p for p, v in end["files"].items() if start["files"].get(p) != v]
            old = self._files(start)
            new = self._files(end)
        else:
            old, new = self._files(start), self._files(end)
            names = [p for p, v in new.items() if old.get(p) != v]
        made = []
        for path in names:
            before, now = old.get(path, [0])[0], new[path][0]
            first = 0 if self.whole or now < before else before // self.size
            made += [_Cell(path, k, min(before, now), now) for k in range(first, -(-now // self.size))]
        return made

    def read(self, part: _Cell) -> Iterator[pa.RecordBatch]:
        system, _ = self._system(self.root)
        low, high = part.cell * self.size, min((part.cell + 1) * self.size, part.end)
        old = max(low, min(part.old, high))
        link = f"links/{hashlib.sha256(part.path.encode()).hexdigest()[:24]}/{part.cell}"
        with system.open_input_file(part.path) as f:
            f.seek(max(0, low - 1))
            data = f.read(high - max(0, low - 1))
            begins, data = not low or data[:1] == b"\n", data[1:] if low else data
            held = self._get(f"{link}-{old}") if old > low else {"hash": ""}
            fits = held is not None and held["hash"] == (hashlib.sha256(data[: old - low]).hexdigest() if old > low else "")
            self._put(f"{link}-{high}", {"hash": hashlib.sha256(data).hexdigest(), "before": old})
            if held and held.get("before") not in (None, old, high):  # no restart goes back two links
                self._drop(f"{link}-{held['before']}")
            at = old - low if fits and old > low else 0 if begins else data.find(b"\n") + 1 or len(data)
            if at < len(data) and not data.endswith(b"\n"):  # the last line goes on in the next cell
                f.seek(high)
                tail = b""
                while high + len(tail) < part.end and b"\n" not in tail:
                    tail += f.read(min(1 << 16, part.end - high - len(tail)))
                data += tail[: tail.find(b"\n") + 1]
        lines, places = [], []
        while at < len(data):
            k = data.find(b"\n", at)
            if k < 0:
                break
            if data[at:k].strip():
                lines.append(data[at:k].decode("utf-8", "replace"))
                places.append(low + at)
            at = k + 1
        for k in range(0, len(lines), 10_000):
            n = len(lines[k : k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(places[k : k + 10_000], pa.int64()), pa.array(lines[k : k + 10_000])], names=LINES.names)

    def commit(self, end: dict) -> None:
        """Snapshots that no restart can need go."""
        system, folder = self._system(self.state)
        for info in system.get_file_info(fs.FileSelector(f"{folder}/snapshots", allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) <= end["snapshot"] - SNAPSHOTS:
                system.delete_file(info.path)


class SessionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> T.StructType:
        return LINES

    def streamReader(self, schema: T.StructType) -> SessionLogReader:
        return SessionLogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLog)


def tail(spark: SparkSession, root: str, state: str, max_bytes_per_trigger: int | None = None, **options) -> DataFrame:
    """The stream of complete lines below a root; ``state`` is a folder of the stream's own, beside its checkpoint.

    A batch has at most ``max_bytes_per_trigger`` bytes, if given; ``options``: cellBytes, verify.
    """
    register(spark)
    stream = spark.readStream.format("session_log").options(path=root, statePath=state, **options)
    return (stream.option("maxBytesPerTrigger", max_bytes_per_trigger) if max_bytes_per_trigger else stream).load()
