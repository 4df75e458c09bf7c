"""A streaming source that tails files by byte offset and inode, as a Python data source: format("log_tail").

Options: path (a file that every executor and the driver can read), rangeBytes, startingOffset and startingInode (where
a query without a checkpoint begins; the inode may be left out), maxBytesPerTrigger (0: no limit; a longer line passes
whole) and checkpoint (the query's checkpoint, from which a limited source knows where it stands after a restart; it
must be given with a limit). Offsets are {"inode", "start"}, under a limit with "path" too; `committed` reads them. A file
whose inode changed or that shrank is read from its beginning. The driver only looks at sizes and for the last line
end, so a line that is being written stays for the next batch; executors read ranges of rangeBytes, each the lines
that begin in it. A range that is read again after a rotation is looked for by its inode in the file's folder. Remote
files come through `Files`, whose methods another transport can give.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range, and bytes read at once while a line end is looked for.
RANGE_BYTES, STEP_BYTES = 8 << 20, 64 << 10


class Files:
    """Local transport."""

    def stat(self, path: str) -> tuple[int, int]:
        """Size and inode."""
        s = os.stat(path)
        return s.st_size, s.st_ino

    def read(self, path: str, start: int, end: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(end - start)

    def locate(self, path: str, inode: int) -> str:
        """The path of the inode: the file itself, or one that it was renamed to in its folder."""
        if os.path.exists(path) and os.stat(path).st_ino == inode:
            return path
        for e in os.scandir(os.path.dirname(path) or "."):
            if e.is_file() and e.inode() == inode:
                return e.path
        raise FileNotFoundError(f"{path} was rotated and its old content is gone")


@dataclass
class Range(InputPartition):
    inode: int
    start: int
    end: int
    last: int  # where the batch ends


class LogTail(DataSource):
    transport: Files = Files()

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, start long, value string"

    def streamReader(self, schema) -> TailReader:
        given = {k.lower(): v for k, v in self.options.items()}
        inode = given.get("startinginode")
        begin = {"inode": None if inode is None else int(inode), "start": int(given.get("startingoffset", 0))}
        return TailReader(given["path"], self.transport, int(given.get("rangebytes", RANGE_BYTES)), begin, int(given.get("maxbytespertrigger", 0)), given.get("checkpoint"))


def committed(checkpoint: str, logged: bool = False) -> list[dict | None]:
    """The offset of each source after the last committed batch (logged: after the last planned one), in the query's order of sources; empty without batches.

    To go on elsewhere, or again from the beginning, give an offset to a new checkpoint as startingOffset and
    startingInode. The checkpoint must lie on a path that the driver can open.
    """
    root = checkpoint.removeprefix("file:")
    done = [int(n) for n in _names(f"{root}/{'offsets' if logged else 'commits'}") if n.isdigit()]
    if not done:
        return []
    with open(f"{root}/offsets/{max(done)}", encoding="utf-8") as f:
        found = f.read().splitlines()[2:]  # a version and the batch's settings come first
    return [None if line == "-" else json.loads(line) for line in found]


def _names(folder: str) -> list[str]:
    return os.listdir(folder) if os.path.isdir(folder) else []


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, transport: Files, range_bytes: int = RANGE_BYTES, begin: dict | None = None, most: int = 0, checkpoint: str | None = None):
        if most and not checkpoint:
            raise ValueError("maxBytesPerTrigger needs the option checkpoint")
        self.path, self.transport, self.range_bytes, self.begin, self.most = path, transport, range_bytes, begin or {"inode": None, "start": 0}, most
        self.seen: dict | None = None
        if most:  # after a restart Spark asks for the next offset without telling where it stands
            self.seen = next((o for o in committed(checkpoint, True) if o and o.get("path") == path), None)

    def initialOffset(self) -> dict:
        return self.begin | ({"path": self.path} if self.most else {})

    def _last_end(self, low: int, high: int) -> int | None:
        """The end of the last whole line that ends in a range of bytes."""
        while high > low:
            at = max(low, high - STEP_BYTES)
            cut = self.transport.read(self.path, at, high).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            high = at
        return None

    def _first_end(self, low: int, high: int) -> int | None:
        while low < high:
            cut = self.transport.read(self.path, low, min(low + STEP_BYTES, high)).find(b"\n")
            if cut >= 0:
                return low + cut + 1
            low += STEP_BYTES
        return None

    def latestOffset(self) -> dict:
        """The end of the last whole line, of those that the limit lets pass; what was seen before if the file is missing."""
        before = self.seen or self.initialOffset()
        try:
            size, inode = self.transport.stat(self.path)
        except FileNotFoundError:
            return before
        low = before["start"] if before["inode"] in (None, inode) and before["start"] <= size else 0
        if self.most:
            high = min(size, low + self.most)
            end = self._last_end(low, high) or self._first_end(high, size) or low
        else:
            end = self._last_end(0, size) or 0
        self.seen = {"inode": inode, "start": end} | ({"path": self.path} if self.most else {})
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["inode"] is None:
            return []
        at = start["start"] if start["inode"] in (None, end["inode"]) and end["start"] >= start["start"] else 0
        return [Range(end["inode"], a, min(a + self.range_bytes, end["start"]), end["start"]) for a in range(at, end["start"], self.range_bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        path = self.transport.locate(self.path, partition.inode)
        at = partition.start
        # a line belongs to the range that it begins in: the byte before tells whether one begins here
        data = self.transport.read(path, max(0, at - 1), partition.end)
        if at:
            cut = data.find(b"\n")
            if cut < 0:
                return
            data, at = data[cut + 1 :], partition.start + cut
        end = partition.end
        while data and not data.endswith(b"\n") and end < partition.last:
            more = self.transport.read(path, end, min(end + STEP_BYTES, partition.last))
            cut = more.find(b"\n")
            data, end = data + (more if cut < 0 else more[: cut + 1]), end + len(more)
            if cut >= 0:
                break
        for line in data.split(b"\n")[:-1]:
            if text := line.decode(errors="replace").strip():
                yield self.path, at, text
            at += len(line) + 1


def tail(spark: SparkSession, registry: list[dict], **options) -> DataFrame:
    """One stream of all sources of a registry (see logs.sources): source_id, source, log_type, start, value. options: of each source, as above."""
    spark.dataSource.register(LogTail)
    streams = []
    for s in registry:
        own = spark.readStream.format("log_tail").options(**options).option("path", s["remote_path"]).load()
        streams.append(own.select(F.lit(s["id"]).alias("source_id"), F.lit(s["source"]).alias("source"), F.lit(s["log_type"]).alias("log_type"), "start", "value"))
    if not streams:
        raise ValueError("a registry without sources")
    out = streams[0]
    for other in streams[1:]:
        out = out.unionByName(other)
    return out
