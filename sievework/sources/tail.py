"""A streaming source that follows growing JSON-lines files by byte offset.

Spark's file source sees new files, not growth.  This one keeps inode, size and the
digest of the first line of each file in its offset, so that a file that was
replaced or cut off, also while the query was down, is read from its start, and one
that only grew from where it was left.  A torn last line waits for its end.  A line
that is no JSON object gives its digest only.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a partition of a batch.
SPAN = 64 << 20
#: Bytes in which a first line must end to be told from another.
_HEAD = 1 << 16


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, generation: str):
        self.path, self.start, self.end, self.generation = path, start, end, generation


class JsonlTail(DataSource):
    """Option path: a glob on a file system that driver and executors share.

    generation names what a path held: inode and first line.  A file whose first
    line is not yet written gives no rows.  One that was cut off and written anew
    past its old size with the same first line cannot be told from one that grew.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, generation string, line string, bad_sha256 string"

    def streamReader(self, schema):
        return _Reader(self.options["path"])


def _state(path: str) -> list:
    """[inode, bytes, digest of the first line; empty before it ends]"""
    with open(path, "rb") as f:
        head, info = f.read(_HEAD), os.fstat(f.fileno())
    end = head.find(b"\n")
    first = head[:end] if end >= 0 else head if len(head) == _HEAD else None
    return [info.st_ino, info.st_size, hashlib.sha256(first).hexdigest()[:16] if first is not None else ""]


class _Reader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: _state(path) for path in sorted(glob.glob(self.pattern)) if os.path.isfile(path)}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        spans = []
        for path, (inode, size, first) in end.items():
            before = start.get(path, [inode, 0, ""])
            grew = before[0] == inode and before[1] <= size and before[2] in ("", first)
            begin = before[1] if grew and before[2] else 0
            if first:
                spans += [_Span(path, at, min(at + SPAN, size), f"{inode:x}-{first}") for at in range(begin, size, SPAN)]
        return spans

    def read(self, span: _Span):
        with open(span.path, "rb") as f:
            # A line belongs to the span in which it ends; its beginning may lie before.
            at = span.start
            while at:
                step = max(0, at - 4096)
                f.seek(step)
                cut = f.read(at - step).rfind(b"\n")
                if cut >= 0:
                    at = step + cut + 1
                    break
                at = step
            f.seek(at)
            while at < span.end:
                raw = f.readline()
                at += len(raw)
                if not raw.endswith(b"\n") or at > span.end:
                    break
                if raw.strip():
                    try:
                        line = raw.rstrip(b"\r\n").decode()
                        fine = isinstance(json.loads(line), dict)
                    except ValueError:
                        fine = False
                    yield span.path, span.generation, line if fine else None, None if fine else hashlib.sha256(raw.rstrip(b"\r\n")).hexdigest()
