"""Bounded-space online packing of documents into windows of a fixed token count.

Each partition reads its documents once, with at most ``open_windows`` windows open. A
piece goes where it leaves the least room (best fit); if it fits nowhere, the fullest
window is emitted and a new one opened. Windows still open at the end are leftovers:
they are packed again as whole items, ``FAN_IN`` partitions' worth at a time, until one
partition holds all of them.

A document of n tokens takes n + 1 places (an end token closes it) and is cut into
pieces of at most ``window`` places; every piece is kept. A result row names its pieces
(doc_id, first place, places), not their ids: the text is not moved, and only leftovers,
a bounded number per partition, are shuffled.

Defined cases: null and empty texts have no piece; rows that repeat a doc_id are packed
each; a null doc_id is carried as null; an empty table gives no window; other columns
are ignored. The result depends on how the scan splits the table, its guarantees don't:
each place of each document is in exactly one window, and no window is over-full.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import settle, workdir
from .textkit import slices
from .tokens import BYTE_BPE, ship, token_counts

FAN_IN = 16


class OpenWindows:
    """The open windows of one partition, by free room."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, size: int, pieces: list) -> tuple[int, list] | None:
        """Place pieces of ``size`` places in all; gives a window that had to leave."""
        if size == self.window:
            return size, list(pieces)
        out = None
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
            self.held[number].extend(pieces)
        else:
            if len(self.rooms) >= self.limit:
                out = self._close(0)
            number, room = self.opened, self.window
            self.opened += 1
            self.held[number] = list(pieces)
        if room == size:
            return self.window, self.held.pop(number)
        insort(self.rooms, (room - size, number))
        return out

    def _close(self, at: int) -> tuple[int, list]:
        room, number = self.rooms.pop(at)
        return self.window - room, self.held.pop(number)

    def rest(self):
        while self.rooms:
            yield self._close(0)


def pack_items(items, window: int, limit: int):
    """(used, pieces, still open) for items (size, pieces) in order."""
    windows = OpenWindows(window, limit)
    for size, pieces in items:
        gone = windows.place(size, pieces)
        if gone:
            yield *gone, False
    for used, held in windows.rest():
        yield used, held, True


def cut(doc_id, places: int, window: int):
    for start in range(0, places, window):
        size = min(window, places - start)
        yield size, [(doc_id, start, size)]


def _rows(packed, level: int, doc_type: pa.DataType):
    part = TaskContext.get().partitionId()
    buffer, seq = [], 0

    def flush():
        ids, used, still, offsets, docs, starts, sizes = [], [], [], [0], [], [], []
        for number, u, pieces, is_open in buffer:
            ids.append(f"{level}-{part}-{number}")
            used.append(u)
            still.append(is_open)
            for d, s, n in pieces:
                docs.append(d)
                starts.append(s)
                sizes.append(n)
            offsets.append(len(docs))
        struct = pa.StructArray.from_arrays([pa.array(docs, doc_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "start", "places"])
        pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(used, pa.int32()), pieces, pa.array(still, pa.bool_())], names=["window_id", "n_tokens", "pieces", "open"])

    for used, pieces, still in packed:
        buffer.append((seq, used, pieces, still))
        seq += 1
        if len(buffer) == 4096:
            yield flush()
            buffer.clear()
    if buffer:
        yield flush()


def pack(docs: DataFrame, window: int = 2048, open_windows: int = 32, tokenizer_path: str = BYTE_BPE) -> DataFrame:
    """Windows (window_id, n_tokens, pieces) over all documents."""
    spark = docs.sparkSession
    at = workdir(spark, "packing")
    ship(spark, tokenizer_path)
    doc_type = docs.schema["doc_id"].dataType
    ddl = f"window_id string, n_tokens int, pieces array<struct<doc_id:{doc_type.simpleString()},start:bigint,places:int>>, open boolean"
    arrow_type = to_arrow_type(doc_type)

    def first(batches):
        def items():
            for b in slices(batches):
                counts = token_counts(b["text"], tokenizer_path).tolist()
                for doc_id, n in zip(b["doc_id"].to_pylist(), counts):
                    if n:
                        yield from cut(doc_id, n + 1, window)

        yield from _rows(pack_items(items(), window, open_windows), 0, arrow_type)

    def merge(level: int, last: bool):
        def run(batches):
            def items():
                for b in batches:
                    for n, pieces in zip(b["n_tokens"].to_pylist(), b["pieces"].to_pylist()):
                        yield n, [(p["doc_id"], p["start"], p["places"]) for p in pieces]

            packed = pack_items(items(), window, open_windows)
            yield from _rows(((u, p, still and not last) for u, p, still in packed), level, arrow_type)

        return run

    packed = settle(docs.select("doc_id", "text").mapInArrow(first, ddl), f"{at}/0")
    done, level = [packed.where("NOT open").drop("open")], 0
    left = packed.where("open")
    while n := left.count():
        level += 1
        parts = max(1, n // (FAN_IN * open_windows))
        spread = left.repartition(parts, "window_id").sortWithinPartitions(F.desc("n_tokens"), "window_id")
        packed = settle(spread.mapInArrow(merge(level, parts == 1), ddl), f"{at}/{level}")
        done.append(packed.where("NOT open").drop("open"))
        left = packed.where("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str = BYTE_BPE) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path=tokenizer_path)
