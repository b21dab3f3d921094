"""Packing documents into sequences: best fit, certified by lower bounds.

Pieces are dealt at random into buckets of a few thousand, and each bucket is packed
by best-fit decreasing. Dual feasible functions give a number of sequences that no
packing of the bucket can beat. A bucket that needs no more is done but for its
emptiest sequence. The others put the emptiest sixteenth of their sequences up for
exchange: the pieces of sixteen buckets are packed again together, and so on until
one group is left. No bucket gives away more, so groups do not grow.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches, stored, temporary
from trafficlens.llm.tokens import TokenBytes

FAN_IN = 16
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, slot int"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, bucket long"


@dataclass(frozen=True)
class Packing:
    """tokenizer: path of a file; end: the id that closes each document."""

    tokenizer: str
    tokens: int = 2048
    end: int = 0
    bucket_pieces: int = 4096


def pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``tokens`` ids.

    A null or empty text is the closing id alone. Only longer documents are cut; all
    pieces but the last are full. ids_crc32 covers the ids as little-endian unsigned
    32-bit numbers. slot is a random number from the content and the row's place.
    """
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _cutter(how), _PIECE)


def packed(docs: DataFrame, how: Packing) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    Every row of ``docs`` is packed, also rows with one doc_id or none; other columns
    are ignored. The offsets of a sequence run from 0 without gaps. An empty table
    gives an empty result.
    """
    with temporary(docs):
        cut = stored(pieces(docs, how), "pieces")
        buckets = -(-cut.count() // how.bucket_pieces)
        todo = cut.withColumn("bucket", (F.col("slot") % max(1, buckets)).cast("long"))
        done, level = [], 0
        while True:
            last = buckets <= 1
            now = stored(todo.groupBy("bucket").applyInPandas(_packer(how, level, last), _PACKED), "packed", keep=True)
            done.append(now.filter("NOT open"))
            if last:
                break
            buckets, level = -(-buckets // FAN_IN), level + 1
            todo = now.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("open", "bucket")


def _cutter(how: Packing):
    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, end = TokenBytes.of(how.tokenizer), how.end.to_bytes(4, "little")
        size, row = 4 * how.tokens, 0
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encoded(batch.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    crc = zlib.crc32(part)
                    row += 1
                    slot = zlib.crc32(row.to_bytes(8, "little"), crc) >> 1
                    out.append((doc_id, k, at // 4, len(part) // 4, crc, slot))
            columns = zip(*out, strict=True) if out else ([],) * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "slot")
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return cut


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room."""
    bins = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins with that much room
    rooms, used = 0, 0  # bit r of rooms: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        bins[i] = b
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of any packing, by two families of dual feasible functions.

    With one, items above capacity - t count as whole, items below t as nothing, the
    rest by length, where items above one half keep the room beside them from being
    counted twice. With the other, lengths are rounded down to multiples of 1 / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    total = np.arange(capacity + 1) * count
    upto_n, upto_sum = np.cumsum(count), np.cumsum(total)
    half = capacity // 2
    t = np.arange(0, half + 1)
    whole = upto_n[capacity] - upto_n[capacity - t]
    large = upto_n[capacity - t] - upto_n[half]
    below = np.where(t > 0, upto_sum[np.maximum(t - 1, 0)], 0)
    middle = upto_sum[half] - below
    room = large * capacity - (upto_sum[capacity - t] - upto_sum[half])
    best = int((whole + large + np.maximum(0, -(-(middle - room) // capacity))).max())
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        scaled = x * (k + 1)
        # k * capacity times the value of the function
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-(value * count).sum() // (k * capacity))))
    return best


def _packer(how: Packing, level: int, last: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "slot" if "slot" in rows else "sequence_id"])
        lengths = rows["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, how.tokens)
        if level and bins.max() + 1 > rows["sequence_id"].nunique():
            bins = pd.factorize(rows["sequence_id"])[0]  # the exchange did not help
        bucket, used = int(rows["bucket"].iloc[0]), int(bins.max()) + 1
        gap = used - fewest_bins(lengths, how.tokens)
        free = np.full(used, how.tokens) - np.bincount(bins, lengths, used).astype(np.int64)
        # a certified bucket only passes its emptiest sequence on
        give = 0 if last else max(1, used // FAN_IN if gap else 0)
        given = np.zeros(used, bool)
        given[np.argsort(-free, kind="stable")[:give]] = True
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (level << 56) + (bucket << 24) + bins
        out["offset"], out["open"], out["bucket"] = offset, given[bins], bucket
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return pack
