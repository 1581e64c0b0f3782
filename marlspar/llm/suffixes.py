"""Suffix-array deduplication of byte strings that occur earlier in the corpus.

Every byte covered by a WINDOW-byte string that also starts earlier (smaller doc_id, or same document and earlier
start) is removed; strings are judged on the input. The steps:

1. Anchors. Of each window of WINDOW bytes, the ANCHOR-byte substring with the least hash is its anchor; windows
   with equal bytes have equal anchors. Anchor hashes are dealt by value; those seen twice are kept as sorted
   arrays in the shared folder and mapped into memory by the workers, with those seen more than HOT_RUNS times apart.
2. Runs. Neighbouring windows with one anchor form a run of bytes. Of runs whose anchor occurs twice, place and
   128-bit digest go to the shard of their anchor, of equal ones of a task only the earliest: equal runs count once,
   with their earliest place, and later ones are removed whole. Only where an anchor has different runs do the
   bytes of one run of each kind follow. Runs of hot anchors are divided into their windows, each dealt by its own
   bytes, so that a passage shared by a third of all documents in different contexts loads no single shard.
3. Shards. These runs are written to a task's own file as they come and put through external induced suffix sorting
   (`induced`): text, queues, seeds and order go to disk beyond a memory limit. A chain of suffixes with a common
   prefix of WINDOW bytes or more is one string; all places but the earliest are removed.
4. Removed intervals are merged by document into sorted arrays in the shared folder, mapped by the workers that
   then read the texts once more. Texts themselves are never shuffled.

Cases: null texts are empty; texts shorter than WINDOW lose nothing; of repeated rows (equal doc_id and text) none
starts earlier, so they lose nothing to each other and the same to others; a row whose doc_id is null stands in no
order: it loses nothing and takes nothing from others; overlapping repeats count; a table without repeats or
without rows passes unchanged; only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import QUEUE_BYTES, InducedSorter, spill_file
from .scan import U64, digests, mix, prefix_sums, span_hashes, text_slices
from .shared import dropped, map_file, prepare, put_bytes, remove, scratch, stored

WINDOW, ANCHOR = 100, 32
#: An anchor with more runs than this is hot.
HOT_RUNS = 1 << 15
_SPAN = WINDOW - ANCHOR + 1
#: Position bits of the packed (hash, position) minimum; slices are cut to less.
_PLACE = 26
#: Windows of one huge text that are taken at a time.
_PART = 2 << 20
_FLUSH_BYTES = 4 << 20
#: Bytes of text in one vectorised step, which takes some 70 times as much memory.
_SLICE = 1 << 19


def window_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (row, first window, last window + 1, anchor hash) over a slice's bytes."""
    n = len(data)
    if n > _PART + WINDOW and len(offsets) == 2:  # one huge text: windows by parts of their starts
        parts = [(a, window_anchors(data[a : a + _PART + WINDOW - 1], np.array([0, len(data[a : a + _PART + WINDOW - 1])]))) for a in range(0, n - WINDOW + 1, _PART)]
        return tuple(np.concatenate([p[k] + (a if k in (1, 2) else 0) for a, p in parts]) if k < 3 else np.concatenate([p[k] for _, p in parts]) for k in range(4))
    if n < WINDOW:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),)
    sums = prefix_sums(data)
    starts = np.arange(n - ANCHOR + 1)
    h = span_hashes(sums, starts, starts + ANCHOR)
    low = (h >> U64(_PLACE)) << U64(_PLACE) | starts.astype(U64)
    size, have = _SPAN, 1
    while have * 2 <= size:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < size:
        low = np.minimum(low[: len(low) - (size - have)], low[size - have :])
    place = (low & U64((1 << _PLACE) - 1)).astype(np.int64)  # of window p, for p in 0 .. n - WINDOW
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + WINDOW <= row_end
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),)
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]]))))
    first = at[edge]
    last = at[np.append(edge[1:], len(at)) - 1] + 1
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first, last, h[place[first]]


def _deal(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values ^ U64(0x2545F4914F6CDD1D)) % U64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return order, first, sorted_[first]


def _anchor_rows(buckets: int):
    """(bucket, hashes, counts) of the anchors, counted up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)  # 255 or more of them here: hot soon enough
            order, first, names = _split(_deal(h, buckets))
            columns = [[p.tobytes() for p in np.split(x[order], first[1:])] for x in (h, n)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "hashes", "counts"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch, size=_SLICE):
                kept.append(window_anchors(data, offsets)[3])
                if sum(map(len, kept)) * 8 > _FLUSH_BYTES:
                    yield flush()
                    kept = []
        if sum(map(len, kept)):
            yield flush()

    return run


def _write_twice(folder: str, hot_runs: int):
    """Stores a bucket's anchors that occur twice, and the hot ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(b, U64) for b in pdf["hashes"]])
        n = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["counts"]]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, n = h[first], np.add.reduceat(n, first)
        bucket = int(pdf["bucket"].iloc[0])
        put_bytes(folder, f"{bucket}.anchors", h[n > 1].tobytes())
        put_bytes(folder, f"{bucket}.hot", h[n > hot_runs].tobytes())
        return pd.DataFrame({"bucket": [bucket], "n": [int((n > 1).sum())], "hot": [int((n > hot_runs).sum())]})

    return run


_ENTRY = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i4")])
_WANTED = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<i8")])


def _runs(batch: pa.RecordBatch, buckets: int, lookup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, entries without digests, first byte, last byte + 1, slice's bytes) of the runs of a batch that `lookup(bucket, entries)` takes."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for lo, _, data, offsets in text_slices(batch, size=_SLICE):
        row, first, last, h = window_anchors(data, offsets)
        if not len(h):
            continue
        entries = np.zeros(len(h), _ENTRY)
        end = last + WINDOW - 1
        entries["anchor"], entries["doc"], entries["start"], entries["size"] = h, ids[lo + row], first - offsets[row], end - first
        order, cut, names = _split(_deal(h, buckets))
        hit = np.zeros(len(h), bool)
        for name, part in zip(names.tolist(), np.split(order, cut[1:]), strict=True):
            hit[part] = lookup(name, entries[part])
        if hit.any():
            yield _deal(h[hit], buckets), entries[hit], first[hit], end[hit], data


def _in_order(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by anchor, content and place without repeated rows; where a new anchor, and a new content, begins."""
    e = e[np.lexsort((e["start"], e["doc"], e["more"], e["content"], e["anchor"]))]
    e = e[np.concatenate(([True], e[1:] != e[:-1]))]  # repeated rows have equal places
    new_anchor = np.concatenate(([True], e["anchor"][1:] != e["anchor"][:-1]))
    return e, new_anchor, new_anchor | np.concatenate(([True], (e["content"][1:] != e["content"][:-1]) | (e["more"][1:] != e["more"][:-1])))


def _windows(entries: np.ndarray, first: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all windows of runs, dealt by their own bytes, and where each starts in the data."""
    count = entries["size"].astype(np.int64) - WINDOW + 1
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = entries[np.repeat(np.arange(len(entries)), count)]
    at = np.repeat(first, count) + step
    out["start"] += step
    out["size"] = WINDOW
    both = digests(data, at, at + WINDOW)
    out["content"], out["more"] = both[:, 0], both[:, 1]
    out["anchor"] = mix(both[:, 0] + U64(1))
    return out, at


def _run_rows(folder: str, buckets: int, filled: frozenset[int], hot: frozenset[int]):
    """(bucket, entries): place and digest of the runs whose anchor occurs twice, and (bucket, intervals) of what is known to be later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, np.ndarray] = {}

        def among(name: int, kind: str, some: frozenset[int], anchors: np.ndarray) -> np.ndarray:
            if name not in some:
                return np.zeros(len(anchors), bool)
            key = f"{name}.{kind}"
            if key not in maps:
                maps[key] = np.frombuffer(map_file(folder, key), U64)
            k = np.minimum(np.searchsorted(maps[key], anchors), len(maps[key]) - 1)
            return maps[key][k] == anchors

        kept: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            e, _, new = _in_order(np.concatenate(kept))
            later = e[~new]
            rows = [(int(r.bucket), b"", r.intervals) for r in _interval_rows(*merge(later["doc"], later["start"], later["start"] + later["size"]), buckets).itertuples()]
            e = e[new]
            order, first, names = _split(_deal(e["anchor"], buckets))
            rows += [(k, p.tobytes(), b"") for k, p in zip(names.tolist(), np.split(e[order], first[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "entries", "intervals"])

        for batch in batches:
            for bucket, entries, first, end, data in _runs(batch, buckets, lambda name, e: among(name, "anchors", filled, e["anchor"])):
                both = digests(data, first, end)
                entries["content"], entries["more"] = both[:, 0], both[:, 1]
                crowded = np.zeros(len(entries), bool)
                for name in np.unique(bucket[np.isin(bucket, [*hot])]).tolist() if hot else ():
                    part = np.flatnonzero(bucket == name)
                    crowded[part] = among(name, "hot", hot, entries["anchor"][part])
                if crowded.any():
                    kept.append(_windows(entries[crowded], first[crowded], data)[0])
                    held += kept[-1].nbytes
                kept.append(entries[~crowded])
                held += kept[-1].nbytes
                if held > _FLUSH_BYTES:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()

    return run


def _group_runs(folder: str, buckets: int):
    """Equal runs: all but the earliest are removed whole. Earliest runs whose anchor has other runs too are wanted in a shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = int(pdf["bucket"].iloc[0])
        out = [pd.DataFrame({"bucket": name, "intervals": [x for x in pdf["intervals"] if x]})]
        parts = [np.frombuffer(b, _ENTRY) for b in pdf["entries"] if b]
        wanted = np.empty(0, _WANTED)
        if parts:
            e, new_anchor, new = _in_order(np.concatenate(parts))
            group = np.cumsum(new_anchor) - 1
            contents = np.bincount(group, weights=new).astype(np.int64)
            own = e[new & (contents[group] > 1)]
            wanted = np.empty(len(own), _WANTED)
            for c in _WANTED.names:
                wanted[c] = own[c]
            later = e[~new]
            out.append(_interval_rows(*merge(later["doc"], later["start"], later["start"] + later["size"]), buckets))
        if len(wanted):
            put_bytes(folder, f"{name}.wanted", np.sort(wanted).tobytes())
            out.append(pd.DataFrame({"bucket": [-1 - name], "intervals": [b""]}))
        return pd.concat(out)

    return run


def _shard_rows(folder: str, buckets: int, filled: frozenset[int]):
    """(bucket, places, bytes) of the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}

        def wanted(name: int, entries: np.ndarray) -> np.ndarray | bool:
            if name not in filled:
                return False
            if name not in maps:
                maps[name] = np.frombuffer(map_file(folder, f"{name}.wanted"), _WANTED)
            table = maps[name]
            asked = np.empty(len(entries), _WANTED)
            for c in _WANTED.names:
                asked[c] = entries[c]
            # places of one anchor: few, so that a range of equal anchors is searched by whole keys
            k = np.minimum(_search(table, asked), len(table) - 1)
            return table[k] == asked

        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            runs, data = np.concatenate([r for _, r, _ in kept]), np.concatenate([d for _, _, d in kept])
            order, first, names = _split(np.concatenate([b for b, _, _ in kept]))
            ends = np.cumsum(runs["size"].astype(np.int64))
            places, blobs = [], []
            for part in np.split(order, first[1:]):
                length = runs["size"][part].astype(np.int64)
                pick = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(ends[part] - length, length)
                places.append(runs[part].tobytes())
                blobs.append(data[pick].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(places, pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "places", "bytes"])

        for batch in batches:
            for bucket, entries, first, end, data in _runs(batch, buckets, wanted):
                runs = np.empty(len(entries), _RUN)
                for c in _RUN.names:
                    runs[c] = entries[c]
                length = end - first
                pick = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
                kept.append((bucket, runs, data[pick]))
                size += len(pick)
                if size > _FLUSH_BYTES:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return run


_RUN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("size", "<i4")])


def _moved(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a sorted row's place is another than the previous one's; repeated rows have equal places."""
    return np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))


def _search(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of structured keys in a sorted table, field by field (numpy has no fast order for whole structures)."""
    low, high = (np.searchsorted(table["anchor"], asked["anchor"], side) for side in ("left", "right"))
    while len(todo := np.flatnonzero(low < high)):
        middle = (low[todo] + high[todo]) // 2
        t, x = table[middle], asked[todo]
        less = (t["doc"] < x["doc"]) | (t["doc"] == x["doc"]) & (t["start"] < x["start"])
        low[todo[less]], high[todo[~less]] = middle[less] + 1, middle[~less]
    return low


class Shard:
    """The runs of one shard: bytes go to a file as they come, places stay (24 bytes for each run of 100 bytes or more)."""

    def __init__(self, queue_bytes: int = QUEUE_BYTES):
        self._runs: list[np.ndarray] = []
        self._blocks: list[int] = []
        self._file, self._limit = spill_file(), queue_bytes
        self.spilled = self.levels = 0

    def add(self, runs: np.ndarray, data) -> None:
        self._runs.append(runs)
        self._blocks.append(len(data))
        self._file.write(data)

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._file.seek(0)
        for runs, n in zip(self._runs, self._blocks, strict=True):
            yield np.frombuffer(self._file.read(n), np.uint8), np.cumsum(runs["size"].astype(np.int64))

    def repeated(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (doc, start, end) of the bytes to remove."""
        total = sum(self._blocks) + sum(map(len, self._runs))
        sorter = InducedSorter.of_parts(self._parts(), total, self._limit)
        runs = np.concatenate(self._runs)
        self._file.close()
        size = runs["size"].astype(np.int64)
        part_start = np.cumsum(size + 1) - size - 1
        first: tuple[int, int] | None = None  # the earliest place of the chain that the last block ended in
        last = -1
        for pos, lcp in sorter.stream():
            linked = lcp >= WINDOW
            if linked[0] and first is None:  # the chain begins with the last block's last suffix
                pos, linked = np.concatenate(([last], pos)), np.concatenate(([False], linked))
            last = int(pos[-1])
            chain = np.flatnonzero(linked)
            # common prefixes may reach over the end of a part; then no window begins at either place
            part = np.searchsorted(part_start, pos[chain], "right") - 1
            linked[chain[pos[chain] - part_start[part] + WINDOW > size[part]]] = False
            chain = np.flatnonzero(linked)
            member = np.zeros(len(pos), bool)
            member[chain] = True
            member[chain[chain > 0] - 1] = True
            at = np.flatnonzero(member)
            if not len(at):
                first = None
                continue
            part = np.searchsorted(part_start, pos[at], "right") - 1
            doc, start = runs["doc"][part], runs["start"][part] + pos[at] - part_start[part]
            group = np.cumsum(~linked[at])
            if first is not None and linked[0]:
                doc, start, group = np.concatenate(([first[0]], doc)), np.concatenate(([first[1]], start)), np.concatenate(([group[0]], group))
            order = np.lexsort((start, doc, group))
            group, doc, start = group[order], doc[order], start[order]
            head = np.concatenate(([True], group[1:] != group[:-1]))
            k = np.flatnonzero(~head & _moved(doc, start))
            if len(k):
                yield doc[k], start[k], start[k] + WINDOW
            first = None
            if member[-1]:
                h = np.flatnonzero(head)[-1]
                first = int(doc[h]), int(start[h])
        self.spilled, self.levels = sorter.spilled, sorter.levels


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted by document and start, with those that touch or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    # running maximum of ends within a document: shift documents apart
    number = np.cumsum(change) - 1
    apart = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart) - apart
    begins = change.copy()
    begins[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(begins)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _interval_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pd.DataFrame:
    if not len(doc):
        return pd.DataFrame({"bucket": np.empty(0, np.int32), "intervals": []})
    order, first, names = _split(_deal(doc.view(U64), buckets))
    return pd.DataFrame({"bucket": names.astype(np.int32), "intervals": [p.tobytes() for p in np.split(np.stack([doc, start, end], 1)[order], first[1:])]})


def _shards(buckets: int, queue_bytes: int):
    """(bucket, intervals) of shards whose rows (bucket, places, bytes) come one shard after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: Shard) -> Iterator[pa.RecordBatch]:
            kept, size = [], 0
            blocks = shard.repeated()
            while True:
                block = next(blocks, None)
                if block is not None:
                    kept.append(merge(*block))
                    size += len(kept[-1][0]) * 24
                if kept and (block is None or size > _FLUSH_BYTES):
                    out = _interval_rows(*merge(*(np.concatenate([k[j] for k in kept]) for j in range(3))), buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"].to_numpy(), pa.int32()), pa.array([*out["intervals"]], pa.binary())], ["bucket", "intervals"])
                    kept, size = [], 0
                if block is None:
                    return

        now, shard = None, None
        for batch in batches:
            for name, places, data in zip(batch.column("bucket").to_pylist(), batch.column("places"), batch.column("bytes"), strict=True):
                if name != now:
                    if shard is not None:
                        yield from found(shard)
                    now, shard = name, Shard(queue_bytes)
                shard.add(np.frombuffer(places.as_py(), _RUN), data.as_buffer())
        if shard is not None:
            yield from found(shard)

    return run


def _write_intervals(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in pdf["intervals"]])
        table = np.stack(merge(*table.T), 1)
        bucket = int(pdf["bucket"].iloc[0])
        put_bytes(folder, f"{bucket}.intervals", table.tobytes())
        return pd.DataFrame({"bucket": [bucket], "n": [len(table)]})

    return run


def removals(docs: DataFrame, queue_bytes: int = QUEUE_BYTES, hot_runs: int = HOT_RUNS) -> tuple[str, int, frozenset[int]]:
    """Folder, number of buckets and filled buckets of the removed intervals by document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    # shards of some 3 MB of runs; larger ones go to disk
    buckets = max(8, 8 * docs.rdd.getNumPartitions())
    anchors, out = scratch(spark, "anchors"), scratch(spark, "intervals")
    twice = docs.mapInArrow(_anchor_rows(buckets), "bucket int, hashes binary, counts binary").groupBy("bucket").applyInPandas(_write_twice(anchors, hot_runs), "bucket int, n long, hot long")
    # one row for each bucket comes back
    sizes = twice.collect()
    filled, hot = (frozenset(r["bucket"] for r in sizes if r[c]) for c in ("n", "hot"))
    entries = docs.mapInArrow(_run_rows(anchors, buckets, filled, hot), "bucket int, entries binary, intervals binary")
    whole = stored(entries.groupBy("bucket").applyInPandas(_group_runs(anchors, buckets), "bucket int, intervals binary"), "whole")
    # a negative bucket names a shard that is wanted
    shards = frozenset(-1 - r["bucket"] for r in whole.where("bucket < 0").select("bucket").collect())
    runs = docs.mapInArrow(_shard_rows(anchors, buckets, shards), "bucket int, places binary, bytes binary")
    runs = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = runs.mapInArrow(_shards(buckets, queue_bytes), "bucket int, intervals binary").unionByName(whole.where("bucket >= 0"))
    written = found.groupBy("bucket").applyInPandas(_write_intervals(out), "bucket int, n long")
    have = frozenset(r["bucket"] for r in written.collect() if r["n"])
    remove(spark, anchors)
    dropped(whole)
    return out, buckets, have


def _kept(folder: str, buckets: int, have: frozenset[int]):
    """An iterator over (first row, last row + 1, [(text bytes, kept bytes, number of spans)]) of a batch."""
    maps: dict[int, np.ndarray] = {}

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[int, bytes, int]]]]:
        column = batch.column("doc_id").cast(pa.int64())
        ids, none = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in text_slices(batch, size=_SLICE):
            part = _deal(ids[lo:hi].view(U64), buckets)
            out = []
            for k in range(hi - lo):
                text, name = data[offsets[k] : offsets[k + 1]], int(part[k])
                spans = np.empty((0, 2), np.int64)
                if name in have and not none[lo + k]:
                    if name not in maps:
                        maps[name] = np.frombuffer(map_file(folder, f"{name}.intervals"), np.int64).reshape(-1, 3)
                    own = maps[name][:, 0]
                    a, b = np.searchsorted(own, ids[lo + k], "left"), np.searchsorted(own, ids[lo + k], "right")
                    spans = maps[name][a:b, 1:]
                cut = np.zeros(len(text) + 1, np.int8)
                cut[spans[:, 0]] += 1
                cut[spans[:, 1]] -= 1
                out.append((len(text), text[np.cumsum(cut[:-1]) == 0].tobytes() if len(spans) else text.tobytes(), len(spans)))
            yield lo, hi, out

    return rows


def deduplicate(docs: DataFrame, queue_bytes: int = QUEUE_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    where = removals(docs, queue_bytes, hot_runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(*where)
        for batch in batches:
            for lo, hi, rows in kept(batch):
                size, removed = [n for n, _, _ in rows], [n - len(t) for n, t, _ in rows]
                columns = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([s for _, _, s in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, t, _ in rows])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def rewrite(docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out, in their own columns; n_chars, if any, is counted anew.

    Characters that a cut divides go too; documents of which nothing is left go whole; a null text stays null, with its n_chars.
    """
    where = removals(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(*where)
        for batch in batches:
            for lo, hi, rows in kept(batch):
                part = batch.slice(lo, hi - lo)
                texts = [t.decode("utf-8", "ignore") for _, t, _ in rows]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                null = columns["text"].is_null()
                columns["text"] = pc.if_else(null, columns["text"], pa.array(texts, part.schema.field("text").type))
                if "n_chars" in columns:
                    columns["n_chars"] = pc.if_else(null, columns["n_chars"], pa.array([len(t) for t in texts]).cast(part.schema.field("n_chars").type))
                out = pa.RecordBatch.from_arrays([*columns.values()], [*columns])
                yield out.filter(pa.array([bool(t) or not n for t, (n, _, _) in zip(texts, rows, strict=True)]))

    return docs.mapInArrow(run, schema)
