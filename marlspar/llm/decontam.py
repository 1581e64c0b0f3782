"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document leaks an item if some passage of it is within the item's edit budget, RATE of the item's characters.
Both are compared with A-Z lower-cased and every white space character as a space. A passage within e edits of
an item of m characters shares at least m + 1 - q - q*e of its q-grams, all on diagonals at most e apart. So the
scan looks up each document q-gram among the items', drops hits that no window could gather enough of, counts the
rest in diagonal bands (2W wide, W > e, every W: any e neighbouring diagonals lie in one), and aligns the item
within each band that meets the bound.

Items are searched in blocks of bounded size, each broadcast; documents are never joined pairwise with items.

Cases: null or empty texts leak nothing and are not leaked; items of fewer than q characters have no q-gram and leak
where they stand unchanged between characters that are neither letters nor digits (or a text's end); shorter items have a smaller budget, so that the bound stays positive; equal items are each reported; repeated
documents are judged alone; several passages of one document are each reported, of overlapping ones the closest
(then first); extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import U64, powers, text_slices
from .shared import prepare

Q = 10
RATE = 0.06
#: Text of items that one broadcast holds at most.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start_char long, end_char long, edits int"
_SCAN_BYTES = 1 << 20
#: Cells of one row of pairs that are aligned together, whatever their items' lengths.
_CELLS = 1 << 19


def characters(data: np.ndarray | bytes) -> np.ndarray:
    """Code points of UTF-8 bytes, with A-Z lower-cased and white space as a space."""
    raw = data if isinstance(data, bytes) else data.tobytes()
    out = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 65) & (out <= 90)] += 32
    out[(out >= 9) & (out <= 13) | (out == 0x85) | (out == 0xA0)] = 32
    return out


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of q characters."""
    if len(chars) < q:
        return np.empty(0, U64)
    up, down = powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, U64)
    np.cumsum((chars.astype(U64) + U64(1)) * up[: len(chars)], out=sums[1:])
    h = (sums[q:] - sums[:-q]) * down[: len(chars) - q + 1]
    return h * U64(0xD6E8FEB86659FD93)


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed to an item of m characters; at least one shared q-gram must stay certain."""
    return max(0, min(int(rate * m), (m - q) // q))


def banded(items: list[np.ndarray], texts: list[np.ndarray], widths: np.ndarray) -> np.ndarray:
    """(edits, start, end) of each item's closest passage in its text, over the diagonals 0 .. width - 1.

    All pairs advance together, one item character a step. A cell holds edits << 32 | start, so the start comes with
    the least edits; insertions along a row are a running minimum. Texts end in characters that match nothing.
    """
    sizes = np.array([len(x) for x in items])
    width, longest = int(widths.max()), int(sizes.max())
    item = np.full((len(items), longest), 0xFFFFFFFE, np.uint32)
    text = np.full((len(items), longest + width), 0xFFFFFFFF, np.uint32)
    for k, (x, t) in enumerate(zip(items, texts, strict=True)):
        item[k, : len(x)] = x
        text[k, : min(len(t), text.shape[1])] = t[: text.shape[1]]
    one = 1 << 32
    at = np.arange(width, dtype=np.int64)
    row = np.where(at < widths[:, None], at, one << 20)
    best = np.empty((len(items), 3), np.int64)
    for k in range(1, longest + 1):
        new = row + one * (text[:, k - 1 : k - 1 + width] != item[:, k - 1 : k])
        np.minimum(new[:, :-1], row[:, 1:] + one, out=new[:, :-1])
        row = np.minimum.accumulate(new - one * at, axis=1) + one * at
        if (done := np.flatnonzero(sizes == k)).size:
            j = row[done].argmin(axis=1)
            cell = row[done, j]
            best[done] = np.stack([cell >> 32, cell & (one - 1), k + j], 1)
    return best


class Index:
    """The items' q-grams: a bit table for the scan, then sorted hashes with their (item, offset) places."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q = q
        read = [(i, characters(text.encode("utf-8", "replace"))) for i, text in items if text]
        kept = [(i, c) for i, c in read if len(c) >= q]
        #: Items without a q-gram: their length, then their hash, lead to their numbers behind the others.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, (_, c) in enumerate((i, c) for i, c in read if len(c) < q):
            self.short.setdefault(len(c), {}).setdefault(int(gram_hashes(c, len(c))[0]), []).append(len(kept) + k)
        tail = [(i, c) for i, c in read if len(c) < q]
        self.ids = [i for i, _ in kept + tail]
        self.items = [c for _, c in kept]
        self.tail = [c for _, c in tail]
        self.budgets = np.array([budget(len(c), q, rate) for c in self.items], np.int64)
        sizes = np.array([len(c) for c in self.items], np.int64)
        self.bounds = sizes + 1 - q - q * self.budgets
        self.least = int(self.bounds.min()) if len(kept) else 1
        self.longest = int((sizes + self.budgets).max()) if len(kept) else 0
        hashes = [gram_hashes(c, q) for c in self.items]
        grams = np.concatenate(hashes) if hashes else np.empty(0, U64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.item, self.offset = item[order], offset[order]
        self.shift = U64(64 - max(16, min(28, int(np.ceil(np.log2(len(self.grams) + 1))) + 7)))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.grams >> self.shift).astype(np.int64)] = True

    def hits(self, chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Positions of q-grams that some item has, in clusters dense enough for the laxest bound."""
        h = gram_hashes(chars, self.q)
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            at = at[self.grams[k] == h[at]]
        if len(at):  # within one row
            at = at[np.searchsorted(rows, at, "right") == np.searchsorted(rows, at + self.q - 1, "right")]
        t = self.least
        if len(at) < t:
            return at[:0]
        dense = np.flatnonzero(at[t - 1 :] - at[: len(at) - t + 1] <= self.longest)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, dense + t, -1)
        return at[np.cumsum(mark)[:-1] > 0]

    def search(self, chars: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, start, end, edits), positions counted from the row's start."""
        rows = np.asarray(rows, np.int64)
        out = self._exact(chars, rows)
        at = self.hits(chars, rows) if self.items else ()
        if not len(at):
            return out
        k = np.searchsorted(self.grams, gram_hashes(chars, self.q)[at])
        counts = self.first[k + 1] - self.first[k]
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[k], counts)
        pos, item = np.repeat(at, counts), self.item[place]
        width = self.budgets[item] + 1
        row = np.searchsorted(rows, pos, "right") - 1
        diagonal = pos - self.offset[place] - rows[row] + (1 << 20)  # may start before the row
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        key = np.stack([np.tile(row, 2), np.tile(item, 2), np.concatenate([diagonal // width, diagonal // width - 1])], 1)
        bands, n = np.unique(key, axis=0, return_counts=True)
        bands = bands[n >= self.bounds[bands[:, 1]]]
        if not len(bands):
            return out
        sizes = np.array([len(self.items[i]) for i in bands[:, 1]], np.int64)
        order = np.argsort(sizes, kind="stable")
        bands, sizes = bands[order], sizes[order]
        # batches by the room that they take: texts and cells of all pairs of one
        room = np.cumsum(sizes + 8 * (4 * self.budgets[bands[:, 1]] + 3))
        for part in np.split(bands, np.flatnonzero(np.diff(room // _CELLS)) + 1):
            r, i, band = part.T
            e = self.budgets[i]
            low = band * (e + 1) - (1 << 20) - e  # the lowest diagonal
            begin, end = rows[r], rows[r + 1]
            width = 2 * (e + 1) + 2 * e + 1
            texts = []
            for k in range(len(part)):
                a, b = int(begin[k] + low[k]), int(begin[k] + low[k] + width[k] + len(self.items[i[k]]))
                t = chars[max(a, begin[k]) : max(begin[k], min(b, end[k]))]
                texts.append(np.concatenate((np.full(max(0, begin[k] - a), 0xFFFFFFFF, np.uint32), t)) if a < begin[k] else t)
            for k, (edits, a, b) in enumerate(banded([self.items[x] for x in i], texts, width).tolist()):
                if edits <= e[k]:
                    size = int(end[k] - begin[k])
                    found.setdefault((int(r[k]), int(i[k])), []).append((edits, min(size, max(0, a + int(low[k]))), min(size, max(0, b + int(low[k])))))
        for (k, item), spans in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(set(spans)):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((k, item, a, b, edits))
        return out


    def _exact(self, chars: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Places of the items without q-grams, as whole words."""
        out = []
        for m, table in self.short.items():
            h = gram_hashes(chars, m)
            for at in np.flatnonzero(np.isin(h, np.fromiter(table, U64))).tolist():
                row = int(np.searchsorted(rows, at, "right")) - 1
                begin, end = int(rows[row]), int(rows[row + 1])
                around = [chr(chars[k]) for k in (at - 1, at + m) if begin <= k < end]
                if at + m > end or any(c.isalnum() for c in around):
                    continue
                out += [(row, item, at - begin, at + m - begin, 0) for item in table[int(h[at])] if np.array_equal(self.tail[item - len(self.items)], chars[at : at + m])]
        return out


def leaks(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits) of every leaked passage in whole texts."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in _indexes(items, q, rate, block_bytes):
        found = docs.mapInArrow(_scan(index), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(items: DataFrame, q: int, rate: float, block_bytes: int) -> Iterator:
    """Broadcast indexes of blocks of items, each of about block_bytes of text."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield items.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in part.collect()], q, rate))


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in text_slices(batch, size=_SCAN_BYTES):
                chars = characters(data)
                lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                found = own.search(chars, lead[offsets]) if own.ids else []
                if found:
                    row, item, start, end, edits = zip(*found, strict=True)
                    columns = [ids.take(pa.array([lo + r for r in row])), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_char", "end_char", "edits"])

    return run


def clean(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a leaked passage, in their own columns; one scan for each block of items."""
    prepare(docs.sparkSession)
    schema = docs.schema
    for index in _indexes(items, q, rate, block_bytes):
        docs = docs.mapInArrow(_without(index), schema)
    return docs


def _without(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in text_slices(batch, size=_SCAN_BYTES):
                lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for found in own.search(characters(data), lead[offsets]) if own.ids else ():
                    keep[lo + found[0]] = False
            yield batch.filter(pa.array(keep))

    return run
