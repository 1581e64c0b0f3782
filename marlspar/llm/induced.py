"""External induced suffix sorting with common-prefix values, bounded in depth.

The suffixes of a string are split into types: S suffixes are smaller than their right neighbour, L suffixes
larger; an S suffix after an L suffix is a seed. An ascending sweep over first characters induces the order of all L
suffixes from the seeds, a descending one that of all S suffixes: a suffix taken in order passes its left neighbour
to the queue of that neighbour's character. The recursion is that of induced sorting:

1. Seeds go into the sweeps in any order of equal first characters. The sweeps put the seed substrings (from a
   seed to the next) in order, and neighbours that are equal get one name.
2. The names, in the order of the text, are a string of a third of the length at most on average and half in the
   worst case. Its suffixes are sorted: by the same class if it is longer than memory allows, otherwise by doubling
   of what is still equal. Names that differ all need neither.
3. Seeds in this order, with the common prefix of each with the one before, go into the sweeps again, which give
   the order of all suffixes and their common prefixes.

The queue is a priority queue by character whose equal keys keep their order. Its entries are suffix tuples
(position, common prefix with the entry before). It holds a bounded number of bytes: beyond, entries wait in files
and come back block by block when their character's turn comes. Beyond the same limit the text, the types, the order of
the L suffixes and the seeds are files too, read by blocks or through maps. The common prefix of two entries is one
more than the least value between their right neighbours, found by a range minimum over the block and what came since
the character's last entry. Only the first `DEPTH` characters are ordered and counted. Files are private to a task, lie
in Spark's local folders (where its own spills go), are unlinked at once, and are made anew if a task is retried.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Characters by which suffixes are ordered at least.
DEPTH = 104
_CAP = 250
#: Bytes of tuples that a queue holds in memory, and a quarter of those that arrays may take before they are files.
QUEUE_BYTES = 192 << 20
#: Tuples that are taken from a queue or a file at a time.
BLOCK = 1 << 18


def _folder() -> str | None:
    dirs = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return dirs if dirs and os.path.isdir(dirs) else None


def spill_file():
    """A nameless file for what a task does not hold in memory."""
    return tempfile.TemporaryFile(dir=_folder())  # unlinked at once: nothing stays behind


def _array(n: int, dtype, limit: int) -> np.ndarray:
    """Zeros in memory, or in a mapped file if they take more than the limit."""
    dtype = np.dtype(dtype)
    if n * dtype.itemsize <= limit:
        return np.zeros(n, dtype)
    with spill_file() as f:
        f.truncate(n * dtype.itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Log:
    """Tuples (position, value) in order: appended at the end, read by blocks from either end."""

    def __init__(self, limit: int):
        self._limit, self._blocks, self._held = limit, [], 0
        self._f, self._sizes = None, []
        self.spilled = 0

    def append(self, pos: np.ndarray, value: np.ndarray) -> None:
        for a in range(0, len(pos), BLOCK):
            self._blocks.append((pos[a : a + BLOCK], value[a : a + BLOCK]))
            self._held += 9 * len(self._blocks[-1][0])
        if self._held > self._limit:
            self._f = self._f or spill_file()
            self._f.seek(0, os.SEEK_END)
            for p, v in self._blocks:
                self._f.write(np.asarray(p, np.int64).tobytes() + np.asarray(v, np.uint8).tobytes())
                self._sizes.append(len(p))
            self.spilled += self._held
            self._blocks, self._held = [], 0

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last to the first, each in its own order."""
        yield from reversed(self._blocks)
        at = 9 * sum(self._sizes)
        for n in reversed(self._sizes):
            at -= 9 * n
            self._f.seek(at)
            yield np.frombuffer(self._f.read(8 * n), np.int64), np.frombuffer(self._f.read(n), np.uint8)

    def forwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for n in self._sizes:
            self._f.seek(at)
            at += 9 * n
            yield np.frombuffer(self._f.read(8 * n), np.int64), np.frombuffer(self._f.read(n), np.uint8)
        yield from self._blocks


class BucketQueue:
    """Keys in order, first in, first out for each; above the memory limit the largest keys' tuples wait in files."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self._memory: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self._bytes: dict[int, int] = {}
        self._files: dict[int, list] = {}  # file, place to read from
        self._held, self._limit = 0, limit
        self.spilled = 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> bool:
        """Append tuples; True if the key had none."""
        fresh = key not in self._memory and key not in self._files
        self._memory.setdefault(key, []).append((pos, lcp))
        size = pos.nbytes + lcp.nbytes
        self._bytes[key] = self._bytes.get(key, 0) + size
        self._held += size
        while self._held > self._limit:
            largest = max(self._bytes, key=self._bytes.__getitem__)
            f = self._files.setdefault(largest, [spill_file(), 0])[0]
            f.seek(0, os.SEEK_END)
            p, v = (np.concatenate(x) for x in zip(*self._memory.pop(largest), strict=True))
            for a in range(0, len(p), BLOCK):
                f.write(np.int64(len(p[a : a + BLOCK])).tobytes() + p[a : a + BLOCK].tobytes() + v[a : a + BLOCK].tobytes())
            self.spilled += self._bytes[largest]
            self._held -= self._bytes.pop(largest)
        return fresh

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The key's next tuples in order, or None."""
        if own := self._files.get(key):
            f, at = own
            f.seek(at)
            if size := f.read(8):
                n = int(np.frombuffer(size, np.int64)[0])
                own[1] += 8 + 9 * n
                return np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(n), np.uint8).copy()
            f.close()
            del self._files[key]
        if key not in self._memory:
            return None
        self._held -= self._bytes.pop(key)
        blocks = self._memory.pop(key)
        return np.concatenate([p for p, _ in blocks]), np.concatenate([v for _, v in blocks])


class RangeMinimum:
    """Least values of ranges [a, b) of small integers, b > a, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self._levels = [values]
        while (half := 1 << len(self._levels) - 1) * 2 <= len(values):
            last = self._levels[-1]
            self._levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self._levels[0].dtype)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(len(self._levels) + 1))
        for k, table in enumerate(self._levels):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                out[at] = np.minimum(table[a[at]], table[b[at] - (1 << k)])
        return out


def common_prefixes(x: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes p[k] and q[k], up to `most`; of pairs still equal, eight more characters a round."""
    out = np.zeros(len(p), np.int64)
    at = np.arange(len(p))
    last = len(x) - 1
    eight = np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) if x.dtype == np.uint8 and len(x) > 8 else None
    for depth in range(0, most, 8):
        if not len(at):
            break
        a, b = p[at] + depth, q[at] + depth
        n = np.empty(len(at), np.int64)
        inside = np.maximum(a, b) <= last - 7 if eight is not None else np.zeros(len(at), bool)
        if inside.any():
            differ = eight[a[inside]] ^ eight[b[inside]]
            lowest = differ & (~differ + np.uint64(1))
            n[inside] = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
        if not inside.all():
            i, j = a[~inside][:, None] + np.arange(8), b[~inside][:, None] + np.arange(8)
            same = (x[np.minimum(i, last)] == x[np.minimum(j, last)]) & (i <= last) & (j <= last)
            n[~inside] = np.where(same.all(1), 8, same.argmin(1))
        out[at] = depth + n
        at = at[n == 8]
    return np.minimum(out, most)


def double(names: np.ndarray, most: int) -> np.ndarray:
    """Suffixes of a short string of names >= 0 in order of their first `most` names or more, by doubling.

    Each round sorts only suffixes that are still equal, by the rank of the one that many names further on.
    """
    rank = names.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    if not len(order):
        return order
    own = rank[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank[order] = 1 + np.repeat(first, np.diff(np.append(first, len(own))))  # the place of the first equal one
    width = 1
    sizes = np.bincount(rank)
    at = np.flatnonzero(sizes[rank[order]] > 1)  # places in `order` that are not settled
    while len(at) and width < most:
        who = order[at]
        behind = np.where(who + width < len(rank), rank[np.minimum(who + width, len(rank) - 1)], 0)
        own = rank[who]
        key = own * (len(rank) + 1) + behind
        by = np.argsort(key, kind="stable")
        who, own, key = who[by], own[by], key[by]
        order[at] = who
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(who)))
        group = np.concatenate(([True], own[1:] != own[:-1]))
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(group, np.arange(len(who)), 0))
        rank[who] = own + np.repeat(place[first], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


class InducedSorter:
    """Suffix order of a string of small numbers >= 0 that ends in its least one."""

    def __init__(self, x: np.ndarray, queue_bytes: int = QUEUE_BYTES, most: int = DEPTH):
        self.x, self._limit, self._most = x, queue_bytes, most
        self.spilled = self.levels = 0

    @classmethod
    def of_parts(cls, blocks: Iterator[tuple[np.ndarray, np.ndarray]], size: int, queue_bytes: int = QUEUE_BYTES) -> InducedSorter:
        """From (bytes below 255, ends of parts among them) blocks of `size` bytes and parts; each part is closed by a 0."""
        x = _array(size, np.uint8, queue_bytes // 4)
        at = 0
        for data, ends in blocks:
            starts = np.concatenate(([0], ends[:-1]))
            x[at + np.arange(len(data)) + np.repeat(np.arange(len(ends)), ends - starts)] = data + np.uint8(1)
            at += len(data) + len(ends)
        return cls(x, queue_bytes)

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, common prefixes with the one before in this order), from the greatest to the least suffix."""
        n = len(self.x)
        if n < 2:
            if n:
                yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
            return
        self._types()
        seeds = self._seeds()
        if len(seeds):
            seeds = self._sorted_seeds(seeds)
        yield from self._sweeps(self._with_prefixes(seeds))

    def _types(self) -> None:
        x, n = self.x, len(self.x)
        self._is_l = _array(n, np.bool_, self._limit // 4)
        carry = True  # the last suffix is larger than the empty one behind it
        self._is_l[n - 1] = True
        for b in range(n - 1, 0, -BLOCK):
            a = max(0, b - BLOCK)
            here, behind = x[a:b], x[a + 1 : b + 1]
            differ = here != behind
            change = np.flatnonzero(differ)
            falls = here[change] > behind[change]
            own = np.append(falls, carry)[np.cumsum(differ) - differ]  # that of the next change
            self._is_l[a:b] = own
            carry = bool(own[0])

    def _seeds(self) -> np.ndarray:
        n, out = len(self.x), []
        count = sum(int((~self._is_l[a + 1 : a + 1 + BLOCK] & self._is_l[a : a + BLOCK][: len(self._is_l[a + 1 : a + 1 + BLOCK])]).sum()) for a in range(0, n - 1, BLOCK))
        out = _array(count, np.int64, self._limit // 4)
        at = 0
        for a in range(0, n - 1, BLOCK):
            right = self._is_l[a + 1 : a + 1 + BLOCK]
            own = np.flatnonzero(~right & self._is_l[a : a + BLOCK][: len(right)]) + a + 1
            out[at : at + len(own)] = own
            at += len(own)
        return out

    def _sorted_seeds(self, seeds: np.ndarray) -> np.ndarray:
        """Seeds in the order of their suffixes."""
        x, count = self.x, len(seeds)
        end = np.append(seeds[1:], len(x) - 1)  # where each seed substring ends
        order = np.argsort(x[seeds], kind="stable")
        first = x[seeds[order]]
        lcp = np.concatenate((np.zeros(1, bool), first[1:] == first[:-1])).astype(np.uint8)
        number_at = _array(len(x), np.int32 if count < (1 << 31) - 1 else np.int64, self._limit // 4)  # 0: no seed
        number_at[seeds] = np.arange(1, count + 1)
        # names from the greatest on: neighbours of one length that are equal up to it
        names = _array(count, np.int64, self._limit // 4)
        name, last = 0, None
        for pos, _ in self._sweeps(self._logged(seeds[order], lcp)):
            k = number_at[pos]
            pos, k = pos[k > 0], k[k > 0] - 1
            if not len(pos):
                continue
            size = end[k] - pos + 1
            both = pos if last is None else np.concatenate(([last[0]], pos))
            sizes = size if last is None else np.concatenate(([last[1]], size))
            same = np.flatnonzero(sizes[1:] == sizes[:-1])
            longest = int(sizes[same].max()) if len(same) else 0
            equal = np.zeros(len(both) - 1, bool)
            equal[same] = common_prefixes(x, both[same], both[same + 1], longest) >= sizes[same]
            fresh = ~equal if last is not None else np.concatenate(([False], ~equal))
            number = name + np.cumsum(fresh)
            names[k] = number
            name, last = int(number[-1]), (int(pos[-1]), int(size[-1]))
        np.subtract(name, names, out=names)  # now ascending
        if name + 1 == count:
            out = _array(count, np.int64, self._limit // 4)
            out[names] = seeds
            return out
        most = max(2, -(-self._most // 2))
        if 40 * count <= self._limit:
            return seeds[double(names, most)]
        # a seed substring reaches over its end by a character, so the end of the string needs a least name of its own
        text = _array(count + 1, np.int64, self._limit // 4)
        text[:count] = names
        text[:count] += 1
        inner = InducedSorter(text, self._limit, most)
        out, at = _array(count, np.int64, self._limit // 4), count
        for pos, _ in inner.stream():
            pos = pos[pos < count]
            out[at - len(pos) : at] = seeds[pos[::-1]]
            at -= len(pos)
        self.spilled += inner.spilled
        self.levels = 1 + inner.levels
        return out

    def _logged(self, pos: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(pos), BLOCK):
            yield np.asarray(pos[a : a + BLOCK]), np.asarray(value[a : a + BLOCK])

    def _with_prefixes(self, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of sorted seeds with each one's common prefix with the one before."""
        for a in range(0, len(seeds), BLOCK // 4):
            own = np.asarray(seeds[a : a + BLOCK // 4])
            before = np.concatenate((np.asarray(seeds[a - 1 : a]) if a else own[:1], own[:-1]))
            value = common_prefixes(self.x, before, own, self._most)
            if not a:
                value[0] = 0
            yield own, value.astype(np.uint8)

    def _sweeps(self, seeds: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From sorted seeds all suffixes in descending order, with common prefixes."""
        x, keys = self.x, int(self.x.max()) + 1
        lower: dict[int, Log] = {}
        queue, since = BucketQueue(self._limit), np.zeros(keys, np.uint8)
        share = max(1 << 16, self._limit // 64)
        due: list[int] = []  # characters with tuples in the queue
        # the string's last suffix is an L suffix that no other one passes on
        last = len(x) - 1
        queue.push(int(x[last]), np.array([last]), np.zeros(1, np.uint8))
        heapq.heappush(due, int(x[last]))
        waiting = self._by_character(seeds)
        ahead = next(waiting, None)
        prior = -1  # the last suffix of the ascending order so far
        while due or ahead:
            c = min(due[0] if due else keys, ahead[0] if ahead else keys)
            some = False
            while due and due[0] == c:
                heapq.heappop(due)
                while block := queue.pop(c):
                    if not some:
                        block[1][0] = 0  # nothing in common with another first character
                    some = True
                    lower.setdefault(c, Log(share)).append(*block)
                    prior = int(block[0][-1])
                    self._induce(queue, due, 1, since, *block, self._is_l, True)
            fresh = True
            while ahead and ahead[0] == c:
                pos, value = ahead[1], ahead[2].copy()
                if fresh:
                    value[0] = common_prefixes(x, np.array([prior]), pos[:1], self._most)[0] if some else 0
                fresh = False
                self._induce(queue, due, 1, since, pos, value, self._is_l, True)
                ahead = next(waiting, None)
        self.spilled += queue.spilled + sum(log.spilled for log in lower.values())

        queue, since, due = BucketQueue(self._limit), np.zeros(keys, np.uint8), []
        left = sorted(lower)
        while due or left:
            c = max(-due[0] if due else -1, left[-1] if left else -1)
            prior = -1
            while due and -due[0] == c:
                heapq.heappop(due)
                while block := queue.pop(c):
                    if prior < 0:
                        block[1][0] = 0
                    prior = int(block[0][-1])
                    self._induce(queue, due, -1, since, *block, self._is_l, False)
                    yield block
            if left and left[-1] == c:
                left.pop()
                # descending: each value moves to the entry that now comes later; the last one of a block joins it to the next
                seam = None
                for pos, value in lower.pop(c).backwards():
                    pos = pos[::-1]
                    if seam is None:
                        seam = common_prefixes(x, pos[:1], np.array([prior]), self._most)[0] if prior >= 0 else 0
                    moved = np.concatenate(([np.uint8(seam)], value[:0:-1])).astype(np.uint8)
                    seam = value[0]
                    self._induce(queue, due, -1, since, pos, moved, self._is_l, False)
                    yield pos, moved
        self.spilled += queue.spilled

    def _by_character(self, seeds: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for pos, value in seeds:
            ch = self.x[pos]
            cut = np.concatenate(([0], np.flatnonzero(ch[1:] != ch[:-1]) + 1, [len(ch)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield int(ch[a]), pos[a:b], value[a:b]

    def _induce(self, queue: BucketQueue, due: list[int], sign: int, since: np.ndarray, pos: np.ndarray, lcp: np.ndarray, is_l: np.ndarray, wanted: bool) -> None:
        """Pass on the left neighbours of a block in order; since: least value after each character's last entry."""
        before = pos - 1
        take = np.flatnonzero(before >= 0)
        take = take[is_l[before[take]] == wanted]
        least = int(lcp.min())
        if not len(take):
            np.minimum(since, least, out=since)
            return
        ch = self.x[before[take]]
        by = np.argsort(ch, kind="stable")
        ch, take = ch[by], take[by]
        fresh = np.concatenate(([True], ch[1:] != ch[:-1]))
        start = np.where(fresh, 0, np.concatenate(([0], take[:-1] + 1)))
        value = RangeMinimum(np.asarray(lcp))(start, take + 1)
        first = np.flatnonzero(fresh)
        value[first] = np.minimum(value[first], since[ch[first]])
        value = np.minimum(value, _CAP - 1) + np.uint8(1)
        np.minimum(since, least, out=since)
        ends = np.append(first[1:], len(ch))
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        since[ch[first]] = tail[take[ends - 1] + 1]
        left = before[take]
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            c = int(ch[a])
            if queue.push(c, left[a:b], value[a:b]):
                heapq.heappush(due, sign * c)
