"""LM scoring by an interpolated modified Kneser-Ney model, counted in Spark, memory-mapped by the workers.

Tokens are words (A-Z lower-cased, white space apart) and one end for each text. Three passes over the texts:

1. Words. Each task counts the hashes of its words; they are dealt by their leading bits, summed, and stored as
   sorted hash arrays. A word's number is its place in all of them.
2. Bigrams. Pairs (context, word) of numbers are counted likewise and stored as sorted arrays of 64-bit keys with
   counts. They are dealt by context, those of very frequent contexts by context and word, so that no context
   loads one task. Each bucket also gives its contexts' totals and numbers of successors seen once, twice and
   more, and how many contexts each word follows; these are summed by ranges of numbers.
3. Scores. Workers map the arrays and look words and pairs up in sorted blocks.

Discounts come from all counts of counts: p(w|u) = (c(uw) - D(c)) / c(u) + g(u) * p(w); p(w) interpolates continuation
counts, with their own discounts, with the uniform distribution over the V known tokens and one unknown. Nothing is
collected but one row of sums for each bucket, and nothing is pruned.

Cases: null and empty texts are one end; words never seen in training have the unknown's probability; without
training texts every token has probability 1 / (V + 1) = 1; repeated rows count each time; a null doc_id
trains as the id "None"; an empty table gives no rows; columns besides doc_id and text are ignored. More than 2**32 - 2
distinct words are refused, as numbers of words have 32 bits; counts have 64 bits (pairs: 32, larger ones stand apart).
Words are told apart by 64-bit hashes (`scan.block_hashes`): only a random collision could join two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import U64, mix, text_slices, word_table
from .shared import map_file, prepare, put_bytes, scratch

#: A context takes part of more than one bucket if it has over 1 / SPREAD of a bucket's even share of tokens.
SPREAD = 2
_FLUSH = 600_000
#: Tokens after which a task hands on its counts, so that they fit 32 bits.
_FLUSH_TOKENS = 1 << 30
#: This count stands for a larger one, which is stored apart.
_LARGE = 0xFFFFFFFF


def held_out(ids: np.ndarray, parts: int, part: int) -> np.ndarray:
    """crc32 of the id as text, modulo parts, is part."""
    return np.array([zlib.crc32(str(i).encode()) % parts == part for i in ids.tolist()], bool)


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their (summed) counts."""
    if counts is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0..3) of modified Kneser-Ney from the numbers of entries counted once to four times (n[0..3])."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    rates = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    d = [min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a and y else 0.5 * k for k, a, b in rates]
    return np.array([0.0, *d])


@dataclass
class Model:
    """Where the arrays are, and the sums that scoring needs."""

    folder: str
    bits: int
    buckets: int
    offsets: list[int] = field(default_factory=list)  # first word number of each hash bucket
    words: int = 0  # distinct words; the end is number `words`, the start the next
    texts: int = 0
    tokens: int = 0
    pairs: int = 0
    filled: frozenset[int] = frozenset()
    pair_discounts: np.ndarray | None = None
    word_discounts: np.ndarray | None = None
    word_kinds: np.ndarray | None = None  # words with continuation count 1, 2, 3 and more
    stride: int = 1  # numbers of one range of statistics

    @property
    def types(self) -> int:
        return self.words + (self.texts > 0)


class Arrays:
    """A worker's maps of a model's arrays, opened when needed."""

    def __init__(self, model: Model):
        self.m = model
        self._open: dict[str, np.ndarray] = {}

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = np.frombuffer(map_file(self.m.folder, name), dtype)
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown) and training counts of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted((hashes >> U64(64 - self.m.bits)).astype(np.int64), np.arange(self.m.buckets + 1))
        for k in range(self.m.buckets):
            if cuts[k] == cuts[k + 1] or self.m.offsets[k] == self.m.offsets[k + 1]:
                continue
            mine, known = hashes[cuts[k] : cuts[k + 1]], self.get(f"{k}.words", U64)
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            ok = known[at] == mine
            number[cuts[k] : cuts[k + 1]][ok] = at[ok] + self.m.offsets[k]
            count[cuts[k] : cuts[k + 1]][ok] = self.get(f"{k}.word_counts", np.int64)[at[ok]]
        return number, count

    def statistics(self, numbers: np.ndarray) -> np.ndarray:
        """Rows (total, once, twice, more, continuation) of sorted numbers >= 0."""
        out = np.zeros((len(numbers), 5), np.int64)
        ranges = numbers // self.m.stride
        for k in np.unique(ranges):
            a, b = np.searchsorted(ranges, [k, k + 1])
            out[a:b] = self.get(f"{k}.statistics", np.int64).reshape(-1, 5)[numbers[a:b] - k * self.m.stride]
        return out

    def pair_counts(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """Training counts of sorted pair keys."""
        out = np.zeros(len(keys), np.int64)
        bucket = pair_bucket(keys, context_counts, self.m)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m.buckets + 1))
        for k in range(self.m.buckets):
            part = order[cuts[k] : cuts[k + 1]]
            if len(part) and k in self.m.filled:
                known = self.get(f"{k}.pairs", U64)
                at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                ok = known[at] == keys[part]
                found = self.get(f"{k}.pair_counts", np.uint32)[at[ok]].astype(np.int64)
                if len(large := np.flatnonzero(found == _LARGE)):
                    table = self.get(f"{k}.large_counts", np.int64).reshape(-1, 2)
                    found[large] = table[np.searchsorted(table[:, 0], at[ok][large]), 1]
                out[part[ok]] = found
        return out


def pair_bucket(keys: np.ndarray, context_counts: np.ndarray, m: Model) -> np.ndarray:
    heavy = context_counts * m.buckets * SPREAD > m.tokens
    return (mix(np.where(heavy, keys, keys >> U64(32)) + U64(0x632BE59BD9B4E019)) % U64(m.buckets)).astype(np.int64)


def tokens(arrays: Arrays, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, context number, count, context's count, each row's first place) of all tokens of a slice, ends included."""
    h, rows = word_table(data, offsets)
    distinct, same = np.unique(h, return_inverse=True)
    number, count = arrays.numbers(distinct)
    n_rows = len(rows) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(n_rows), np.diff(rows))
    total, m = len(h) + n_rows, arrays.m
    word, times = np.full(total, m.words, np.int64), np.full(total, m.texts, np.int64)
    word[at], times[at] = number[same], count[same]
    first = rows[:-1] + np.arange(n_rows)
    context, context_times = np.roll(word, 1), np.roll(times, 1)
    context[first], context_times[first] = m.words + 1, m.texts
    return word, context, times, context_times, first


def _count_words(m: Model, parts: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts, size = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, n = counted(np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])) if kept else (np.empty(0, U64), np.empty(0, np.int64))
            cuts = np.searchsorted((h >> U64(64 - m.bits)).astype(np.int64), np.arange(m.buckets + 1))
            some = [k for k in range(m.buckets) if cuts[k] < cuts[k + 1]]
            columns = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in some] for x in (h, n.astype(np.int64))]
            # texts are counted by an extra row without words
            return pa.RecordBatch.from_arrays([pa.array([*some, 0], pa.int32()), pa.array([*columns[0], b""], pa.binary()), pa.array([*columns[1], b""], pa.binary()), pa.array([0] * len(some) + [texts], pa.int64())], ["bucket", "hashes", "counts", "texts"])

        for batch in batches:
            train = ~held_out(batch.column("doc_id"), parts, part)
            for _, _, data, offsets in text_slices(batch.filter(pa.array(train))):
                kept.append(counted(word_table(data, offsets)[0]))
                texts += len(offsets) - 1
                size += len(kept[-1][0])
                if size > _FLUSH:
                    yield flush()
                    kept, texts, size = [], 0, 0
        yield flush()

    return run


def _write_words(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = counted(np.concatenate([np.frombuffer(b, U64) for b in pdf["hashes"]]), np.concatenate([np.frombuffer(b, np.int64) for b in pdf["counts"]]))
        k = int(pdf["bucket"].iloc[0])
        put_bytes(folder, f"{k}.words", h.tobytes())
        put_bytes(folder, f"{k}.word_counts", n.astype(np.int64).tobytes())
        return pd.DataFrame({"bucket": [k], "words": [len(h)], "tokens": [int(n.sum())], "texts": [int(pdf["texts"].sum())]})

    return run


def _count_pairs(m: Model, parts: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(m)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, heavy = np.concatenate([a for a, _, _ in kept]), np.concatenate([c for _, _, c in kept])
            order = np.argsort(keys, kind="stable")
            keys, heavy, n = keys[order], heavy[order], np.concatenate([b for _, b, _ in kept])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, heavy, n = keys[first], heavy[first], np.add.reduceat(n, first)
            bucket = pair_bucket(keys, heavy, m)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            columns = [[p.tobytes() for p in np.split(x[order], cuts[1:])] for x in (keys, n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary())], ["bucket", "keys", "counts"])

        size = seen = 0
        for batch in batches:
            train = ~held_out(batch.column("doc_id"), parts, part)
            for _, _, data, offsets in text_slices(batch.filter(pa.array(train))):
                word, context, _, times, _ = tokens(arrays, data, offsets)
                keys = context.astype(U64) << U64(32) | word.astype(U64)
                keys, at, n = np.unique(keys, return_index=True, return_counts=True)
                kept.append((keys, n, times[at]))
                size += len(keys)
                seen += len(word)
                if size > _FLUSH or seen > _FLUSH_TOKENS:
                    yield flush()
                    kept, size, seen = [], 0, 0
        if kept:
            yield flush()

    return run


def _write_pairs(m: Model):
    """Stores a bucket's pairs; gives (range, statistics by number) and, as range -1, the bucket's own sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = counted(np.concatenate([np.frombuffer(b, U64) for b in pdf["keys"]]), np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["counts"]]).astype(np.int64))
        k = int(pdf["bucket"].iloc[0])
        put_bytes(m.folder, f"{k}.pairs", keys.tobytes())
        put_bytes(m.folder, f"{k}.pair_counts", np.minimum(n, _LARGE).astype(np.uint32).tobytes())
        large = np.flatnonzero(n >= _LARGE)
        put_bytes(m.folder, f"{k}.large_counts", np.stack([large, n[large]], 1).astype(np.int64).tobytes())
        out = [(-1, k, np.array([len(keys), *np.bincount(np.minimum(n, 5), minlength=6)[1:5]], np.int64).tobytes(), b"")]
        context = (keys >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        rows = np.stack([np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n >= 3)], 1).astype(np.int64)
        word, follows = np.unique((keys & U64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        for kind, (number, values) in enumerate(((context[first], rows), (word, follows.astype(np.int64)))):
            cut = np.searchsorted(number // m.stride, np.arange(m.buckets + 1))
            out += [(r, kind, number[a:b].astype(np.uint32).tobytes(), values[a:b].tobytes()) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        return pd.DataFrame(out, columns=["range", "kind", "numbers", "values"])

    return run


def _write_statistics(m: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["range"].iloc[0])
        if k < 0:
            return pd.DataFrame({"range": pdf["kind"].astype(np.int32), "sums": pdf["numbers"], "pairs": True})
        table = np.zeros((m.stride, 5), np.int64)
        for kind, number, values in zip(pdf["kind"], pdf["numbers"], pdf["values"], strict=True):
            at = np.frombuffer(number, np.uint32).astype(np.int64) - k * m.stride
            if kind:
                table[at, 4] += np.frombuffer(values, np.int64)
            else:
                table[at, :4] += np.frombuffer(values, np.int64).reshape(-1, 4)
        put_bytes(m.folder, f"{k}.statistics", table.tobytes())
        follows = table[:, 4]
        sums = np.array([*np.bincount(np.minimum(follows, 5), minlength=6)[1:5], (follows >= 3).sum()], np.int64)
        return pd.DataFrame({"range": [k], "sums": [sums.tobytes()], "pairs": [False]})

    return run


def train(docs: DataFrame, parts: int = 7, part: int = 2) -> Model:
    """Count and store the model from the texts that are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    # four buckets a partition, so that one that gets several of them by chance stays small
    bits = max(3, (4 * docs.rdd.getNumPartitions() - 1).bit_length())
    m = Model(scratch(spark, "ngrams"), bits, 1 << bits)
    rows = docs.mapInArrow(_count_words(m, parts, part), "bucket int, hashes binary, counts binary, texts long")
    sums = {r["bucket"]: r for r in rows.groupBy("bucket").applyInPandas(_write_words(m.folder), "bucket int, words long, tokens long, texts long").collect()}
    sizes = [sums[k]["words"] if k in sums else 0 for k in range(m.buckets)]
    m.offsets = [0, *np.cumsum(sizes).tolist()]
    m.words, m.texts = m.offsets[-1], sum(r["texts"] for r in sums.values())
    if m.words >= (1 << 32) - 2:
        raise ValueError("more distinct words than 32-bit numbers")
    m.tokens = sum(r["tokens"] for r in sums.values()) + m.texts
    m.stride = -(-(m.words + 2) // m.buckets)
    rows = docs.mapInArrow(_count_pairs(m, parts, part), "bucket int, keys binary, counts binary")
    rows = rows.groupBy("bucket").applyInPandas(_write_pairs(m), "range int, kind int, numbers binary, values binary")
    rows = rows.groupBy("range", F.when(F.col("range") < 0, F.col("kind")).alias("one")).applyInPandas(_write_statistics(m), "range int, sums binary, pairs boolean")
    pair_kinds, word_kinds = np.zeros(5, np.int64), np.zeros(5, np.int64)
    filled = set()
    for r in rows.collect():
        if r["pairs"]:
            pair_kinds += np.frombuffer(r["sums"], np.int64)
            filled.add(r["range"])
        else:
            word_kinds += np.frombuffer(r["sums"], np.int64)
    m.filled, m.pairs = frozenset(filled), int(pair_kinds[0])
    m.pair_discounts, m.word_discounts = discounts(pair_kinds[1:]), discounts(word_kinds[:4])
    m.word_kinds = np.array([word_kinds[0], word_kinds[1], word_kinds[4]])
    return m


def log_probabilities(arrays: Arrays, word: np.ndarray, context: np.ndarray, context_times: np.ndarray) -> np.ndarray:
    """log10 p(word | context) of each token."""
    m = arrays.m
    if not m.pairs:
        return np.full(len(word), -np.log10(m.types + 1.0))
    d, e = m.pair_discounts, m.word_discounts
    numbers, same = np.unique(np.concatenate([word, context]), return_inverse=True)
    known = numbers >= 0
    table = np.zeros((len(numbers), 5), np.int64)
    table[known] = arrays.statistics(numbers[known])
    follows = table[same[: len(word)], 4]
    single = np.maximum(follows - e[np.minimum(follows, 3)], 0) / m.pairs + (e[1:] @ m.word_kinds) / m.pairs / (m.types + 1)
    rows = table[same[len(word) :]]
    pairs = np.flatnonzero((word >= 0) & (context >= 0))
    keys, at, back = np.unique(context[pairs].astype(U64) << U64(32) | word[pairs].astype(U64), return_index=True, return_inverse=True)
    c = np.zeros(len(word), np.int64)
    c[pairs] = arrays.pair_counts(keys, context_times[pairs][at])[back]
    total = rows[:, 0]
    known = total > 0
    base = np.where(known, total, 1)
    p = np.maximum(c - d[np.minimum(c, 3)], 0) / base + np.where(known, rows[:, 1:4] @ d[1:] / base, 1.0) * single
    return np.log10(p)


def score(docs: DataFrame, model: Model, parts: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score and perplexity of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            held = held_out(batch.column("doc_id"), parts, part)
            for lo, hi, data, offsets in text_slices(batch):
                word, context, times, context_times, first = tokens(arrays, data, offsets)
                log_p = log_probabilities(arrays, word, context, context_times)
                base = np.log10((times + 1.0) / (model.tokens + 1.0 * (model.types + 1)))
                size = np.diff(np.append(first, len(word)))
                total = np.add.reduceat(log_p, first)
                columns = [
                    batch.column("doc_id")[lo:hi], pa.array(held[lo:hi]), pa.array(size), pa.array(np.add.reduceat((times > 0).astype(np.int64), first)),
                    pa.array(np.full(hi - lo, model.tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** (-total / size)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
