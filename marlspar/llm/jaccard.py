"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its word n-gram hashes. Two sets whose overlap reaches the threshold share at least k of
the first n - ceil(threshold * n) + k tokens of ANY order that all sets follow; once both sizes n and m are
known, of the first n - least + k, where least = ceil(threshold * (n + m) / (1 + threshold)). Three orders are used (rare
tokens first by a shared frequency sketch, ties broken by different hashes). The first order's prefixes find the
candidates; the prefixes of the other orders, as 32-bit marks, are brought together for candidates only, and a pair's
whole sets only if it shares k prefix tokens under every order.

Sets that are equal are one class from the start. Links are then found in two steps that never list the pairs of
a group: (1) in each of some rounds, each set is compared with one hub of another component, the most central set
of a bucket that it shares most prefix tokens with, if it shares enough; what is verified joins into components, and
tokens all of whose sets are in one component are left out of what follows; (2) the pairs that are left are those of
different components that share enough prefix tokens, and all of them are verified. No link between components is
lost; links inside one cannot change the components.

The number of links is counted afterwards: where a component's known links are fewer than its pairs, its sets are
dealt into blocks, and the overlaps of all pairs of two blocks are counted at once, token by token.

Words and shingles are 64-bit hashes by non-linear steps, sets are told apart by 128 bits; only random collisions
can misjudge. The sketch is a fixed table (256 KB) and only sorts tokens; it cannot change results.

Cases: null texts and texts without words have an empty set and link with nothing; texts of one or two words are
one token; ties are ordered by hash; repeated rows are copies; a row whose doc_id is null links with nothing, has a
null component_id and stays in `deduplicate`; an empty table gives no rows; only doc_id and text are read, so extra
columns cannot clash. doc_id must not name two different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scan import U64, mix, text_slices, word_table
from .shared import IdRanges, dropped, prepare, sized, stored

#: Shared prefix tokens that a pair must have under each order (fewer for tiny sets).
SHARED = 3
#: Rounds against hubs before the remaining pairs are listed.
ROUNDS = 4
SKETCH_BITS, SLICES = 18, 16
FILTER_BITS = 23
#: Bytes of text a step takes where it fills no table; its arrays then fit the cache.
_STEP_BYTES = 1 << 18
#: Sets and tokens in a block of a component; two blocks are compared at a time.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 19
#: Columns of the dense product, and token pairs listed at a time beside it.
_COLUMNS, _PAIRS = 2048, 1 << 21
#: Pairs that a task verifies at a time.
TASK_PAIRS = 1 << 14
#: Prefix rows that a task packs at a time.
_FLUSH_ROWS = 400_000
#: Classes of over 1/HOT of all rows (so fewer than HOT) are broadcast: their copies would meet in one task.
HOT = 4096
_SEEDS = (U64(0x8CB92BA72F3D8DD7), U64(0xABC98388FB8FAC03), U64(0xD1342543DE82EF95))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    h, rows = word_table(data, offsets)
    seen = np.zeros(max(0, len(h) - width + 1), U64)
    for k in range(width):
        seen = mix(seen * U64(0x9E3779B97F4A7C15) + h[k : k + len(seen)])
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(seen[a : b - width + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own if new.all() else own[new]
        elif b > a:
            one = np.array([b - a], U64)
            for k in range(a, b):
                one = mix(one * U64(0x9E3779B97F4A7C15) + h[k : k + 1])
            yield one
        else:
            yield np.empty(0, U64)


def required(n: int | np.ndarray, percent: int):
    """Least overlap of a set of n tokens with any linked set: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def overlap(n, m, percent: int):
    """Least overlap of sets of n and m tokens that link: ceil(percent * (n + m) / (100 + percent))."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(tokens: np.ndarray, sketch: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The tokens of one set that may count with any partner, in one of the orders; a pair counts fewer (see _verify)."""
    need = int(required(len(tokens), percent))
    size = len(tokens) - need + min(SHARED, need)
    rank = sketch[(tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(56)
    key = rank | mix(tokens ^ _SEEDS[order]) >> U64(8)
    first = np.argpartition(key, size - 1)[:size] if size < len(tokens) else np.arange(size)
    return tokens[first[np.argsort(key[first])]]


def _profile(width: int):
    """Rows of documents (n, two fingerprints of the set) and, at a task's end, its slices of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "f1", "f2", "slice", "counts"]
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch):
                n, f1, f2, some = [], [], [], []
                for s in shingle_sets(data, offsets, width):
                    n.append(len(s))
                    for to, x in zip((f1, f2), fingerprint(s), strict=True):
                        to.append(x)
                    some.append(s)
                counts += np.bincount((np.concatenate(some) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                blank = pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())
                columns = [batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *blank]
                yield pa.RecordBatch.from_arrays(columns, names)
        parts = [(k, p) for k, p in enumerate(np.split(counts, SLICES)) if p.any()]
        blank = [pa.nulls(len(parts), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*blank, pa.array([k for k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names)

    return run


def _sketch(profile: DataFrame) -> np.ndarray:
    """log2 classes of the summed counts; 2**SKETCH_BITS bytes whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for blob in pdf["counts"]:
            total += np.frombuffer(blob, np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [np.log2(total + 1.0).astype(np.uint8).tobytes()]})

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in profile.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _pack(token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> bytes:
    """Rows by column: the codec of the shuffle then finds the short numbers' zeros. Of a token 32 bits go.

    In a bucket equal tokens have equal marks; different ones may, which only adds candidates.
    """
    return (token >> U64(32)).astype("<u4").tobytes() + ids.astype("<i8").tobytes() + n.astype("<i4").tobytes() + pos.astype("<i4").tobytes()


def _unpack(blobs) -> tuple[np.ndarray, ...]:
    parts = []
    for blob in blobs:
        k = len(blob) // 20
        parts.append((np.frombuffer(blob, "<u4", k), np.frombuffer(blob, "<i8", k, 4 * k), np.frombuffer(blob, "<i4", k, 12 * k), np.frombuffer(blob, "<i4", k, 16 * k)))
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(4))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart, as signed numbers."""
    return tuple(int(mix(x).sum(dtype=U64).view(np.int64)) for x in (s ^ _SEEDS[0], s + _SEEDS[1]))


def _prefix_rows(width: int, percent: int, sketch, buckets: int, hot):
    """(bucket, rows): prefix tokens of the first order, packed by hash bucket; of hot classes one document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        kept: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, lens = np.concatenate([t for t, _, _ in kept]), [len(t) for t, _, _ in kept]
            ids, n = np.repeat([i for _, i, _ in kept], lens), np.repeat([k for _, _, k in kept], lens)
            pos = np.concatenate([np.arange(k) for k in lens])
            bucket = (mix(token) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            blobs = [_pack(token[p], ids[p], n[p], pos[p]) for p in np.split(order, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][first], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_slices(batch, size=_STEP_BYTES):
                for k, s in enumerate(shingle_sets(data, offsets, width)):
                    if len(s) and not (hot.value and hot.value.get((len(s), *fingerprint(s)), ids[lo + k]) != ids[lo + k]):
                        kept.append((prefix(s, table, percent, 0), int(ids[lo + k]), len(s)))
                        size += len(kept[-1][0])
                if size > _FLUSH_ROWS:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return run


def _shared_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one bucket whose token stands in two sets or more."""
    token, ids, n, pos = _unpack(pdf["rows"])
    token = token.astype(U64) | U64(int(pdf["bucket"].iloc[0])) << U64(32)
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    return pd.DataFrame({"token": token[keep].view(np.int64), "id": ids[order], "n": n[order], "pos": pos[order]})


def _sets(width: int, wanted, sketch=None, percent: int = 0):
    """(id, tokens) of the documents that the filter may hold, once a task; with a sketch (id, n, marks) instead.

    Marks are 32 bits of the prefix tokens under every order but the first, one order after another: a filter, as equal
    tokens have equal marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").view(bool)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            take = np.flatnonzero(bits[_filter_slot(ids)]).tolist()
            take = [k for k in take if (i := int(ids[k])) not in seen and not seen.add(i)]  # type: ignore[func-returns-value]
            own = batch.take(pa.array(take, pa.int64()))
            for lo, hi, data, offsets in text_slices(own, size=_STEP_BYTES):
                sets = [*shingle_sets(data, offsets, width)]
                if sketch is None:
                    yield pa.RecordBatch.from_arrays([own.column("doc_id")[lo:hi], pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tokens"])
                    continue
                marks = [b"".join((prefix(s, sketch.value, percent, k) >> U64(32)).astype("<u4").tobytes() for k in range(1, len(_SEEDS))) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([own.column("doc_id")[lo:hi], pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary())], ["id", "n", "marks"])

    return run


def _filter_slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64) + U64(0x51ED270B9F4A7C15)) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _id_filters(pairs: DataFrame) -> dict[str, bytes]:
    """For each column a bit for each hash of an id; a fixed 2**FILTER_BITS bits. It only spares work: joins decide."""
    names = pairs.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((len(names), 1 << FILTER_BITS), bool)
        for batch in batches:
            for own, column in zip(bits, batch.columns, strict=True):
                own[_filter_slot(column.to_numpy(zero_copy_only=False))] = True
        parts = np.packbits(bits, axis=1, bitorder="little").reshape(len(names) * SLICES, -1)
        used = np.flatnonzero(parts.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["slice", "bits"])

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << FILTER_BITS) // 8 // SLICES, np.uint8)
        for blob in pdf["bits"]:
            out |= np.frombuffer(blob, np.uint8)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [out.tobytes()]})

    out = np.zeros((len(names) * SLICES, (1 << FILTER_BITS) // 8 // SLICES), np.uint8)
    for r in pairs.mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInPandas(either, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return {name: own.tobytes() for name, own in zip(names, out.reshape(len(names), -1), strict=True)}


def _all_orders(percent: int):
    """Pairs that share enough prefix tokens under each of the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                least = overlap(n, m, percent)
                need, ok = min(SHARED, least), 100 * min(n, m) >= percent * max(n, m)
                if ok:
                    s, t = (np.frombuffer(v.as_buffer(), "<u4").reshape(len(_SEEDS) - 1, -1) for v in (x, y))
                    # marks may meet by chance, tokens that are equal always do
                    ok = all(np.isin(p[: n - least + need], q[: m - least + need]).sum() >= need for p, q in zip(s, t, strict=True))
                keep.append(bool(ok))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    """Pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, sketch) -> DataFrame:
    """The stored pairs (a, b) that pass all filters and the threshold; prefixes and sets are made for documents in pairs only."""
    spark = docs.sparkSession

    def sides(pairs: DataFrame, schema: str, *more) -> list[DataFrame]:
        wanted = {c: spark.sparkContext.broadcast(bits) for c, bits in _id_filters(pairs).items()}  # 1 MB each
        return [docs.mapInArrow(_sets(width, wanted[c], *more), schema).withColumnRenamed("id", c) for c in "ab"]

    pairs, asked = pairs.select("a", "b"), pairs.count()
    a, b = sides(pairs, "id long, n int, marks binary", sketch, percent)
    rows = pairs.join(a.select("a", F.col("n").alias("na"), F.col("marks").alias("x")), "a").join(b.select("b", F.col("n").alias("nb"), F.col("marks").alias("y")), "b")
    rows = sized(rows.select("a", "b", "na", "nb", "x", "y"), asked, TASK_PAIRS)
    left = stored(sized(rows.mapInArrow(_all_orders(percent), "a long, b long").distinct(), asked), "filtered")
    asked = left.count()
    a, b = sides(left, "id long, tokens binary")
    rows = left.join(a.select("a", F.col("tokens").alias("x")), "a").join(b.select("b", F.col("tokens").alias("y")), "b")
    rows = sized(rows.select("a", "b", "x", "y"), asked, TASK_PAIRS)
    out = stored(sized(rows.mapInArrow(_verify(percent), "a long, b long").distinct(), asked), "links")
    dropped(left)
    return out


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of xs with every set of ys."""
    p, q = len(xs), len(ys)
    out = np.zeros((p, q), np.int64)
    row = np.repeat(np.arange(p + q), [len(s) for s in (*xs, *ys)])
    code = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)[1]
    order = np.lexsort((row, code))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    n = np.diff(np.append(first, len(code)))
    nx = np.add.reduceat((row < p).astype(np.int64), first)
    ny = n - nx
    dense = nx * ny * 128 > p * q
    for at in np.array_split(np.flatnonzero(dense), -(-int(dense.sum()) // _COLUMNS) or 1):
        take = np.arange(int(n[at].sum())) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + np.repeat(first[at], n[at])
        table = np.zeros((p + q, len(at)), np.float32)
        table[row[take], np.repeat(np.arange(len(at)), n[at])] = 1
        out += (table[:p] @ table[p:].T).astype(np.int64)  # exact, as a column adds one at most
    rare = np.flatnonzero(~dense & (nx > 0) & (ny > 0))
    size = nx[rare] * ny[rare]
    for at in np.split(rare, np.flatnonzero(np.diff(np.cumsum(size) // _PAIRS)) + 1):
        size = nx[at] * ny[at]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        begin, many = np.repeat(first[at], size), np.repeat(ny[at], size)
        x, y = row[begin + k // many], row[begin + np.repeat(nx[at], size) + k % many] - p
        out += np.bincount(x * q + y, minlength=p * q).reshape(p, q)
    return out


def _degrees(percent: int):
    """(id, k): links of each set in a pair of blocks; rows (label, lo, hi, left, id, tokens) come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []

        def count() -> pa.RecordBatch:
            xs, ys = [r for r in kept if r[0]], [r for r in kept if not r[0]]
            x = [s for _, _, s in xs]
            y = x if key[1] == key[2] else [s for _, _, s in ys]
            ids, degree = [i for _, i, _ in xs], np.zeros(len(x), np.int64)
            if x and y:
                both = overlaps(x, y)
                total = np.add.outer([len(s) for s in x], [len(s) for s in y])
                linked = 100 * both >= percent * (total - both)
                if y is x:
                    np.fill_diagonal(linked, False)
                    degree = linked.sum(1)
                else:
                    ids, degree = ids + [i for _, i, _ in ys], np.concatenate((linked.sum(1), linked.sum(0)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(degree, pa.int64())], ["id", "k"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "lo", "hi", "left", "id")]
            for label, lo, hi, left, i, blob in zip(*columns, batch.column("tokens"), strict=True):
                if (label, lo, hi) != key:
                    if kept:
                        yield count()
                    key, kept = (label, lo, hi), []
                if not kept or kept[-1][1] != i:  # repeated rows
                    kept.append((left, i, np.frombuffer(blob.as_buffer(), U64).copy()))
        if kept:
            yield count()

    return run


def _all_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n_links) of the classes in `groups`, from links that connect these components but need not be all."""
    pairs = stored(sized(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), links.count()), "pairs")
    found = pairs.join(groups.withColumnRenamed("id", "a"), "a").groupBy("label").agg(F.count(F.lit(1)).alias("found"))
    member = groups.join(classes.select(F.col("rep").alias("id"), "n"), "id")
    total = member.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).join(found, "label")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("size") / BLOCK_TOKENS)).cast("int")
    total = total.select("label", blocks.alias("blocks"), (2 * F.col("found") < F.col("m") * (F.col("m") - 1)).alias("open"))
    member = stored(sized(member.join(total, "label").select("id", "label", "blocks", "open"), groups.count()), "members")
    known = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).join(member.where("not open"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    some = member.where("open")
    wanted = docs.sparkSession.sparkContext.broadcast(_id_filters(some.select("id"))["id"])
    sets = some.join(docs.mapInArrow(_sets(width, wanted), "id long, tokens binary"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("id", "label", "block", "tokens", other)
    dealt = dealt.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") <= F.col("other")).alias("left"), "id", "tokens")
    dealt = dealt.repartition(max(8, docs.rdd.getNumPartitions()), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "id")
    counted = dealt.mapInArrow(_degrees(percent), "id long, k long")
    return stored(known.union(counted).groupBy(F.col("id").alias("rep")).agg(F.sum("k").alias("n_links")), "degrees")


def _candidates(left: DataFrame, right: DataFrame, on: list[str], percent: int, differ: Column) -> DataFrame:
    """(a, b, shared): pairs that share enough tokens of the first order's prefixes, as far as these rows tell.

    A pair's own least overlap bounds both prefixes more tightly than any partner's. Rows are (token, id, n, pos, label).
    """
    left = left.select(*on, F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    right = right.select(*on, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    least = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    need = F.least(F.lit(SHARED), least)
    fits = differ & (F.col("la") != F.col("lb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    fits &= (F.col("pa") < F.col("na") - least + need) & (F.col("pb") < F.col("nb") - least + need)
    pairs = left.join(right, on).where(fits).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= need).select("a", "b", "shared")


def _mixed(tokens: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows, labelled by component, of tokens that stand in two components or more."""
    member = tokens.drop("label")
    member = member.withColumn("label", F.col("id")) if groups is None else member.join(groups, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = member.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return stored(sized(member.join(several, "token"), tokens.count()), "mixed")


def link(docs: DataFrame, percent: int = 90, width: int = 3, counted: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): component_id is the smallest doc_id reachable by links.

    n_links counts the classes of other sets that the document's class links with; copies of one class have the same
    number. Without `counted` this column is left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = stored(docs.mapInArrow(_profile(width), "doc_id long, n long, f1 long, f2 long, slice int, counts binary"), "profile")
    rows = profile.where("slice is null").select("doc_id", "n", "f1", "f2")
    docs = docs.where("doc_id is not null")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = stored(sized(classes, rows.count()), "classes")
    total = classes.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT > total
    hot = spark.sparkContext.broadcast({(r["n"], r["f1"], r["f2"]): r["rep"] for r in classes.where(is_hot & (F.col("rows") > 1)).collect()})  # fewer than HOT
    sketch = spark.sparkContext.broadcast(_sketch(profile))

    # about as many buckets as input partitions, so that a bucket's size does not grow
    buckets = max(8, 2 * docs.rdd.getNumPartitions())
    packed = docs.mapInArrow(_prefix_rows(width, percent, sketch, buckets, hot), "bucket int, rows binary")
    tokens = packed.groupBy("bucket").applyInPandas(_shared_tokens, "token long, id long, n int, pos int")
    tokens = tokens.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    # sets of a link differ in size by one length class at most
    tokens = tokens.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) if percent < 100 else 1.0)))
    tokens = stored(tokens, "tokens")
    crowd = tokens.groupBy("token", "size_class").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    central = tokens.join(crowd, ["token", "size_class"]).groupBy("id").agg(F.sum("m").alias("central"))
    tokens, old = stored(sized(tokens.join(central, "id", "left").fillna(0, ["central"]), tokens.count()), "tokens"), tokens
    dropped(old)
    tokens, old = _mixed(tokens, None), tokens
    dropped(old)

    # (1) star rounds: each set against one hub of another component, the most central one of its buckets
    links = groups = None
    for turn in range(ROUNDS):
        # later rounds look at another part of the sets first
        order = F.struct(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 + 3 * min(turn, 1))) == 0, "central", -F.col("id"))
        hubs = tokens.groupBy("token", "size_class").agg(F.max_by(F.struct("id", "n", "pos", "label"), order).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        hubs = hubs.where("lo < hi").select("token", "size_class", "hub.*")
        stars = _candidates(tokens, hubs, ["token", "size_class"], percent, F.col("a") != F.col("b"))
        stars = stored(sized(stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")), tokens.count()), "stars")
        asked = stars.count()
        if not asked:
            break
        found = _verified(docs, stars, width, percent, sketch)
        links = found if links is None else links.union(found)
        groups = components(links)
        tokens, old = _mixed(tokens, groups), tokens
        dropped(old)
        if 10 * found.count() < asked:  # hubs have little left to link: list what remains
            break

    # (2) all pairs of different groups that share enough prefix tokens
    pairs = stored(_candidates(tokens, tokens, ["token"], percent, F.col("a") < F.col("b")).select("a", "b"), "pairs")
    if pairs.limit(1).count():
        more = _verified(docs, pairs, width, percent, sketch)
        links = more if links is None else links.union(more)
        groups = components(links)
    dropped(tokens)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
        groups = spark.createDataFrame([], "id long, label long")

    labels = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    if counted:
        labels = labels.join(_all_links(docs, classes, groups, links, width, percent), "rep", "left")
    columns = ["n_links"] if counted else []
    labels = stored(labels.select("n", "f1", "f2", "rows", "component_id", *columns), "labels")
    key, common = ["n", "f1", "f2"], is_hot & (F.col("rows") > 1)
    # rows without words or id meet no label; copies of hot classes meet theirs by broadcast, as one task could not hold them
    empty = rows.where("n = 0 or doc_id is null").select("*", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in columns))
    rest = rows.where("n > 0 and doc_id is not null")
    few = F.broadcast(labels.where(common).drop("rows"))  # fewer than HOT rows
    out = rest.join(few, key).unionByName(rest.join(few, key, "left_anti").join(labels.where(~common).drop("rows"), key)).unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def deduplicate(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, in its own columns; of repeated rows one.

    Rows without a doc_id stay. Texts are filtered where they are read, by sorted arrays of the ids to drop (`IdRanges`);
    only texts of repeated rows are shuffled to find one of them.
    """
    rows = stored(link(docs, percent, width, False).where("doc_id is not null").select("doc_id", (F.col("component_id") != F.col("doc_id")).alias("copy")), "copies")
    again = stored(rows.where("not copy").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "again")
    out = rows.where("copy").select("doc_id").union(again)
    drop = IdRanges.write(out.distinct())
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            some = ids.fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~drop.holds(some) | ids.is_null().to_numpy(zero_copy_only=False)))

    once = docs.mapInArrow(run, schema)
    if not again.limit(1).count():
        return once
    more = docs.join(again, "doc_id", "left_semi").select(docs.columns)
    return once.union(more.dropDuplicates(["doc_id"]))
