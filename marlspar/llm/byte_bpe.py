"""Byte-level BPE by ranks, folded in Spark's higher-order functions.

A scan splits texts into words (the byte-level pattern, Unicode 16.0 classes) and turns slices of some 16 MB into a dictionary: distinct
words as byte arrays, and for every text the places of its words in it. A fold over each distinct word then merges the
adjacent pair of least rank, the leftmost first, until no pair has one; ranks come from a literal map, dealt into
buckets so that a lookup reads one short map. Ids of texts are gathered from the dictionary by position. Decoding looks every id's binary
piece up in a literal array and concatenates the pieces. Nothing is shuffled, a task depends on its own split only.

Words longer than LONG bytes are folded in windows: a token is final once it ends at least the merge list's sufficient
lookahead before the window's end.

Cases: a null or empty text has no tokens and decodes to nothing; there are no special tokens, their strings are text; repeated rows and
ties are independent rows; a null id stays; an empty table gives an empty result; columns other than id and text are not carried. A
slice holds at least one whole text: the longest text bounds memory, with some 20 bytes a word.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, OTHER, SPACE, MergeTable, Splitter, _tokenizer_bytes, byte_characters
from .scan import text_slices
from .shared import prepare

#: Bytes of text that share a dictionary; bytes that are split at a time.
GROUP_BYTES, SPLIT_BYTES = 32 << 20, 1 << 20
#: Bytes of a word that is folded at once; a longer one is folded in windows of so many final bytes.
LONG, WINDOW = 400, 256
BUCKETS = 65521
#: The rank of a pair that is no token.
NONE = (1 << 17) - 1


class Ranks:
    """A rank file's tokens: `pieces` by id, and `pairs` (left id, right id) -> id of every split into two tokens."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        if sorted(ranks.values()) != [*range(len(ranks))] or len(ranks) > 1 << 16:
            raise ValueError("ranks must be 0, 1, ... without gaps, at most 65,536")
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.lookahead = self._lookahead(ranks)

    def _lookahead(self, ranks: dict[bytes, int]) -> int:
        """The sufficient lookahead of the merge list that these ranks stand for: each token's last merge is recovered."""
        chars = byte_characters()
        said = ["".join(chars[b] for b in t) for t in self.pieces]
        merges = []
        for rank, token in enumerate(self.pieces):
            parts = [self.byte_ids[b] for b in token]
            while len(parts) > 2:
                found = [self.pairs.get(p, NONE) for p in zip(parts, parts[1:], strict=False)]
                least = min(found)
                if least >= rank:
                    raise ValueError(f"token {rank} cannot be merged from lower ranks")
                at = found.index(least)
                parts[at : at + 2] = [least]
            if len(parts) == 2:
                merges.append([said[parts[0]], said[parts[1]]])
        return MergeTable(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(said)}, "merges": merges}}).encode()).lookahead

    def map_literal(self) -> Column:
        """array<map<key, id>>: the map at key % BUCKETS holds the pair left * 65536 + right."""
        dealt: list[dict] = [{} for _ in range(BUCKETS)]
        for (a, b), i in self.pairs.items():
            key = a << 16 | b
            dealt[key % BUCKETS][str(key)] = i
        return F.from_json(F.lit(json.dumps(dealt, separators=(",", ":"))), "array<map<string, int>>").cast("array<map<bigint, int>>")

    def piece_literal(self) -> Column:
        """The bytes of every id; as strings, which take any bytes, so that array_join concatenates them."""
        return F.from_json(F.lit(json.dumps([base64.b64encode(t).decode() for t in self.pieces])), "array<binary>").cast("array<string>")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A symbol is one long: the rank of its pair with the next one, its first byte's place in the word, its id.
RANK_AT, PLACE_AT = 44, 16
LOW, ID, PLACE = (1 << RANK_AT) - 1, (1 << PLACE_AT) - 1, (1 << RANK_AT) - (1 << PLACE_AT)
LAST = NONE << RANK_AT


def long_(x: int) -> Column:
    return F.lit(x).cast("long")


def _rank(table: Column, left: Column, right: Column) -> Column:
    """The rank of a pair of ids, at its place in a symbol."""
    key = F.shiftleft(left, 16).bitwiseOR(right)
    found = F.element_at(F.get(table, (key % BUCKETS).cast("int")), key).cast("long")
    return F.shiftleft(F.coalesce(found, long_(NONE)), RANK_AT)


def fold(symbols: Column, table: Column) -> Column:
    """Merges the pair of least rank, the leftmost first, until none has one.

    Symbols are distinct numbers that begin with rank and place, so the least one is the next pair, and symbols are put in
    and taken out by value.
    """

    def merge(v: Column, least: Column, at: Column) -> Column:
        made = F.shiftright(least, RANK_AT)  # a merged token's id is its rank
        before = F.get(v, at - 2)
        own = F.coalesce(_rank(table, made, F.get(v, at + 1).bitwiseAND(long_(ID))), long_(LAST)).bitwiseOR(least.bitwiseAND(long_(PLACE))).bitwiseOR(made)
        merged = F.array_remove(F.array_remove(F.array_insert(v, at, own), least), F.get(v, at))
        left = _rank(table, before.bitwiseAND(long_(ID)), made).bitwiseOR(before.bitwiseAND(long_(LOW)))
        return bound(left, lambda x: F.when(x != before, F.array_remove(F.array_insert(merged, at - 1, x), before)).otherwise(merged))

    def step(v: Column, _: Column) -> Column:
        def place(least: Column) -> Column:
            return F.when(least >= long_(LAST), v).otherwise(bound(F.array_position(v, least).cast("int"), lambda at: merge(v, least, at)))

        return bound(F.array_min(v), place)

    return F.aggregate(F.slice(symbols, 2, LONG + 1), symbols, step)


def fold_long(word: Column, start, table: Column, sizes: Column, lookahead: int) -> Column:
    """Symbols of a long word, in windows that start(bytes) begins."""
    size = F.size(word)

    def step(acc: Column, _: Column) -> Column:
        def take(symbols: Column) -> Column:
            zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("end"))

            def count(a: Column, x: Column) -> Column:
                total = a["sum"] + F.get(sizes, x.bitwiseAND(long_(ID)).cast("int"))
                fits = total <= WINDOW
                return F.struct(total.alias("sum"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, total).otherwise(a["end"]).alias("end"))

            final = bound(F.aggregate(symbols, zero, count), lambda c: F.struct((acc["at"] + c["end"]).alias("at"), F.concat(acc["out"], F.array(F.slice(symbols, 1, c["n"]))).alias("out")))
            last = F.struct(size.alias("at"), F.concat(acc["out"], F.array(symbols)).alias("out"))
            return F.when(acc["at"] + WINDOW + lookahead >= size, last).otherwise(final)

        part = F.slice(word, acc["at"] + 1, WINDOW + lookahead)
        return F.when(acc["at"] >= size, acc).otherwise(bound(bound(start(part), lambda s: fold(s, table)), take))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    # no token has more than half a window: every window makes final at least the rest of it
    turns = F.sequence(F.lit(0), F.floor(size / (WINDOW // 2)).cast("int"))
    return F.flatten(F.aggregate(turns, zero, step, lambda acc: acc["out"]))


def _cuts(splitter: Splitter, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in parts of some SPLIT_BYTES, cut where a word ends whatever stands around it."""
    lo, size = 0, SPLIT_BYTES
    while lo + size < len(data):
        part = data[lo : lo + size]
        lead, _, kind = splitter.kinds(part[: np.flatnonzero((part & 0xC0) != 0x80)[-1]])
        before, after = kind[:-1], kind[1:]
        safe = np.flatnonzero(((before == LETTER) | (before == NUMBER)) & (after != before) | (before == OTHER) & (after == SPACE))
        if not len(safe):
            size *= 2  # one word as long as the part
            continue
        yield lo, lo + int(lead[safe[-1] + 1])
        lo, size = lo + int(lead[safe[-1] + 1]), SPLIT_BYTES
    yield lo, len(data)


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of texts: `words` as byte arrays, `texts` (doc_id, places of the words)."""
    splitter = Splitter()
    ids: list[pa.Array] = []
    data: list[np.ndarray] = []
    words: list[np.ndarray] = []  # bytes of each word
    counts: list[np.ndarray] = []  # words of each text
    held = 0

    def flush() -> pa.RecordBatch:
        size = np.concatenate([*words, np.empty(0, np.int64)])
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        raw = np.concatenate([*data, np.empty(0, np.uint8)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        own = coded.dictionary
        bounds = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8) if len(own) else np.zeros(1, np.int64)
        flat = np.frombuffer(own.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.int16) if bounds[-1] else np.empty(0, np.int16)
        dictionary = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(flat))
        places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)), coded.indices.cast(pa.int32()))
        texts = pa.StructArray.from_arrays([pa.concat_arrays(ids), places], ["doc_id", "at"])
        whole = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (dictionary, texts)]
        return pa.RecordBatch.from_arrays(whole, ["words", "texts"])

    for batch in batches:
        for lo, hi, part, offsets in text_slices(batch, size=SPLIT_BYTES):
            ids.append(batch.column("doc_id")[lo:hi].cast(pa.int64()))
            if hi - lo == 1:
                sizes = []
                for a, b in _cuts(splitter, part) if len(part) else ():
                    starts = splitter.split(part[a:b], np.array([0, b - a]))
                    sizes.append(np.diff(np.append(starts, b - a)))
                words += sizes
                counts.append(np.array([sum(map(len, sizes))], np.int64))
            elif len(part):
                starts = splitter.split(part, offsets)
                words.append(np.diff(np.append(starts, len(part))))
                counts.append(np.diff(np.searchsorted(starts, offsets, "left")))
            else:
                counts.append(np.zeros(hi - lo, np.int64))
            data.append(part.copy())
            held += len(part)
            if held >= GROUP_BYTES:
                yield flush()
                ids, data, words, counts, held = [], [], [], [], 0
    if ids:
        yield flush()


def _encoded(docs: DataFrame, ranks: Ranks, id_col: str, text_col: str, word_result, text_result) -> DataFrame:
    """One row for each text: text_result(text, results), where results are word_result(ids) of every distinct word."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = rows.mapInArrow(_dictionaries, "words array<array<smallint>>, texts array<struct<doc_id: bigint, at: array<int>>>")
    first = [ranks.pairs.get((a, b), NONE) << RANK_AT | a for a in ranks.byte_ids for b in ranks.byte_ids]
    given = F.struct(
        ranks.map_literal().alias("table"), _numbers(first).alias("pairs"), _numbers([LAST | a for a in ranks.byte_ids]).alias("ends"), _numbers([len(t) for t in ranks.pieces]).cast("array<int>").alias("sizes")
    )

    def encode(word: Column, have: Column) -> Column:
        def start(part: Column) -> Column:
            place = lambda i: F.shiftleft(i.cast("long"), PLACE_AT)
            return F.transform(part, lambda b, i: F.coalesce(F.get(have["pairs"], b * 256 + F.get(part, i + 1)), F.get(have["ends"], b)).bitwiseOR(place(i)))

        symbols = F.when(F.size(word) <= LONG, fold(start(word), have["table"])).otherwise(fold_long(word, start, have["table"], have["sizes"], ranks.lookahead))
        return word_result(F.transform(symbols, lambda x: x.bitwiseAND(long_(ID)).cast("int")))

    # what is made once for a group is bound: literals and results are not copied into the lambdas
    results = bound(given, lambda have: F.transform("words", lambda w: encode(w, have)))
    out = bound(results, lambda r: F.transform("texts", lambda t: text_result(t, r)))
    return groups.select(F.explode_outer(out).alias("t")).select("t.*")


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def token_ids(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def gather(t: Column, results: Column) -> Column:
        return F.struct(t["doc_id"].alias("doc_id"), F.flatten(F.transform(t["at"], lambda i: F.get(results, i))).alias("ids"))

    return _encoded(docs, ranks, id_col, text_col, lambda ids: ids, gather)


def decoded(ids: Column, ranks: Ranks) -> Column:
    """The bytes of ids, piece by piece."""
    return bound(ranks.piece_literal(), lambda pieces: _concatenated(ids, pieces)).cast("binary")


def _concatenated(ids: Column, pieces: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of the decoded bytes) of every whole text.

    Ids are written in decimals and decoded once for each distinct word; a text concatenates what its words gave.
    """
    ranks = Ranks(_tokenizer_bytes(ranks_path))

    def word(ids: Column) -> Column:
        return bound(ids, lambda x: F.struct(F.size(x).alias("n"), F.array_join(F.transform(x, lambda i: i.cast("string")), " ").alias("said"), decoded(x, ranks).cast("string").alias("bytes")))

    def text(t: Column, results: Column) -> Column:
        part = lambda name: F.transform(t["at"], lambda i: F.get(results, i)[name])
        return F.struct(
            t["doc_id"].alias("doc_id"), F.aggregate(part("n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"),
            F.sha2(F.array_join(part("said"), " "), 256).alias("ids_sha256"), F.sha2(F.array_join(part("bytes"), "").cast("binary"), 256).alias("decoded_sha256"),
        )

    return _encoded(docs, ranks, id_col, text_col, word, text)
