"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. The merge list fixes how far text to the right can reach back: a token can only be changed by
a higher-ranked merge that takes one of its right-edge parts, whose partner may in turn lose a part to a
still higher-ranked merge, and so on. Ranks strictly rise along such a chain, so the longest chain is a
finite *sufficient lookahead* in bytes (`MergeTable.lookahead`), found by one pass over the merges. A token is
stable, and emitted, once its right neighbour's first byte lies that far from the end of what has been read.

Every text passes through `Transducer`, which reads pieces of PIECE bytes and holds back: a character or special
token that is not complete, the last three words (the pre-tokeniser may still join them), and of a word longer than
HOLD bytes only the unstable end. So a step's memory does not depend on the text's length. Texts of less than a
piece share a step: all distinct words of a block merge together in vectorised rounds, those longer than the lookahead
by a sliding window.

Decoding. `Decoder` maps ids to bytes and feeds them through an incremental UTF-8 state machine that holds
back at most three bytes and replaces broken sequences as a lossy decoder does.

Cases: a null or empty text has no tokens and decodes to the empty text; the special token's string in a text
is that one id; repeated rows and ties are independent rows; an empty table gives an empty result; columns of
the input other than the id and the text are not carried, so clashing names cannot occur.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import U64, block_hashes, text_slices
from .shared import prepare

#: Bytes of short texts in one vectorised step: larger ones share more words.
SLICE_BYTES = 4 << 20
#: Bytes that the transducer reads at a time, and of which an unfinished word is emitted in part.
PIECE, HOLD = 1 << 19, 1 << 14
#: Bytes beyond the lookahead of one window of a long word.
WINDOW = 4096
NO_RANK = np.uint32(0xFFFFFFFF)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Letters and numbers (first, last code point) that Unicode 14.0 to 16.0 added; the libraries know them,
#: older character tables do not.
NEW_LETTERS = (
    (0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD), (0x170D, 0x170D), (0x171F, 0x171F), (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A),
    (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7C1), (0xA7CB, 0xA7CD), (0xA7D0, 0xA7D1), (0xA7D3, 0xA7D3), (0xA7D5, 0xA7DC), (0xA7F2, 0xA7F4), (0x10570, 0x1057A),
    (0x1057C, 0x1058A), (0x1058C, 0x10592), (0x10594, 0x10595), (0x10597, 0x105A1), (0x105A3, 0x105B1), (0x105B3, 0x105B9), (0x105BB, 0x105BC), (0x105C0, 0x105F3), (0x10780, 0x10785),
    (0x10787, 0x107B0), (0x107B2, 0x107BA), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x10F70, 0x10F81), (0x11071, 0x11072), (0x11075, 0x11075), (0x1123F, 0x11240),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11740, 0x11746), (0x11AB0, 0x11ABF),
    (0x11BC0, 0x11BE0), (0x11F02, 0x11F02), (0x11F04, 0x11F10), (0x11F12, 0x11F33), (0x12F90, 0x12FF0), (0x1342F, 0x1342F), (0x13441, 0x13446), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16A70, 0x16ABE), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB), (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132), (0x1B155, 0x1B155),
    (0x1DF00, 0x1DF1E), (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD), (0x1E4D0, 0x1E4EB), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E7E0, 0x1E7E6), (0x1E7E8, 0x1E7EB),
    (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x11F50, 0x11F59), (0x16130, 0x16139), (0x16AC0, 0x16AC9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1D2C0, 0x1D2D3),
    (0x1E4F0, 0x1E4F9), (0x1E5F1, 0x1E5FA),
)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Class of every code point in Unicode 16.0: letter (L*), number (N*), white space or other, whatever version this Python knows."""
    import unicodedata

    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    out = np.zeros(0x110000, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


class MergeTable:
    """A byte-level merge list, as read from the JSON bytes of a tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_characters()
        self.byte_id = np.array([vocab[c] for c in chars], np.uint32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        code = {c: b for b, c in enumerate(chars)}
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(code[c] for c in text)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.left = np.array([vocab[a] for a, _ in pairs], np.uint32)
        self.right = np.array([vocab[b] for _, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self._index()
        self.lookahead = self._sufficient_lookahead()

    def _index(self) -> None:
        """An open-addressing table from a pair of ids to its rank."""
        keys = self.left.astype(U64) << U64(32) | self.right.astype(U64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, U64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NO_RANK)
        todo, ranks, shift = keys, np.arange(len(keys), dtype=np.uint32), 0
        while len(todo):
            slot = (self._slot(todo) + shift) & ((1 << self.bits) - 1)
            first = np.unique(slot, return_index=True)[1]
            first = first[self.ranks[slot[first]] == NO_RANK]
            self.keys[slot[first]], self.ranks[slot[first]] = todo[first], ranks[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, ranks, shift = todo[rest], ranks[rest], shift + 1
        self.probes = shift

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where the list has no such merge."""
        keys = left.astype(U64) << U64(32) | right.astype(U64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NO_RANK)
        todo = np.flatnonzero((out == NO_RANK) & (self.ranks[slot] != NO_RANK))
        for shift in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + shift) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (self.ranks[at] != NO_RANK)]
        return out

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right of a token that decide it, over all chains of ever higher-ranked merges."""
        own_rank: dict[int, int] = {}
        last: dict[int, int] = {}
        by_left: dict[int, tuple[list[int], list[int]]] = {}
        best = 1
        for rank, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True)):
            reach, part, limit = 0, b, rank
            while True:  # the right edge of b: b itself, then its right part, ...
                if part in by_left:
                    ranks, most = by_left[part]
                    if k := bisect.bisect_left(ranks, limit):
                        reach = max(reach, most[k - 1])
                if part not in last:
                    break
                limit, part = own_rank[part], last[part]
            reach += int(self.lengths[b])
            ranks, most = by_left.setdefault(a, ([], []))
            ranks.append(rank)
            most.append(max(reach, most[-1] if most else 0))
            own_rank.setdefault(c, rank)
            last.setdefault(c, b)
            best = max(best, reach)
        return best

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end], concatenated, and each word's number of ids."""
        sizes = (ends - starts).astype(np.int64)
        count = len(sizes)
        word = np.repeat(np.arange(count), sizes)
        at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        sym = self.byte_id[data[at]]
        done_sym, done_word = [], []
        while len(sym) > 1:
            rank = np.full(len(sym), NO_RANK)
            rank[:-1] = self.rank_of(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_RANK
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            spans = np.diff(np.concatenate((first, [len(sym)])))
            busy = np.repeat(least != NO_RANK, spans)
            if not busy.all():
                done_sym.append(sym[~busy])
                done_word.append(word[~busy])
                sym, word, rank = sym[busy], word[busy], rank[busy]
                least = least[least != NO_RANK]
                if not len(sym):
                    break
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                spans = np.diff(np.concatenate((first, [len(sym)])))
            hit = rank == np.repeat(least, spans)
            where = np.flatnonzero(hit)
            # of overlapping hits (a a a) take every second one from the left
            new_run = np.concatenate(([True], np.diff(where) != 1))
            order = np.arange(len(where))
            where = where[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=count)


class Splitter:
    """Where words begin in UTF-8 bytes."""

    def __init__(self):
        self.classes = character_classes()

    def kinds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, code point and class of every character."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        b0 = data[lead].astype(np.uint32)
        cp = b0.copy()
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32) if (b0 >= 0x80).any() else None
        for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
            if padded is None:
                break
            k = np.flatnonzero((b0 >= low) & (b0 < high))
            value = b0[k] & (0x3F >> more)
            for j in range(1, more + 1):
                value = value << 6 | padded[lead[k] + j] & 0x3F
            cp[k] = np.minimum(value, 0x10FFFF)
        return lead, cp, self.classes[cp]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which words begin, by the byte-level pre-tokeniser's rule; rows are apart."""
        lead, cp, kind = self.kinds(data)
        n = len(cp)
        rows = np.zeros(n + 1, bool)
        rows[np.searchsorted(lead, offsets)] = True
        edge = np.ones(n, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | rows[1:n]
        begins = edge.copy()
        inner = np.flatnonzero(edge & (kind != SPACE) & ~rows[:n])
        inner = inner[kind[inner - 1] == SPACE]  # runs right after white space
        begins[inner - 1] = True
        begins[inner[cp[inner - 1] == 0x20]] = False
        tick = np.flatnonzero((cp == 0x27) & begins)
        tick = tick[tick + 1 < n]
        tick = tick[~rows[tick + 1]]
        c1 = cp[tick + 1]
        short = tick[np.isin(c1, [ord(c) for c in "stmd"])]
        far = tick[tick + 2 < n]
        far = far[~rows[far + 2]]
        c1, c2 = cp[far + 1], cp[far + 2]
        long = far[((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))]
        for at, size in ((short, 2), (long, 3)):
            begins[at + 1] = False
            begins[(at + size)[at + size < n]] = True
        return lead[begins]


class Encoder(Splitter):
    """Text to ids; `slice` takes whole rows at once, `Transducer` one text in pieces."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def slice(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, concatenated, and each row's number of ids (no special tokens).

        starts: where words begin, if that is known from more text than the slice has.
        """
        rows = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(rows, np.int64)
        starts = self.split(data, offsets) if starts is None else starts
        ends = np.append(starts[1:], len(data))
        _, first, same = np.unique(block_hashes(data, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        ids, counts = self._words(data, s, e)
        at = np.cumsum(counts) - counts
        per_word = counts[same]
        total = int(per_word.sum())
        pick = np.arange(total) - np.repeat(np.cumsum(per_word) - per_word, per_word) + np.repeat(at[same], per_word)
        out = ids[pick]
        words_of_row = np.searchsorted(starts, offsets, "left")
        upto = np.concatenate(([0], np.cumsum(per_word)))
        counts = np.diff(upto[words_of_row])
        if not np.array_equal(self.bytes_of(out), data):  # two words with one hash
            parts = [self._words(data, starts[a:b], ends[a:b])[0] for a, b in zip(words_of_row, words_of_row[1:], strict=False)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out, counts

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = self.table.lookahead
        long = np.flatnonzero(ends - starts > limit)
        if not len(long):
            return self.table.merge(data, starts, ends)
        short = np.flatnonzero(ends - starts <= limit)
        parts: list[np.ndarray] = [None] * len(starts)  # type: ignore[list-item]
        ids, counts = self.table.merge(data, starts[short], ends[short])
        for k, part in zip(short, np.split(ids, np.cumsum(counts)[:-1]), strict=True) if len(short) else ():
            parts[k] = part
        for k in long:
            parts[k] = self.word(data[starts[k] : ends[k]])[0]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def word(self, data: np.ndarray, ended: bool = True) -> tuple[np.ndarray, int]:
        """Stable ids of a word (all, if it has ended) and the bytes they stand for; a window slides over it."""
        at, window, out = 0, WINDOW + self.table.lookahead, []
        while at < len(data):
            part = data[at : at + window]
            last = at + len(part) == len(data)
            ids, _ = self.table.merge(part, np.array([0]), np.array([len(part)]))
            if last and ended:
                out.append(ids)
                at = len(data)
                break
            ends = np.cumsum(self.table.lengths[ids])
            stable = int(np.searchsorted(ends, len(part) - self.table.lookahead, "right"))
            if stable:
                out.append(ids[:stable])
                at += int(ends[stable - 1])
            if last or not stable:
                break
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), at

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        sizes = self.table.lengths[ids]
        at = np.cumsum(sizes)
        if not len(at):
            return np.empty(0, np.uint8)
        return self.table.flat[np.arange(int(at[-1])) + np.repeat(self.table.starts[ids] - at + sizes, sizes)]

    def stream(self, pieces: Iterator[bytes]) -> Iterator[np.ndarray]:
        """Ids of one text that comes in pieces, special tokens included."""
        state = Transducer(self)
        for piece in pieces:
            yield from state.feed(piece)
        yield from state.feed(b"", True)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Iterator[np.ndarray]]:
        """Ids of each row of a slice in pieces, special tokens included."""
        marked = set(np.flatnonzero(np.diff(offsets) > PIECE).tolist())
        for special in self.table.special:
            for at in find_all(data, special.encode()):
                marked.add(int(np.searchsorted(offsets, at, "right")) - 1)
        if len(marked) < len(offsets) - 1:
            plain = np.ones(len(offsets) - 1, bool)
            plain[list(marked)] = False
            size = np.where(plain, np.diff(offsets), 0)
            rest = data if not marked else data[np.repeat(plain, np.diff(offsets))]
            ids, counts = self.slice(rest, np.concatenate(([0], np.cumsum(size))))
        else:
            ids, counts = np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.cumsum(counts)
        for k, (end, count) in enumerate(zip(ends, counts, strict=True)):
            if k in marked:
                yield self.stream(data[i : min(i + PIECE, offsets[k + 1])].tobytes() for i in range(int(offsets[k]), int(offsets[k + 1]), PIECE))
            else:
                yield iter((ids[end - count : end],))


def find_all(data: np.ndarray, mark: bytes) -> Iterator[int]:
    """Places of a byte string, without a copy of the data."""
    first = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        if not len(first):
            break
        first = first[data[first + k] == mark[k]]
    yield from first.tolist()


class Transducer:
    """The encoder's state between the pieces of one text."""

    def __init__(self, encoder: Encoder):
        self._encoder = encoder
        self._held = b""
        #: Class of the unfinished word whose first ids are out already; None between words.
        self._inside: int | None = None
        self._marks = {m.encode(): i for m, i in encoder.table.special.items()}

    def feed(self, piece: bytes, final: bool = False) -> Iterator[np.ndarray]:
        """The ids that have become stable."""
        data = self._held + piece
        self._held = b""
        while data:
            found = min(((at, -len(m), m) for m in self._marks if (at := data.find(m)) >= 0), default=None)
            if found is None:
                break
            at, _, mark = found
            yield from self._run(data[:at], True)
            yield np.array([self._marks[mark]], np.uint32)
            data = data[at + len(mark) :]
        open_end = 0 if final else max((k for m in self._marks for k in range(1, len(m)) if data.endswith(m[:k])), default=0)
        if not final:  # an unfinished character
            for k in range(1, min(4, len(data)) + 1):
                if data[-k] >= 0xC0:
                    need = 2 if data[-k] < 0xE0 else 3 if data[-k] < 0xF0 else 4
                    open_end = max(open_end, k if k < need else 0)
                if data[-k] < 0x80 or data[-k] >= 0xC0:
                    break
        body = data[: len(data) - open_end]
        yield from self._run(body, final)
        self._held += data[len(body) :]

    def _run(self, raw: bytes, ended: bool) -> Iterator[np.ndarray]:
        """Ids of text without special tokens; what is not stable goes to `_held`, nothing if the text has ended."""
        encoder, data = self._encoder, np.frombuffer(raw, np.uint8)
        if self._inside is not None and len(data):
            lead, _, kind = encoder.kinds(data)
            other = np.flatnonzero(kind != self._inside)
            end = len(data)
            if len(other):
                # white space before a word: its last character belongs to what follows
                first = int(other[0]) - (self._inside == SPACE)
                end = int(lead[first]) if first >= 0 else 0
            over = ended or len(other) > 0
            ids, used = encoder.word(data[:end], over)
            if len(ids):
                yield ids
            if not over:
                self._held = raw[used:]
                return
            data, self._inside = data[end:], None
        if ended:
            self._inside = None
            if len(data):
                yield encoder.slice(data, np.array([0, len(data)]))[0]
            return
        if not len(data):
            return
        starts = encoder.split(data, np.array([0, len(data)]))
        cut = int(starts[-3]) if len(starts) >= 3 else 0
        long = len(data) - int(starts[-1]) > HOLD
        if long:
            cut = int(starts[-1])
        if cut:
            yield encoder.slice(data[:cut], np.array([0, cut]), starts[starts < cut])[0]
        rest = data[cut:]
        if long:
            kind = int(encoder.kinds(rest[-4:][np.flatnonzero((rest[-4:] & 0xC0) != 0x80)[-1] :])[2][-1])
            # white space keeps its last character back, as it may belong to what follows
            ids, used = encoder.word(rest, False)
            self._inside = kind
            if len(ids):
                yield ids
            rest = rest[used:]
        self._held = rest.tobytes()


class Decoder:
    """Ids to text, piece by piece: at most an unfinished UTF-8 sequence is held between pieces."""

    def __init__(self, encoder: Encoder):
        self._bytes_of = encoder.bytes_of
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        """The text that has become certain."""
        return self._state.decode(self._bytes_of(ids).tobytes(), final)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """The encoder of a tokenizer file's bytes; built once in each worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(MergeTable(raw))
    return _ENCODERS[key]


#: A tokenizer file above this is refused rather than broadcast.
MAX_TOKENIZER_BYTES = 64 << 20


def _tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path}: more than {MAX_TOKENIZER_BYTES} bytes")
    return raw


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return per row: id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers; with_ids adds them as binary `ids`.
    """
    spark = docs.sparkSession
    prepare(spark)
    raw = spark.sparkContext.broadcast(_tokenizer_bytes(tokenizer_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(raw.value)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, size=SLICE_BYTES):
                counts, ids_sha, text_sha, kept = [], [], [], []
                for pieces in encoder.rows(data, offsets):
                    decoder, of_ids, of_text, count, out = Decoder(encoder), hashlib.sha256(), hashlib.sha256(), 0, []
                    for ids in pieces:
                        packed = ids.astype("<u4").tobytes()
                        of_ids.update(packed)
                        of_text.update(decoder.feed(ids).encode())
                        count += len(ids)
                        if with_ids:
                            out.append(packed)
                    of_text.update(decoder.feed(np.empty(0, np.uint32), True).encode())
                    counts.append(count)
                    ids_sha.append(of_ids.hexdigest())
                    text_sha.append(of_text.hexdigest())
                    kept.append(b"".join(out))
                columns = [batch.column("doc_id")[lo:hi].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * with_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """n_tokens of every whole text, already counted up within each slice: rows (n_tokens, n_docs)."""
    spark = docs.sparkSession
    prepare(spark)
    raw = spark.sparkContext.broadcast(_tokenizer_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(raw.value)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, size=SLICE_BYTES):
                size, count = np.unique([sum(map(len, pieces)) for pieces in encoder.rows(data, offsets)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(count, pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
