"""Decontamination, the Jaccard join, suffix deduplication and the language model against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlspar.llm import decontam, induced, jaccard, kneser_ney, shared, suffixes
from marlspar.llm.components import components
from marlspar.llm.induced import InducedSorter

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = {v: k for k, v in LOWER.items()}


def prose(r, n, vocabulary=400):
    return " ".join("".join(r.choices(["th", "an", "er", "é", "on", "Ti"], k=2 + hash(k) % 3)) + str(k % 7) for k in (r.randint(0, vocabulary) for _ in range(n)))


def edited(r, text, k):
    s = list(text)
    for _ in range(k):
        p = r.randrange(len(s))
        s[p : p + 1] = r.choice([[], ["q"], [s[p], "z"]])
    return "".join(s)


def test_leaks_within_the_budget(spark):
    r = random.Random(8)
    items = [(k, prose(r, r.randint(12, 40), 5000)) for k in range(30)] + [(98, None), (99, "tiny"), (97, "")]
    docs, want = [], set()
    for k, text in items[:30]:
        m = len(text)
        docs.append((k, prose(r, 50) + " " + edited(r, text, r.randint(0, decontam.budget(m))).translate(UPPER).replace(" ", "\n") + " " + prose(r, 20)))
        want.add((k, k))
        docs.append((100 + k, prose(r, 60)))
        docs.append((200 + k, prose(r, 9) + text[: m // 2]))
    docs += [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1]), (303, (items[1][1] + " sep ") * 2)]
    want |= {(302, 0), (303, 1)}
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d, i).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert sorted(x.edits for x in got if x.doc_id in (302, 303)) == [0, 0, 0, 0]
    for x in got:
        if x.doc_id in (302, 303):
            text = next(t for k, t in docs if k == x.doc_id)
            assert text[x.start_char : x.end_char] == items[x.item_id][1]
    blocks = decontam.leaks(d, i, block_bytes=600).collect()
    assert {(x.doc_id, x.item_id) for x in blocks} == want
    clean = decontam.clean(d, i)
    assert clean.columns == d.columns and {x.doc_id for x in clean.collect()} == {k for k, _ in docs} - {k for k, _ in want}
    assert decontam.leaks(d.limit(0), i).count() == 0 and decontam.leaks(d, i.limit(0)).count() == 0


def closest(item, text):
    """(edits, end) of the passage of the text with the least edit distance to the item, by the plain table."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min((e, j) for j, e in enumerate(row))


def test_leaks_against_the_edit_distance(spark):
    """All pairs by the plain table; found passages have the edits that they are said to have."""
    r = random.Random(77)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    items = [(k, letters(r.randint(10, 120))) for k in range(25)] + [(50, "QxQ"), (51, "x"), (52, "zz yy"), (53, "abcdefghi")]
    texts = []
    for k in range(50):
        m = r.choice(items)[1]
        texts.append((k, letters(40) + " " + edited(r, m, r.randint(0, max(1, len(m) // 14))) + " " + letters(r.randint(0, 40))))
    texts += [(60, "qxq"), (61, "aqxq"), (62, "(qXq), zz\nyy!"), (63, "x-ray"), (64, "xx"), (65, "é" + "x"), (66, None), (67, "")]
    d, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d, i).collect()
    plain = lambda t: decontam.characters((t or "").encode()).tolist()
    want = set()
    for k, t in texts:
        for n, m in items:
            x, y = plain(m), plain(t)
            if len(x) >= decontam.Q:
                if closest(x, y)[0] <= decontam.budget(len(x)):
                    want.add((k, n))
            elif any(y[j : j + len(x)] == x and not any(chr(c).isalnum() for c in (*y[max(0, j - 1) : j], *y[j + len(x) : j + len(x) + 1])) for j in range(len(y))):
                want.add((k, n))
    assert {(x.doc_id, x.item_id) for x in got} == want
    by_doc, by_item = dict(texts), dict(items)
    for x in got:
        passage = plain(by_doc[x.doc_id])[x.start_char : x.end_char]
        item = plain(by_item[x.item_id])
        row = [*range(len(passage) + 1)]
        for k, a in enumerate(item, 1):
            new = [k]
            for j, b in enumerate(passage, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        assert row[-1] == x.edits
    assert decontam.clean(d, i).count() == len(texts) - len({k for k, _ in want})


def brute_components(texts, percent, width):
    sets = {}
    for k, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_jaccard_components(spark, percent, width):
    r = random.Random(percent)
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE "), (6, "two words"), (7, "two words"), (8, "a b c"), (9, "a b c d")]
    for group in range(6):
        base = prose(r, r.choice([15, 60, 200]), 3000).split()
        for copy in range(12):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = f"new{r.randint(0, 99)}"
            texts.append((100 + group * 20 + copy, " ".join(w)))
    boiler = prose(r, 40, 3000)
    texts += [(300 + k, boiler + " " + prose(r, 3, 9000)) for k in range(15)] + [(400 + k, prose(r, 80, 3000)) for k in range(20)]
    df = spark.createDataFrame([*texts, texts[3]], "doc_id long, text string").selectExpr("*", "1 as n", "2 as component_id")
    got = jaccard.link(df, percent, width).collect()
    want = brute_components(texts, percent, width)
    assert len(got) == len(texts) + 1
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    if percent == 80:
        kept = jaccard.deduplicate(df, percent, width)
        assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {c for _, c in want.values()}
        assert jaccard.link(df.limit(0)).count() == 0


def brute_links(texts, percent, width):
    sets = {}
    for k, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    kinds = set(sets.values())
    return {k: sum(s != o and 100 * len(s & o) >= percent * len(s | o) for o in kinds if o) if s else 0 for k, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_links_inside_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    r = random.Random(block)
    base = [f"w{k}" for k in range(120)]
    texts = [(k, " ".join([*base, f"end{k}"])) for k in range(40)]  # all link with each other
    for k in range(40, 70):  # a chain: neighbours link, ends do not
        texts.append((k, " ".join(f"c{j}" for j in range(3 * (k - 40), 3 * (k - 40) + 100))))
    texts += [(80, texts[0][1]), (81, texts[50][1]), (90, "alone in the world"), (91, None), (92, prose(r, 50, 3000))]
    got = jaccard.link(spark.createDataFrame([*texts, texts[3], texts[45]], "doc_id long, text string").repartition(3), 90, 3)
    want = brute_links(texts, 90, 3)
    assert max(want.values()) == 39 and {x.doc_id: x.n_links for x in got.collect()} == want


def thue_morse(n):
    """A word and its complement, which polynomial hashes modulo 2**64 take for one from 1,024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_are_told_apart(spark):
    one, two = thue_morse(2048)
    texts = [(0, one), (3, two), (4, f"{one} x y z"), (5, f"{two} x y z"), (6, one.upper())]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.link(df).collect()} == {0: 0, 3: 3, 4: 4, 5: 5, 6: 0}
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2]
    free = [k for k in range(40) if k not in held]
    df = spark.createDataFrame([(free[0], one), (held[0], two), (held[1], one)], "doc_id long, text string")
    got = {x.doc_id: x.n_known for x in kneser_ney.score(df, kneser_ney.train(df)).collect()}
    assert got == {free[0]: 2, held[0]: 1, held[1]: 2}


def test_null_and_large_ids(spark):
    """A null doc_id beside ids that doubles cannot tell apart, in one batch."""
    r, big = random.Random(31), 2**53
    text, other = prose(r, 60), prose(r, 60, 3000)
    rows = [(big, text), (big + 1, text), (None, text), (None, other), (1, other), (big + 3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((x.doc_id is None, x.doc_id), x.component_id, x.n_links) for x in jaccard.link(df, 90, 3).collect() if x.doc_id is not None)
    assert [g[1] for g in got] == [1, big, big, big + 3]
    assert all(x.component_id is None for x in jaccard.link(df).collect() if x.doc_id is None)
    kept = [x.doc_id for x in jaccard.deduplicate(df, 80, 5).collect()]
    assert sorted(k for k in kept if k is not None) == [1, big, big + 3] and kept.count(None) == 3
    got = [(x.doc_id, x.n_bytes, x.n_removed) for x in suffixes.deduplicate(df).collect()]
    size, own = len(text.encode()), len(other.encode())
    assert sorted(got, key=str) == sorted([(big, size, 0), (big + 1, size, size), (None, size, 0), (None, own, 0), (1, own, 0), (big + 3, 0, 0), (None, 0, 0)], key=str)
    assert sorted(str(x.doc_id) for x in suffixes.rewrite(df).collect()) == sorted(str(k) for k, _ in rows if k != big + 1)
    item = spark.createDataFrame([(5, text[10:200]), (6, None)], "item_id long, text string")
    assert sorted(str(x.doc_id) for x in decontam.leaks(df, item).collect()) == sorted(["None", str(big), str(big + 1)])
    assert decontam.clean(df, item).count() == 4
    scores = kneser_ney.score(df, kneser_ney.train(df)).collect()
    assert len(scores) == len(rows) and {x.doc_id for x in scores} == {k for k, _ in rows}


@pytest.mark.parametrize("order", [1, -1])
def test_hot_copies_and_hot_links(spark, order):
    """A third of all rows are copies of one text, another third links with it."""
    base = [f"w{k}" for k in range(60)]
    texts = [(order * k, " ".join(base)) for k in range(60)] + [(order * (100 + k), " ".join([*base, f"x{k}"])) for k in range(60)] + [(order * (300 + k), prose(random.Random(k), 40, 3000)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    want = brute_components(texts, 90, 3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link(df).collect()} == want
    assert sorted(x.doc_id for x in jaccard.deduplicate(df, 90, 3).collect()) == sorted({c for _, c in want.values()})


def test_sorted_ids(spark, monkeypatch):
    monkeypatch.setattr(shared.IdRanges, "RANGE", 50)
    ids = [k * 37 % 1009 - 300 for k in range(400)] + [2**53 + 1]
    held = shared.IdRanges.write(spark.createDataFrame([(i,) for i in ids], "id long"))
    asked = np.array([*range(-400, 900), 2**53, 2**53 + 1, -(2**63)], np.int64)
    assert held.holds(asked).tolist() == [i in set(ids) for i in asked.tolist()] and len(held.starts) > 3
    assert not shared.IdRanges.write(spark.createDataFrame([], "id long")).holds(asked).any()


def test_overlaps():
    r = np.random.default_rng(3)
    for top in (20, 300, 100_000):
        xs, ys = ([np.unique(r.integers(0, top, r.integers(1, 200))).astype(np.uint64) for _ in range(n)] for n in (30, 50))
        assert jaccard.overlaps(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (3, 2)]
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 120)}


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_induced_order_and_prefixes(monkeypatch, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    r, spilled, levels = random.Random(9), 0, 0
    for _ in range(40):
        base = [bytes(r.choice(b"abcab\xc3\xa9 ") for _ in range(r.randint(1, 300))) for _ in range(3)]
        parts = []
        for _ in range(r.randint(1, 6)):
            b = r.choice(base)
            parts.append(b[r.randint(0, len(b) - 1) :] + r.choice([b"", b"a" * r.randint(0, 220), b"\xf4" * r.randint(0, 130)]))
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        s = InducedSorter.of_parts(iter([(data, ends)]), len(data) + len(ends), r.choice([1 << 30, 300]))  # the second spills and recurs
        previous, seen = None, 0
        for pos, lcp in s.stream():
            for p, v in zip(pos.tolist(), lcp.tolist(), strict=True):
                b = s.x[p : p + 104].tolist()
                if previous is not None:
                    a = s.x[previous : previous + 104].tolist()
                    assert a >= b
                    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                    assert min(n, 100) == min(v, 100)
                previous, seen = p, seen + 1
        assert seen == len(s.x)
        spilled, levels = spilled + s.spilled, max(levels, s.levels)
    assert spilled and levels > 1


def test_a_shard_larger_than_its_memory():
    """Runs of 60 kB with 4 kB for queues: the same result, from files and through recursion."""
    r = random.Random(14)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=40)) for _ in range(40)]
    texts = [(r.choice(passages)[: r.randint(60, 130)] + " ".join(r.choices(words, k=12))).encode()[:168] for _ in range(400)]
    texts = [t for t in texts if len(t) >= 100]
    got = []
    for limit in (1 << 30, 4 << 10):
        shard = suffixes.Shard(limit)
        for a in range(0, len(texts), 100):
            part = texts[a : a + 100]
            runs = np.array([(7 * (a + k) % 10_007, k, len(t)) for k, t in enumerate(part)], suffixes._RUN)
            shard.add(runs, b"".join(part))
        blocks = [*shard.repeated()]
        if limit < 1 << 20:
            assert shard.spilled > 1 << 20 and shard.levels >= 1
        got.append([x.tolist() for x in suffixes.merge(*(np.concatenate([b[j] for b in blocks]) for j in range(3)))])
    assert got[0] == got[1] and len(got[0][0]) > 100


def test_suffix_dedup(spark):
    r = random.Random(10)
    passage = prose(r, 40)
    texts = [(9, passage), (3, prose(r, 30) + passage + prose(r, 5) + passage), (4, "é" * 400), (5, None), (6, ""), (7, "short"), (8, "short"), (10, prose(r, 60)), (2, "ab" * 120 + prose(r, 20))]
    texts += [(20 + k, passage[k : k + 150] + prose(r, 10)) for k in range(30)] + [(60, texts[7][1]), (61, texts[7][1] + "!"), (70, "x" * 99), (71, "x" * 99)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'1' as bucket", "length(text) as n_chars").repartition(3)
    got = {x.doc_id: x for x in suffixes.deduplicate(df).collect()}
    # runs of hot anchors are divided into windows: the same result
    assert {x.doc_id: x for x in suffixes.deduplicate(df, 1 << 12, 3).collect()} == got
    seen: set = set()
    kept_texts = {}
    for k, t in sorted(texts):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cut[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()), k
        if kept or not b:
            kept_texts[k] = None if t is None else kept.decode(errors="ignore")  # a null text stays null
    out = suffixes.rewrite(df)
    assert out.columns == df.columns and {x.doc_id: x.text for x in out.collect()} == kept_texts
    assert suffixes.deduplicate(df.limit(0)).count() == 0


def test_repeated_rows_stay(spark):
    r = random.Random(12)
    passage, own = prose(r, 30), prose(r, 60)
    assert len(passage.encode()) >= 100
    texts = [(1, passage + "|" + own)] * 2 + [(2, prose(r, 20) + "#" + passage + "#" + prose(r, 5))] * 3 + [(3, own)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {(x.doc_id, x.n_removed) for x in suffixes.deduplicate(df).collect()}
    assert got == {(1, 0), (2, len(passage.encode())), (3, len(own.encode()))}
    assert sorted(x.doc_id for x in suffixes.rewrite(df).collect()) == [1, 1, 2, 2, 2]
    kept = jaccard.deduplicate(df, 80, 5)
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2, 3]


def test_repeated_places_in_a_shard():
    text = np.random.default_rng(5).integers(97, 123, 150).astype(np.uint8).tobytes()
    shard = suffixes.Shard()
    shard.add(np.array([(4, 0, 150), (4, 0, 150), (5, 7, 150)], suffixes._RUN), text * 3)
    blocks = [*shard.repeated()]
    assert [x.tolist() for x in suffixes.merge(*(np.concatenate([b[j] for b in blocks]) for j in range(3)))] == [[5], [7], [157]]


def test_huge_texts_are_cut_into_parts(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.window_anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffixes, "_PART", 700)
    parts = suffixes.window_anchors(data, np.array([0, len(data)]))
    spread = lambda x: {p: h for a, b, h in zip(*x[1:], strict=True) for p in range(a, b)}
    assert spread(whole) == spread(parts)


def test_language_model(spark):
    r = random.Random(11)
    texts = [(k, prose(r, r.randint(0, 60), 60)) for k in range(120)] + [(500, None), (501, ""), (502, "Never seen words")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as score", "2 as n").repartition(3)
    model = kneser_ney.train(df)
    got = {x.doc_id: x for x in kneser_ney.score(df, model).collect()}
    docs = {k: [*WORD.findall((t or "").translate(LOWER)), "\0end"] for k, t in texts}
    train = {k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2}
    c1, c2 = Counter(), Counter()
    for k in train:
        c1.update(docs[k])
        c2.update(zip(["\0start", *docs[k]], docs[k], strict=False))
    n, v = sum(c1.values()), len(c1)
    context, follows = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), c in c2.items():
        context[u][0] += c
        context[u][min(c, 3)] += 1
        follows[w] += 1
    kinds = lambda values: np.array([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d, e = kneser_ney.discounts(kinds(c2.values())), kneser_ney.discounts(kinds(follows.values()))
    classes = Counter(min(x, 3) for x in follows.values())
    left = sum(e[k] * classes[k] for k in (1, 2, 3)) / len(c2) / (v + 1)

    def p(u, w):
        one = max(follows[w] - e[min(follows[w], 3)], 0) / len(c2) + left
        if u not in context:
            return one
        x, c = context[u], c2[u, w]
        return max(c - d[min(c, 3)], 0) / x[0] + sum(d[k] * x[k] for k in (1, 2, 3)) / x[0] * one

    for k, w in docs.items():
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (k not in train, len(w), sum(c1[t] > 0 for t in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c1[t] + 1) / (n + v + 1)) for t in w))
        assert x.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["\0start", *w], w, strict=False)))
    # probabilities after any context sum to one over the known words and one unknown
    for u in ["\0start", docs[0][0], "unseen"]:
        assert sum(p(u, w) for w in c1) + p(u, "\0unknown") == pytest.approx(1)
    empty = kneser_ney.train(df.limit(0))
    assert kneser_ney.score(df.limit(0), empty).count() == 0
    assert all(x.score == 0 for x in kneser_ney.score(df.limit(3), empty).collect())


def test_rewrite_keeps_null_texts(spark):
    rows = [(1, None, None), (2, "", 0), (3, "a" * 150, 150), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, suffixes.rewrite(df).collect()), key=str) == sorted([(1, None, None), (2, "", 0), (3, "a" * 150, 150), (None, None, 7)][:2] + [(None, None, 7)] + [tuple(r) for r in suffixes.rewrite(df.where("doc_id = 3")).collect()], key=str)
