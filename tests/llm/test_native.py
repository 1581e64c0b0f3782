"""Operators in DataFrame expressions: quality rules, URL filters, chat formatting; and sharding."""

import hashlib
import random
import re
from collections import Counter

from marlspar.llm import chat, packing, rules, urlrules

WORD = re.compile(r"[^ \t-\r]+")


def test_base_statistics_against_plain_python(spark):
    r = random.Random(4)
    texts = [None, "", " \n ", "a b c a b c", "x\ny\nx\n \n \n", "#a $b |c", "é " * 60, "one two three " * 40]
    texts += [" ".join(r.choice("ab c\n d#") for _ in range(r.randint(0, 200))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (0, None)], "doc_id long, text string")
    got = rules.base_columns(rules.with_words(df)).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        t = texts[row.doc_id] or ""
        w = WORD.findall(t)
        at: dict = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_windows_of_one_hash_and_other_words(spark):
    """Windows A, B, A share the leading bits of their hashes; both of A still count."""
    text = "k880571 x y f1 f2 f3 k3187836 x y g1 g2 g3 k880571 x y e1 e2"
    rows = [(1, text), (2, text.replace("k3187836", "other")), (3, "a b c " * 30 + text), (4, None), (5, "a b"), (6, "a b c a b c")]
    got = {x.doc_id: x.n_repeat_words for x in rules.base_columns(rules.with_words(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 6, 2: 6, 3: 96, 4: 0, 5: 0, 6: 6}


def test_covering_finds_thresholds_and_keeps_the_rest():
    r = random.Random(5)
    rows = [([x := r.random(), y := r.random()], x > 0.8 and y < 0.5) for _ in range(2000)]
    found = rules.cover(rows, ["x", "y"])
    assert found.rules
    names = {lit.feature for rule in found.rules for lit in rule}
    assert names <= {"x", "y"}

    def rejects(v):
        return any(all((v["xy".index(lit.feature)] >= lit.threshold) == lit.above for lit in rule) for rule in found.rules)

    assert sum(rejects(v) == bad for v, bad in rows) > 0.97 * len(rows)
    assert rules.cover([([0.0, 0.0], False)] * 50, ["x", "y"]).rules == []


def test_fit_and_keep(spark):
    r = random.Random(6)
    docs, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        docs.append((k, " ".join(("#|#" if bad and j % 2 else "".join(r.choices("abcdefg", k=5))) for j in range(120)), "extra"))
        labels.append((k, 0 if bad else 1))
    docs.append((900, None, "extra"))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    learned = rules.fit(d, lab)
    assert {x.doc_id for x in rules.judge(d, learned).where("kept").collect()} == {k for k in range(300) if k % 3}
    kept = rules.keep(d, learned)
    assert kept.columns == d.columns and kept.count() == 200
    assert rules.fit(d, lab.limit(0)).rules == [] and rules.judge(d.limit(0), learned).count() == 0


def test_url_rules_against_plain_python(spark):
    table = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "block"), ("example.net", "/en/x/", "block")]
    urls = [None, "", "nothing", "http://EXAMPLE.net/en/x/1?q#f", "https://www.example.net/en/?a", "x://anexample.net/en/", "http://b.a.example.net/en/", "http://example.com/de/a", "http://example.com", "ftp://w.org/fr/#x", "http://org/fr/", "://net/", "http://a://b.net/"] * 3
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").selectExpr("*", "'z' as host", "'y' as stack")
    got = {r.page_id: r for r in urlrules.judge(pages, spark.createDataFrame(table, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in table if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(table, "host string, path string, verdict string")).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a\\n ### b </turn> \\h"), (1, 1, "assistant", "### Assistant: </turn>\n\\\\"), (2, 0, "system", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, 3, "assistant", ""), (2, 4, "assistant", "é😀####"),
        (3, 0, "user", ""), (None, 0, "we: ird###", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as formatted")
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        own = sorted(((t, ro or "", x or "") for i, t, ro, x in rows if i == c))
        assert [(t.role, t.text) for t in r.read_turns] == [(ro, x) for _, ro, x in own]
        assert r.loss_text == "".join(x for _, ro, x in own if ro == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_layouts_are_told_apart_by_their_paths(spark):
    records = [
        '{"messages": [{"content": "a", "role": "user"}, {"role": "assistant", "content": "b"}]}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"response": "b", "prompt": "a"}', '{"instruction": "a", "input": "", "output": "b"}', '{"other": 1}', "broken", None,
    ]
    out = chat.canonical_turns(spark.createDataFrame([*enumerate(records)], "k int, record string")).orderBy("k").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in out] == [[("user", "a"), ("assistant", "b")]] * 4 + [[]] * 3


def test_best_fit_and_its_tree():
    r = random.Random(7)
    tree, ref = packing.CapacityTree(), set()
    for k in range(4000):
        if ref and r.random() < 0.45:
            key = r.choice(sorted(ref))
            tree.discard(key)
            ref.discard(key)
        else:
            key = (r.randint(0, 300), k)
            tree.add(key)
            ref.add(key)
        size = r.randint(0, 320)
        assert tree.tightest(size) == min((x for x in ref if x[0] >= size), default=None)
    sizes = [r.randint(1, 40) ** 2 for k in range(1500)] + [5000, 5000]
    for capacity, at_most in ((1700, None), (4000, None), (60_000, 20), (60_000, 2)):
        got = packing.best_fit_decreasing([*Counter(sizes).items()], capacity, at_most)
        want = plain_best_fit(sizes, capacity, at_most)
        assert (got is None) == (want is None)
        if got is not None:
            mine = Counter()
            for size, into, n in got:
                mine[size, into] += n
            assert mine == Counter(want)
    sums = [0] * 8
    for size, into, n in packing.least_capacity([*Counter(sizes).items()], 8):
        sums[into] += size * n
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 0.01 * max(sums)
    assert packing.best_fit_decreasing([], 10) == []


def plain_best_fit(sizes, capacity, at_most):
    """(size, bin) of every item, one at a time: the fullest bin that still holds it, the first of equal ones."""
    left, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(x, k) for k, x in enumerate(left) if x >= size]
        if fits:
            k = min(fits)[1]
        elif at_most is not None and len(left) >= at_most:
            return None
        else:
            left.append(max(capacity, size))
            k = len(left) - 1
        left[k] -= size
        out.append((size, k))
    return out


def test_groups_of_one_size_are_dealt_whole(spark):
    rows = [(k, f"{k % 90:04d}" + "x" * 96) for k in range(400)] + [(1000 + k, "y" * (k * 7 % 50)) for k in range(120)]
    got = packing.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3).collect()
    groups, sums = {}, Counter()
    for x in got:
        groups.setdefault(x.group_key, set()).add(x.shard)
        sums[x.shard] += x.size
    assert len(got) == len(rows) and all(len(v) == 1 for v in groups.values())
    assert max(sums.values()) - min(sums.values()) <= 5 * 104  # the largest group


def test_shards(spark):
    rows = [(k, "same text" if k % 3 == 0 else None if k == 1 else f"text {k} " * (k % 7)) for k in range(200)] + [(5, "text 5 " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as size", "8 as shard")
    got = packing.shard(df, 4).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for r in got:
        groups.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sum(r.size for r in got) == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert next(r.group_key for r in got if r.doc_id == 1) == hashlib.md5(b"").hexdigest()
    assert packing.shard(df.limit(0), 4).count() == 0


def test_long_texts_keep_their_turns(spark):
    rows = spark.range(1).selectExpr("1L as conv_id", "explode(array(0L, 1L)) as turn").selectExpr("conv_id", "turn", "if(turn = 0, 'user', 'assistant') as role", "if(turn = 0, 'why', repeat('a', 20000001)) as text")
    got = chat.format_conversations(rows).selectExpr("transform(turns, x -> length(x.text)) as n", "length(formatted) as size").collect()
    assert [tuple(x) for x in got] == [([3, 20000001], 20000004 + 2 * len("### : </turn>\n") + len("userassistant"))]


def test_long_records_take_their_turns_from_the_columns(spark, monkeypatch):
    """The record's length counts, not one text's: many turns of middling texts, and texts that JSON makes longer."""
    monkeypatch.setattr(chat, "LONG", 200)
    rows = [(1, k, "user", "x" * 60) for k in range(8)] + [(2, 0, "user", "\x01" * 50), (2, 1, "assistant", "### \\h"), (3, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.read_turns] for r in chat.parse(chat.format_conversations(df)).collect()}
    assert got == {c: [(ro, x) for i, _, ro, x in rows if i == c] for c in (1, 2, 3)}
