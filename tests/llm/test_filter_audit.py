"""The filter audit against plain Python over small tables."""

import random
import re
from itertools import permutations

from marlspar.llm import filter_audit

WORD = re.compile(r"[^ \t-\r]+")


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, source in docs:
        t, w = text or "", WORD.findall(text or "")
        copy = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        rows.append((source or "", {k for k in fails if fails[k]}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                early = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), early, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step][6] = shapley[f]
    return out


def got(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as mask", "3 as digest", "4 as n", "5 as first", "6 as good")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part", "2 as source")
    rows = filter_audit.audit(d, x).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_plain_python(spark):
    r = random.Random(7)
    texts = [None, "", " \t\n", "A B", "a " * 250, "漢字 é x" * 80, " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(300)) + " #", "x\x0by\x0cz q　r"]
    texts += ["".join(r.choice("ab cD#\n") for _ in range(r.randint(0, 900))) for _ in range(30)]
    docs = [(k, r.choice(texts), r.choice(["a", "b", None, ""])) for k in range(150)]
    docs += [docs[3], docs[3], (None, texts[6], "a"), (None, None, None), (-5, texts[6], "b")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_slices_do_not_matter_and_empty_tables(spark, monkeypatch):
    docs = [(k, "a b c " * k, "s") for k in range(120)]
    whole = got(spark, docs, [])
    assert whole == brute(docs, []) and len(whole) == 600
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", 10)
    assert [*filter_audit._facts(iter([]))] == []
    assert got(spark, [], []) == {}
    assert got(spark, docs[:5], [(1, 1, 1)])["s", "ABCDE", 1][:2] == [0, 5]
