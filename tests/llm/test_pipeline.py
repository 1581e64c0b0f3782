"""The pipeline's stages on a small table: each against what was planted, the last one against the library."""

import hashlib
import random

import numpy as np
import tokenizers

import corpus_pipeline as p
from marlspar.llm.queries import tokenizer_file


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(n))


def test_stages_by_what_was_planted(spark, tmp_path):
    r = random.Random(3)
    texts = {k: words(r, 90) for k in range(12)}
    texts[20] = texts[0]  # an exact copy
    texts[21] = texts[1].rsplit(" ", 1)[0] + " changed"  # a near copy
    passage = words(r, 40)
    texts[30], texts[31] = f"{words(r, 80)} {passage} {words(r, 5)}", f"{words(r, 80)} {passage} {words(r, 5)}"
    item = words(r, 30)
    texts[40] = f"{words(r, 60)} {item} {words(r, 60)}"
    texts[50], texts[51] = "too short", None
    rows = [(k, t, "en", "web", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {*texts} - {50, 51}
    for name, stage in p.STAGES[:-1]:
        docs = p.stored(stage(spark, docs, str(tmp_path)), name)
        kept -= {"ngram_jaccard_join": {20, 21}, "decontamination": {40}}.get(name, set())
        got = {x.doc_id: x for x in docs.collect()}
        assert docs.columns == columns and set(got) == kept, name
    for k, x in got.items():
        want = texts[k] if k != 31 else texts[k].replace(f" {passage} ", "")
        assert x.text == want and x.n_chars == len(want)
    ref = tokenizers.Tokenizer.from_file(tokenizer_file())
    out = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == kept
    for x in out:
        ids = np.array(ref.encode(got[x.doc_id].text, add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(x.ids) == ids and x.ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_stages_are_in_order():
    assert [n for n, _ in p.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "decontamination", "bpe"] and p.ORACLE_SQL is None


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    r = random.Random(9)
    one, two = words(r, 90), words(r, 90)
    rows = [(1, one, "a", 1, "x"), (2, two, None, 2, None), (2, two, None, 2, None), (None, words(r, 95), "b", 3, "y"), (3, None, "c", 4, "z"), (4, "", None, None, None), (5, "é漢 " * 90, "d", 5, "w")]
    kind = "doc_id long, text string, source string, kept long, ids string"
    spark.createDataFrame([(1, words(r, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (None, 0), (9, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, kind)
    for name, stage in p.STAGES:
        got = [tuple(x) for x in stage(spark, p.stored(df, "in"), str(tmp_path)).collect()]
        assert stage(spark, p.stored(df.limit(0), "none"), str(tmp_path)).collect() == [], name
        ids = sorted((x[0] for x in got), key=str)
        if name == "bpe":
            assert ids == sorted((x[0] for x in rows), key=str)
        elif name == "ngram_jaccard_join":  # of repeated rows one stays
            assert sorted(got, key=str) == sorted({*rows}, key=str)
        elif name == "quality_rules":
            assert {*got} <= {*rows} and not {3, 4} & {*ids} and ids.count(2) in (0, 2)
        elif name == "suffix_array_dedup":  # the text that repeats itself loses its repeats, nothing else changes
            assert sorted((x for x in got if x[0] != 5), key=str) == sorted((x for x in rows if x[0] != 5), key=str)
        else:
            assert sorted(got, key=str) == sorted(rows, key=str), name
