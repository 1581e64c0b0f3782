"""The persistent index, publishing, and retrieval for many profiles, against plain Python."""

import re
import threading
import warnings

import pytest
from pyspark.sql import functions as F

from marlspar.functions import infer, text, vocab
from marlspar.operators import evidence, retrieval
from marlspar.sources import index, store

ONE = lambda: F.array(F.struct(F.col("text").alias("text"), F.lit(1.0).alias("weight")))


def documents(spark, n=400):
    words = ["lightgbm", "catboost", "segmentation", "kfold", "patient", "spectrogram", "tokens", "forecast", "leakage", "stacking"]
    rows = [(k, " ".join(words[(k * 7 + j * j) % 10] for j in range(k % 12)) + f" common w{k % 50}") for k in range(n)]
    return spark.createDataFrame([*rows, (None, "no id"), (n, None), (n + 1, "")], "id long, text string")


def queries(spark):
    rows = [("a", "patient kfold"), ("b", "common"), ("c", "w7 w7 lightgbm common"), ("d", "nothingatall")]
    return retrieval.query_tokens(spark.createDataFrame(rows, "q string, text string"), "q", F.col("text"))


def plain(df):
    return sorted((r["query"], r["entry"], round(r["score"], 8), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("top", [1, 5, 1000])
def test_index_answers_as_the_scan(spark, tmp_path, top, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    rows = documents(spark)
    found = index.load_or_build(rows, "id", ONE(), f"file://{tmp_path}/index")
    assert isinstance(found, index.Index)
    want = retrieval.bm25_scan(retrieval.tokenised(rows.where("id is not null"), "id", ONE()), queries(spark), top)
    assert plain(found.rank(queries(spark), top)) == plain(want)
    ids = spark.createDataFrame([(3,), (3,), (77,), (99999,)], "entry long")
    assert sorted((r.id, r.text) for r in found.entries(ids).collect()) == sorted((r.id, r.text) for r in rows.where("id in (3, 77)").collect())


def test_index_is_found_again_and_pruned(spark, tmp_path, monkeypatch):
    rows, root = documents(spark, 60), f"file://{tmp_path}/index"
    first = index.load_or_build(rows, "id", ONE(), root)
    monkeypatch.setattr(index, "build", lambda *_: pytest.fail("built again"))
    again = index.load_or_build(rows.repartition(5), "id", ONE(), root)  # the order of rows does not matter
    assert again.folder == first.folder
    plan = again.rank(queries(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (" in plan
    monkeypatch.undo()
    other = index.load_or_build(rows.where("id < 30"), "id", ONE(), root)
    assert other.folder != first.folder
    newer = index.load_or_build(rows, "id", ONE(), root, refresh=True)
    assert newer.folder not in (first.folder, other.folder)
    index.prune(spark, root, index.fingerprint(rows))
    assert index.opened(spark, root, index.fingerprint(rows.where("id < 30"))) is None
    assert plain(index.opened(spark, root, index.fingerprint(rows)).rank(queries(spark), 3)) == plain(newer.rank(queries(spark), 3))


def test_index_of_nothing_and_where_nothing_can_be_written(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    assert index.load_or_build(empty, "id", ONE(), f"file://{tmp_path}/index").rank(queries(spark), 3).count() == 0
    (tmp_path / "file").write_text("x")
    rows = documents(spark, 40)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        scan = index.load_or_build(rows, "id", ONE(), f"file://{tmp_path}/file/index")
    assert isinstance(scan, index.Scan) and any("scanned" in str(w.message) for w in said)
    assert scan.entry_count == rows.count() and scan.rank(queries(spark), 2).count() > 0


def test_put_if_absent_has_one_winner(spark, tmp_path):
    uri, won = f"file://{tmp_path}/one/object", []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store.put_if_absent(spark, uri, b"x" * 1000 + bytes([k])) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.get(spark, uri) == b"x" * 1000 + bytes(won)
    assert store.get(spark, f"file://{tmp_path}/one/none") is None and store.names(spark, f"file://{tmp_path}/one") == ["object"]


def entry(k, **more):
    base = {"id": k, "title": f"case {k}", "competition_slug": f"comp-{k}", "source": "book", "source_type": "writeup", "summary": "", "anchor": f"a{k}", "core_keywords": [f"key{k}"], "algo_tags": [], "trick_highlights": []}
    return base | more


def catalog(spark):
    image = "segmentation masks of dicom images by patient, group kfold"
    rows = [entry(k, summary=image if k % 2 else "lightgbm on csv table, stacking") for k in range(30)]
    rows += [entry(100, title="case 1", competition_slug="comp-1", summary=image + " again", anchor="b"), entry(101, competition_slug="patients", summary="plain")]  # one shares the identity of 1
    rows += [entry(102, summary="forecast with lag features, group kfold by patient", trick_highlights=[f"trick {j}" for j in range(14)], source_url="https://example.org/x", code_evidence_count=3, code_evidence_status="cited")]
    kind = "id long, title string, competition_slug string, source string, source_type string, summary string, anchor string, core_keywords array<string>, algo_tags array<string>, trick_highlights array<string>, source_url string, code_evidence_count int, code_evidence_status string"
    names = [c.split(" ")[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind)


def test_evidence_for_many_profiles(spark, tmp_path):
    shaped = evidence.shaped(catalog(spark))
    found = index.load_or_build(shaped, "id", retrieval.entry_fields(), f"file://{tmp_path}/index")
    kind = "profile string, slug string, description string, domains array<string>, validation_risks array<string>, mechanisms array<string>, stage string, extra int"
    profiles = [("p", "patients", "segmentation of dicom by patient", ["cv_vision"], ["group_leakage"], ["group_aware_validation"], "intake", 1), ("t", None, "lightgbm table", ["tabular"], None, None, None, 2), ("none", None, "", None, None, None, None, 3)]
    got = evidence.retrieve(found, spark.createDataFrame(profiles, kind), recall=40, limit=5)
    cand = {p: {} for p, *_ in profiles}
    for r in got.candidates.collect():
        assert r.identity not in cand[r.profile]
        cand[r.profile][r.identity] = r
    assert len([1 for r in cand["p"].values() if r.entry in (1, 100)]) == 1
    results = got.results.collect()
    tokens = {r.id: {*r._diverse} for r in shaped.collect()}
    slugs = {r.id: r.competition_slug for r in shaped.collect()}
    for p in cand:
        own = {r.entry: r for r in results if r.profile == p and r.kind == "result"}
        pool = sorted(cand[p].values(), key=lambda r: (-r.final, r.entry))
        best, chosen, used = pool[0].final, [], {}
        while pool and len(chosen) < 5:  # the greedy choice in plain Python
            def value(r):
                near = max((len(tokens[r.entry] & tokens[o]) / len(tokens[r.entry] | tokens[o]) for o in chosen), default=0)
                return 0.78 * r.final / best + 0.22 * (1 - near) + vocab.LEVEL_BONUS[r.level] - 0.13 * used.get(slugs[r.entry], 0)

            pick = max(pool, key=value)
            pool.remove(pick)
            chosen.append(pick.entry)
            used[slugs[pick.entry]] = used.get(slugs[pick.entry], 0) + 1
        assert [e for _, e in sorted((r.position, e) for e, r in own.items())] == chosen
        left = [r.entry for r in pool if any(x.startswith("cross-domain-mechanism") for x in r.reasons)]
        assert [r.entry for r in sorted((r for r in results if r.profile == p and r.kind == "bridge"), key=lambda r: r.position)] == left[:3]
    assert [r.entry for r in cand["p"].values() if r.level == "exact"] == [101]
    assert {(r.trust_level, r.provenance_status) for r in results} == {("untrusted_external", "unknown")}
    wide = [r for r in results if r.entry == 102]
    assert all(len(r.trick_highlights) == 10 for r in wide)
    cover = {r.profile: r for r in got.coverage.collect()}
    assert {*cover} == {"p", "t", "none"} and cover["none"].direct_or_near == 0 and cover["none"].confidence == "low"
    for p in cand:
        own = [r for r in results if r.profile == p and r.kind == "result"]
        assert cover[p].direct_or_near == sum(r.level in ("exact", "direct", "near") for r in own) and cover[p].unique_competitions == len({r.competition_slug for r in own})


def test_intent_is_taken_or_inferred(spark):
    rows = [("a", "show me the code implementation", None), ("b", "show me the code implementation", "strategy"), ("c", "words", None)]
    got = {r.profile: r.intent for r in evidence.prepared(spark.createDataFrame(rows, "profile string, description string, intent string")).collect()}
    assert got["b"] == "strategy" and got["a"] == "code" and got["c"] is None


def test_search_hands_on_the_best_of_each_query_only(spark, tmp_path):
    # before, every pair of a query's token and an entry was a shuffled row
    docs = spark.range(3000).select("id", F.concat(F.lit("alpha beta gamma w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("text"))
    one = F.array(F.struct(F.col("text").alias("text"), F.lit(1.0).alias("weight")))
    found = index.load_or_build(docs, "id", one, f"file://{tmp_path}/index")
    asked = spark.range(40).select(F.col("id").alias("query"), F.concat(F.lit("alpha beta w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("text"))
    tokens = retrieval.query_tokens(asked, "query", F.col("text"))
    got = [(r.query, r["rank"], r.entry, round(r.score, 6)) for r in found.rank(tokens, 5).orderBy("query", "rank").collect()]
    want = retrieval.bm25(retrieval.postings(docs, "id", one), tokens, 5).orderBy("query", "rank").collect()
    assert got == [(r.query, r["rank"], r.entry, round(r.score, 6)) for r in want] and len(got) == 200
    assert "explode" not in found.rank(tokens, 5)._jdf.queryExecution().toString().lower()


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_build_shuffles_texts_but_no_postings(spark, tmp_path):
    docs = spark.range(3000).select("id", F.concat(F.lit("alpha beta gamma delta w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("text"))
    before = shuffled(spark)
    assert index.build(docs, "id", ONE(), f"file://{tmp_path}/index")["entry_count"] == 3000
    assert 0 < shuffled(spark) - before < 3000 * 6


def test_rows_of_one_entry_are_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma delta"), (2, "beta"), (3, "")], "id long, text string")
    one = spark.createDataFrame([(1, "alpha beta alpha gamma delta"), (2, "beta"), (3, "")], "id long, text string")
    asked = retrieval.query_tokens(spark.createDataFrame([("q", "alpha beta delta")], "q string, text string"), "q", F.col("text"))
    found = index.load_or_build(rows, "id", ONE(), f"file://{tmp_path}/index")
    assert found.entry_count == 2
    assert plain(found.rank(asked, 5)) == plain(retrieval.bm25(retrieval.postings(one, "id", ONE()), asked, 5))


def test_phrases_are_not_held_against_all_words(spark):
    rows = spark.createDataFrame([(["group", "kfold", "patient", "id"],), ([],)], "ws array<string>")
    both = rows.select(text.names_held(F.col("ws"), vocab.RISKS).alias("r"), infer.entry_domain_scores(F.col("ws"), F.array().cast("array<string>")).alias("d"))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"array_except\([^()]*(?:\([^()]*\))?[^()]*ws#", plan), plan
    want = [[n for n, ps in vocab.RISKS.items() if any((t := {*text.tokens_py(p)}) and t <= {*r.ws} for p in ps)] for r in rows.collect()]
    assert [r.r for r in both.collect()] == want and any(want)


def test_candidates_alone_choose_no_results(spark, tmp_path, monkeypatch):
    found = index.load_or_build(evidence.shaped(catalog(spark)), "id", retrieval.entry_fields(), f"file://{tmp_path}/index")
    monkeypatch.setattr(retrieval, "diversify", lambda *_: pytest.fail("chosen"))
    profiles = spark.createDataFrame([("p", "segmentation of dicom by patient", "macro f1")], "profile string, description string, metric string")
    assert evidence.retrieve(found, profiles, recall=10, limit=3).candidates.count() > 0
