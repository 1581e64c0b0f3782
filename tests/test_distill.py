"""Cards from a small ledger: lessons, gate, integrity, text, promotion by commits, catalog kept by changes."""

import glob

import pytest
from pyspark.sql import functions as F

from marlspar.operators import distill
from marlspar.sources import library
from marlspar.sources.commits import Ledger, RefusedActions

SPACES = "workspace string, slug string, title string, url string, metric string, direction string, created_at string, best string, revision int, domains array<string>, mechanisms array<string>, metric_family string, risks array<string>, runtime_constraints array<string>, summary string, card_type string, repository string, license string"
RUNS = "workspace string, place int, id string, parent string, component string, status string, hypothesis string, change string, diagnosis string, notes string, cv double, cv_std double, ablation string, research_ids array<string>, artifact string, analysis_status string, code_version string, data_version string, fold_version string, metric_version string, seeds string"
ANALYSES = "workspace string, experiment string, version int, verdict string, mechanism string, confounders array<string>, fold_count int, fold_wins int, effect string, slice_findings string, resource_tradeoff string"
ABLATIONS = "workspace string, id string, factor string, control string, treatment string, fixed_conditions array<string>"
RESEARCH = "workspace string, place int, id string, status string, transfer_conditions string, failure_conditions string, urls array<string>"
CODE = "workspace string, experiment string, ord int, path string, start_line int, end_line int, language string, symbol string, excerpt string, content_sha256 string, source_sha256 string"


def sha(x):
    import hashlib

    return hashlib.sha256(x.encode()).hexdigest()


def run(k, parent, component, status="success", change="use focal loss", done="complete", ablation=None, research=(), ws="w", diagnosis=None):
    return (ws, k, f"E{k}", parent, component, status, "it helps", change, diagnosis, None, 0.5 + k / 10, 0.01, ablation, [*research], f"out\\run{k}.bin", done, "abcdef0", "d1", "f1", "m1", "[1, 2]")


@pytest.fixture
def build(spark):
    def make(runs=None, analyses=None, code=(), slug="toy", metric="auc", card_type=None, repository=None, licence="MIT", research=None):
        t = spark.createDataFrame
        runs = [run(1, None, "validation"), run(2, "E1", "model", ablation="A1", research=["R1"]), run(3, "E2", "model", "failed", diagnosis="out of memory")] if runs is None else runs
        analyses = [("w", "E2", 1, "inconclusive", "?", [], 1, 1, None, None, None), ("w", "E2", 2, "supported", "hard rows weigh more", ["seed"], 5, 4, '{"fold_count": 5}', "", "none")] if analyses is None else analyses
        research = [("w", 1, "R1", "verified", "rare classes", "label noise", ["https://example.com/a?x=1"])] if research is None else research
        runs, research = t(runs, RUNS), t(research, RESEARCH)
        made = distill.build(
            t([("w", slug, None, None, metric, None, "2024", "E2" if runs.count() else None, None, ["vision"], None, None, ["leak", "leak"], None, None, card_type, repository, licence)], SPACES), runs, t(analyses, ANALYSES),
            t([("w", "A1", "loss", "plain", "focal", ["same folds", None])], ABLATIONS), research, t([*code], CODE),
        )
        return made, runs, research

    return make


def rules(df):
    return sorted((r.level, r.rule, r["item"]) for r in df.collect())


def piece(k=1, path="src/a.py", excerpt="x = 1", digest=None, ord=1, end=3):
    return ("w", f"E{k}", ord, path, 1, end, "python", "f", excerpt, digest or sha(excerpt), sha("file"))


def test_lessons(build):
    made, _, _ = build()
    rows = {r.lesson_id: r for r in made.lessons.collect()}
    assert set(rows) == {"L001", "N001"}
    good, bad = rows["L001"], rows["N001"]
    assert (good.title, good.confidence, good.transfer_conditions, good.failure_conditions) == ("loss: it helps", "high", ["same folds", "rare classes"], ["seed", "label noise"])
    assert (good.source_urls, good.artifact_ref, good.control) == (["https://example.com/a"], "run2.bin", "plain")
    assert (bad.verdict, bad.confidence, bad.mechanism, bad.failure_conditions) == ("failed", "high", "out of memory", ["out of memory"])
    head = made.heads.first()
    assert head.card_id == f"toy-postmortem-{sha('toy|2024')[:8]}" and head.risks == ["leak", "leak"] and head.keywords[:3] == ["vision", "leak", "loss"]
    assert [r.id for r in made.chain.orderBy(F.desc("depth")).collect()] == ["E1", "E2"]


def test_gate_passes(build):
    made, runs, research = build(code=[piece(2), piece(3), piece(2, "src\\a.py", ord=2)])
    assert [(r.evidence_id, r.lesson_id) for r in made.evidence.collect()] == [("CE001", "L001")]
    found = distill.problems(made, runs, research)
    assert rules(found) == []
    assert distill.reviews(made.heads, found).first().asDict() == {"workspace": "w", "status": "pass", "score": 100, "blockers": 0, "warnings": 0}


def test_gate_names_every_problem(build):
    runs = [run(1, None, "model", done="pending"), run(2, None, "model", done="pending"), run(3, None, "model", change="/home/me/x.py")]
    analyses = [("w", "E3", 1, "partially_supported", "", [], 2, 2, None, None, None)]
    code = [piece(3, "/etc/x"), piece(3, "a/../b", "y"), piece(3, "c", " "), piece(3, "d", "z", "0" * 64), piece(3, "e", end=0)]
    made, runs, research = build(runs, analyses, code, "", None, "external_source_competition", "ftp://x", "Unknown", [("w", 1, "R1", "pending", None, None, [])])
    got = rules(distill.problems(made, runs, research))
    assert got == sorted(
        [("blocker", r, i) for r, i in [("slug", ""), ("metric", ""), ("analysis", "E1"), ("analysis", "E2"), ("lesson", "L001"), ("sensitive", ""), ("evidence_path", "CE001"), ("evidence_path", "CE002"), ("evidence_excerpt", "CE003"), ("evidence_content", "CE004"), ("evidence_bounds", "CE005"), ("provenance_repository", ""), ("provenance_license", "")]]
        + [("warning", r, i) for r, i in [("transfer", "L001"), ("failure", "L001"), ("research", ""), ("sources", "")]]
    )
    review = distill.reviews(made.heads, distill.problems(made, runs, research)).first()
    # both waiting runs are one blocker
    assert (review.status, review.score, review.blockers, review.warnings) == ("fail", 0, 12, 4)


def test_empty_ledger_is_blocked(build):
    made, runs, research = build([], [], (), research=[])
    assert ("blocker", "lessons", "") in rules(distill.problems(made, runs, research))
    assert distill.digests(made).count() == 1


def test_numbers_go_on_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(distill, "BLOCK", 3)
    df = spark.createDataFrame([("k", p, o) for p in (0, 2, 3, 3, 9, 20) for o in (2, 1)], "k string, p int, o int")
    got = [(r.p, r.o, r.number) for r in distill.numbered(df, ["k"], "p", ["o"]).orderBy("number").collect()]
    assert [n for _, _, n in got] == [*range(1, 13)] and [x[:2] for x in got] == sorted(x[:2] for x in got)


def test_text_and_integrity(build, tmp_path):
    made, runs, research = build(code=[piece(2)])
    review = distill.reviews(made.heads, distill.problems(made, runs, research))
    lines = distill.markdown(made, review, made.heads.select("workspace", F.lit("reviewed").alias("status")))
    distill.write_markdown(made, lines, str(tmp_path / "md"))
    card = made.heads.first().card_id
    got = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/md/card_id={card}/*.txt")))
    assert got.startswith(f"## 1. toy {{#experience-{card}}}\n\n> Competition: `toy` | Metric: `auc` | Status: `reviewed`\n\n### Summary\n")
    for part in ['- Domains: ["vision"]\n- Mechanisms: not recorded\n', "#### L001 loss: it helps\n- Verdict / confidence: `supported` / `high`\n", '- Effect: {"fold_count": 5}\n- Slice findings: not recorded\n- Transfer conditions: ["same folds", "rare classes"]\n', "### Negative And Inconclusive Lessons\n#### N001", "#### CE001 `src/a.py:1-3`\n- Lessons: L001\n- Symbol: `f`\n````python\nx = 1\n````\n", "|---|---|---|---:|---:|---|\n| E1 | validation |", "- Status: `pass`\n- Score: `100`\n"]:
        assert part in got
    stored = made.heads.join(distill.digests(made), "workspace").select("workspace", "card_id", "card_hash", F.lit("promoted").alias("status"), F.lit("reviewed").alias("review_status"), F.lit(0).alias("blockers"), F.lit(True).alias("anchored"))
    assert rules(distill.integrity(made, stored, promoted=True)) == []
    worse = stored.withColumn("card_hash", F.lit("0")).withColumn("status", F.lit("draft")).withColumn("card_id", F.lit("other")).withColumn("anchored", F.lit(None).cast("boolean"))
    assert [r[1] for r in rules(distill.integrity(made, worse, promoted=True))] == ["anchor", "hash", "name", "promoted"]


def test_a_change_changes_the_digest(build):
    one, two = (distill.digests(build(code=[piece(2, excerpt=x)])[0]).first().card_hash for x in ("x = 1", "x = 2"))
    assert one != two and one == distill.digests(build(code=[piece(2)])[0]).first().card_hash


def test_promotion_follows_review(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    act = lambda kind, **k: {"workspace": "w", "run_id": "r", "kind": kind} | k
    led.commit(act("begin"), act("draft", id="c", payload="h1"))
    with pytest.raises(RefusedActions, match="not passed review"):
        led.commit(act("promote", id="c", status="pass", payload="h1"))
    led.commit(act("review", id="c", status="pass", payload="h2"))
    with pytest.raises(RefusedActions, match="changed after review"):
        led.commit(act("promote", id="c", status="pass", payload="h3"))
    with pytest.raises(RefusedActions, match="unknown card"):
        led.commit(act("review", id="d", status="pass", payload="h2"))
    led.commit(act("promote", id="c", status="pass", payload="h2"))
    state = led.state()
    assert [tuple(r) for r in state.cards.collect()] == [("w", "r", "c", "promoted", 1, "h2")] and state.workspaces.first().stage == "complete"


def test_catalog_by_changes_equals_a_rebuild(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path / "lib"))
    schema = "card_id string, card_hash string, source_url string, quality_score int"
    steps = [[("a", "1", "u", 5), ("b", "1", None, 6)], [("a", "1", "u", 5), ("b", "2", "v", 7), ("c", "1", "u", 1)], [("c", "1", "u", 1)], [], [("a", "9", "", 2)]]
    made = []
    for k, rows in enumerate(steps):
        now = spark.createDataFrame(rows, schema)

        def roll(changed, rows=rows):
            ids = {r.card_id for r in changed.collect()}
            made.append(ids)
            return spark.createDataFrame([r for r in rows if r[0] in ids], schema)

        stats = lib.refresh(now.select("card_id", "card_hash"), roll)
        assert sorted(tuple(r) for r in lib.entries().select("card_id", "card_hash", "source_url", "quality_score").collect()) == sorted(rows)
        linked = sum(bool(r[2]) for r in rows)
        assert stats == lib.stats() and (stats["entries"], stats["linked"], stats["quality"]) == (len(rows), linked, sum(r[3] for r in rows))
        assert k == 0 or lib.refresh(now.select("card_id", "card_hash"), roll) == stats
    assert [m for m in made if m] == [{"a", "b"}, {"b", "c"}, {"a"}]


def test_evidence_is_scanned_once_and_faults_are_rows(build):
    made, runs, research = build(code=[piece(2, "/etc/x"), piece(2, "src/b.py", "see /home/me/secret/x"), piece(2, "src/c.py", "fine")])
    assert [(r["item"], len(r.marks), r.sensitive) for r in made.faults.orderBy("item").collect()] == [("CE001", 1, False), ("CE002", 0, True)]
    assert {("blocker", "sensitive", ""), ("blocker", "evidence_path", "CE001")} <= {*rules(distill.problems(made, runs, research))}


def written(monkeypatch):
    from marlspar.sources import store

    labels, kept = [], store.kept
    monkeypatch.setattr(store, "kept", lambda df, label: labels.append((label, {*df.columns})) or kept(df, label))
    return labels


def test_a_part_is_made_when_it_is_asked_for(build, monkeypatch):
    labels = written(monkeypatch)
    made, _, _ = build(code=[piece(2)])
    assert labels == [] and made.lessons.count() == 2 and made.lessons.count() == 2
    assert [x for x, _ in labels] == ["card-lessons"]


def test_evidence_is_numbered_without_its_texts(build, monkeypatch):
    labels = written(monkeypatch)
    # rows that are equal in all columns, and one with null lines
    made, _, _ = build(code=[piece(2), piece(2), piece(3, "src/b.py", "y = 2"), ("w", "E2", 3, "src/n.py", None, None, None, None, None, None, None)])
    assert [(r.evidence_id, r.experiment) for r in made.cited.orderBy("number").collect()] == [("CE001", "E2"), ("CE002", "E2"), ("CE003", "E3")]
    assert [x for x, _ in labels] == ["card-numbers", "card-evidence"] and not any({"excerpt", "implementation"} & columns for _, columns in labels)
    assert [(r.evidence_id, r.excerpt) for r in made.evidence.orderBy("number").collect()] == [("CE001", "x = 1"), ("CE002", None), ("CE003", "y = 2")]


def test_keywords_are_the_first_words_of_all_lessons(build, monkeypatch):
    monkeypatch.setattr(distill, "EARLY", 3)
    monkeypatch.setattr(distill, "KEYWORDS", 12)
    for wide in (0, 2, 6):  # the lesson that alone fills the list: none, an early one, a late one
        runs = [run(k, None, "model", "failed", " ".join(f"w{k}x{n} w1x{n}" for n in range(30 if k == wide else 2))) for k in range(1, 9)]
        made, _, _ = build(runs, [], ())
        want = {"vision": 0, "leak": 0}
        for r in made.lessons.orderBy("number").collect():
            want |= dict.fromkeys(f"{r.title} {r.mechanism} {r.implementation}".lower().split(), 0)
        stop = {w for w in want if w in distill.text.vocab.STOPWORDS or len(w) < 2}
        assert made.heads.first().keywords == [w for w in want if w not in stop][:12]
