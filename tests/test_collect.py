"""Listing, classification and code evidence over a folder, against plain Python."""

import ast
import hashlib

import pytest
from pyspark.sql import functions as F

from marlspar.functions import vocab
from marlspar.operators import cards, collect
from marlspar.sources import files, listing

FILES = {
    "README.md": b"# Winner\nWe used folds.", "src/train_model.py": b"import os\n\n\nclass Trainer:\n    def fit(self):\n        return 1\n\n\ndef predict_scores(x):\n    return x\n", "src/copy.py": b"# Winner\nWe used folds.",
    "src/deep/er/agent.rs": b"// top\npub fn step_policy(a: u8) -> u8 {\n  a\n}\nstruct S;\n", "src/broken.py": b"def f(:\n  model = 1\nx\n", "src/empty.py": b"", "conf/settings.yaml": b"a: 1",
    "node_modules/x/index.js": b"function a() {}", "src/Build/out.py": b"x = 1", ".git/config.json": b"{}", "src/.hidden.py": b"x = 2", "src/.cache/y.py": b"x = 3", "own/skip.py": b"x = 4",
    "data/blob.md": b"a\x00b", "data/latin.md": b"\xe9\xe8" * 50, "data/some.md": ("é" * 200).encode() + b"\xff", "data/model.pt": b"text", "data/notes": b"no suffix", "data/big.md": b"z" * 3000, "data/solution": b"plain text",
    "tests/test_fold.py": b"def test_fold():\n    assert 1\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, raw in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    return tmp_path


def test_listing_prunes_and_skips(spark, folder):
    df = listing.source_files(spark, str(folder), most=2000, excluded=["OWN"])
    got = {r.path: bytes(r.content) for r in df.collect()}
    gone = {"node_modules/x/index.js", "src/Build/out.py", ".git/config.json", "src/.hidden.py", "src/.cache/y.py", "own/skip.py", "data/model.pt", "data/big.md"}
    assert got == {k: v for k, v in FILES.items() if k not in gone}
    assert df.rdd.getNumPartitions() == 5  # the root's files, conf, data, src, tests
    reader = listing._Reader(str(folder), 2000, {"own", *vocab.SKIPPED_FOLDERS})
    assert [p.folder for p in reader.partitions()] == ["", "conf", "data", "src", "tests"]


def test_sources_are_classified_scored_and_distinct(spark, folder):
    rows = {r.path: r for r in collect.sources(listing.source_files(spark, str(folder), most=2000, excluded=["own"])).collect()}
    assert {*rows} == {"README.md", "src/train_model.py", "src/deep/er/agent.rs", "src/broken.py", "src/empty.py", "conf/settings.yaml", "data/some.md", "data/solution", "tests/test_fold.py"}
    assert {k: (rows[k].kind, rows[k].language) for k in ("README.md", "src/deep/er/agent.rs", "conf/settings.yaml", "data/solution")} == {
        "README.md": ("writeup", "text"), "src/deep/er/agent.rs": ("code", "rust"), "conf/settings.yaml": ("config", "yaml"), "data/solution": ("writeup", "text"),
    }
    size = lambda n: min(10, (n.bit_length() - 1) // 2)
    assert rows["README.md"].score == 70 + 45 + size(23) and rows["src/train_model.py"].score == 45 + 12 + size(len(FILES["src/train_model.py"]))
    assert rows["tests/test_fold.py"].score == 45 + 6 - 18 + size(len(FILES["tests/test_fold.py"])) and rows["data/solution"].score == 70 + 12 + size(10)
    for r in rows.values():
        assert r.sha256 == hashlib.sha256(FILES[r.path]).hexdigest()
    chosen = cards.quotas(spark.createDataFrame([(r.path, r.kind, r.score) for r in rows.values()], "path string, kind string, score int"), 8).collect()
    assert len(chosen) == 8 and sum(r.kind == "config" for r in chosen) == 1


def test_text_by_its_first_bytes(spark):
    rows = [b"", b"plain", b"a\x00", b"\xff" * 10, ("é" * 100).encode() + b"\xff", b"a" * 8192 + b"\x00", None]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, c binary").orderBy("k").select(files.is_text(F.col("c"))).collect()]

    def plain(raw):
        shown = raw[:8192].decode("utf-8", "replace")
        return b"\0" not in raw[:8192] and shown.count("\ufffd") / max(len(shown), 1) < 0.02

    assert got[:-1] == [plain(x) for x in rows[:-1]]


def evidence_of(spark, rows, limit=10):
    df = spark.createDataFrame([(p, lang, 45, "s", body, 1) for p, lang, body in rows], "path string, language string, score int, sha256 string, body string, points int")
    return collect.evidence(df.repartition(2), limit).orderBy("id").collect()


def test_python_spans_equal_a_tree_walk(spark):
    bodies = ["def a():\n  def model_fit():\n    pass\n  class B:\n    async def step(self):\n      pass\n", "x = 1", "def f(:", None, open(collect.__file__).read(), "if 1:\n" + "".join(" " * k + f"def f{k}():\n" for k in range(1, 60)) + " " * 60 + "pass"]  # noqa: SIM115
    got = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", collect.python_spans(F.col("b")).alias("s")).orderBy("k").collect()
    for r, b in zip(got, bodies, strict=True):
        try:
            tree = [n for n in ast.walk(ast.parse(b or "")) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        except SyntaxError:
            tree = []
        want = sorted((n.lineno, n.end_lineno, n.name, (4 if isinstance(n, ast.ClassDef) else 8) + 5 * sum(h in n.name.lower() for h in vocab.SYMBOL_HINTS)) for n in tree)
        assert [tuple(x) for x in r.s] == want


def test_evidence_takes_the_best_distinct_symbols(spark):
    long = "def train_model():\n" + "    x = 1\n" * 80
    rows = [
        ("a.py", "python", FILES["src/train_model.py"].decode()), ("b.rs", "rust", FILES["src/deep/er/agent.rs"].decode()), ("broken.py", "python", "def f(:\n  model = 1\nx\n"), ("e.py", "python", ""), ("n.py", "python", None),
        ("z.py", "python", long), ("y.py", "python", long), ("s.sql", "sql", "select 1\nfrom loss\n"), ("c.cpp", "cpp", "int main_loop(int a) {\n}\nclass Reward {};\n"), ("k.py", "python", "def k():\n    return 'sk-abcdefghijklmnop1234'\n"),
    ]
    got = {r.path: r for r in evidence_of(spark, rows)}
    assert {*got} == {"a.py", "b.rs", "broken.py", "z.py", "s.sql", "c.cpp", "k.py"}  # of equal symbols and excerpts the last path
    assert (got["a.py"].symbol, got["a.py"].start_line, got["a.py"].end_line) == ("predict_scores", 9, 10)
    assert (got["b.rs"].symbol, got["b.rs"].start_line, got["b.rs"].end_line) == ("step_policy", 2, 5)
    assert (got["z.py"].symbol, got["z.py"].start_line, got["z.py"].end_line) == ("train_model", 1, 40)
    assert (got["broken.py"].symbol, got["broken.py"].start_line) == ("relevant_block", 2) and got["s.sql"].start_line == 2 and got["c.cpp"].symbol == "Reward"
    assert "sk-" not in got["k.py"].excerpt
    for r in got.values():
        assert r.content_sha256 == hashlib.sha256(r.excerpt.encode()).hexdigest()
    assert [r.id for r in evidence_of(spark, rows)] == [f"CE{k:03d}" for k in range(1, 8)]
    assert [r.path for r in evidence_of(spark, rows, 2)] == [r.path for r in evidence_of(spark, rows)][:2]
    assert evidence_of(spark, rows[3:5]) == []


def test_a_text_is_redacted_once(spark):
    from unittest import mock

    df = spark.createDataFrame([("a.rs", "rust", 45, "s", "fn x() {}")], "path string, language string, score int, sha256 string, body string")
    with mock.patch.object(vocab, "REDACT_LINES", [("only_once", "")]):
        plan = collect.evidence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only_once") == 1, plan


def test_a_file_is_searched_to_its_end(spark):
    body = "// nothing\n" * 30_000 + "fn train_model() {\n}\n"
    (got,) = evidence_of(spark, [("long.rs", "rust", body)])
    assert (got.symbol, got.start_line, got.end_line) == ("train_model", 30_001, 30_002)
    assert got.content_sha256 == hashlib.sha256(b"fn train_model() {\n}").hexdigest()
