"""Sources of a collection and the code evidence in them.

`sources` classifies, scores and deduplicates files; `evidence` takes of every code file the span of its most telling
symbol as a hashed excerpt, then distinct symbols by score.

Cases: files that are not text, have no kind, or repeat the content of an earlier path are no sources; a code file without
symbols gives the lines from the first that names a hint, else from the top; one that cannot be parsed likewise; an empty file
gives no evidence; equal scores go by path, in sources ascending, in evidence descending.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import governance, vocab
from ..sources import files as formats
from . import briefing, cards, planning

SPANS = "array<struct<start: int, end: int, name: string, score: int>>"
#: Lines of an excerpt after its first, of a span without an end, of a block without a symbol.
EXCERPT, SPAN, BLOCK = 39, 35, 29
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def sources(files: DataFrame) -> DataFrame:
    """(path, kind, language, size, score, sha256, content) of files (path, size, content), each content once under its first path."""
    is_text = formats.is_text(F.col("content"))
    own = files.where(is_text).withColumn("kind", planning.file_kind(F.element_at(F.split("path", "/"), -1), F.lit(True))).where("kind <> 'other'")
    own = own.withColumn("sha256", F.sha2("content", 256))
    first = own.groupBy("sha256").agg(F.min("path").alias("path"))  # joined by both: many copies are many keys
    score = cards.file_score(F.col("path"), F.col("kind"), F.col("size"), vocab.WRITEUP_HINTS, vocab.ROLE_HINTS)
    name = F.element_at(F.split("path", "/"), -1)
    return own.join(first, ["sha256", "path"], "left_semi").select("path", "kind", briefing.language(name).alias("language"), "size", score.alias("score"), "sha256", "content")


def symbol_score(name: Column, kind: str = "function") -> Column:
    low = F.lower(name)
    return sum((F.when(F.contains(low, F.lit(h)), 5).otherwise(0) for h in vocab.SYMBOL_HINTS), F.lit(8 if kind in ("function", "method") else 4))


def generic_spans(lines: Column, language: Column) -> Column:
    """Spans that begin where a line of the language declares something."""
    def found(pattern: str, two: bool) -> Column:
        names = F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1))  # once a line
        if two:
            names = F.zip_with(lines, names, lambda x, n: F.when(n != "", n).otherwise(F.regexp_extract(x, pattern, 2)))
        spans = F.transform(names, lambda n, i: F.struct((i + 1).alias("start"), (i + 1 + SPAN).alias("end"), n.alias("name")))
        return F.filter(spans, lambda s: s["name"] != "")

    out = None
    for name, pattern in vocab.SYMBOL_PATTERNS.items():
        out = (F if out is None else out).when(language == name, found(pattern, name == "cpp"))
    scored = F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["name"].alias("name"), symbol_score(s["name"]).alias("score")))
    return F.coalesce(scored, F.array().cast(SPANS)).cast(SPANS)


def _tree_spans(body: str | None) -> list[tuple]:
    try:
        tree = ast.parse(body or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, todo = [], [tree]
    while todo:  # an explicit stack: nesting of any depth
        node = todo.pop()
        todo += ast.iter_child_nodes(node)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            base = 4 if isinstance(node, ast.ClassDef) else 8
            out.append((node.lineno, node.end_lineno or node.lineno, node.name, base + 5 * sum(h in node.name.lower() for h in vocab.SYMBOL_HINTS)))
    return sorted(out)


def python_spans(body: Column) -> Column:
    """Spans of the classes and functions of Python texts, by their syntax trees, in Arrow batches."""
    # pandas takes rows of structs as dicts
    run = F.pandas_udf(lambda s: s.map(lambda b: [dict(zip(("start", "end", "name", "score"), x, strict=True)) for x in _tree_spans(b)]), SPANS)
    return run(body)


def best_span(spans: Column) -> Column:
    """The span of the greatest score, of equals the one that starts first."""
    return F.array_min(F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("rank"), s["start"].alias("at"), i.alias("i"), s.alias("span")))).span


def evidence(code: DataFrame, limit: int = 10) -> DataFrame:
    """(id, path, language, symbol, start_line, end_line, excerpt, content_sha256, source_sha256) of the best distinct symbols.

    code: path, language, score, sha256, body (text), which is searched to its end. Only the best `limit` rows are ever brought together.
    """
    # each step is made once: a condition on a generated column is not moved below it, where its text would be made again
    once = lambda c: F.explode(F.array(c))
    rows = code.select("path", "language", "score", "sha256", once(governance.sanitize(F.col("body"))).alias("_t"))
    rows = rows.where("_t <> ''").withColumn("_lines", once(F.split("_t", _LINE_END)))
    python = F.col("language") == "python"
    rows = rows.withColumn("_s", F.when(python, python_spans(F.when(python, F.col("_t")))).otherwise(generic_spans(F.col("_lines"), F.col("language")))).withColumn("_b", once(best_span(F.col("_s"))))
    hints = F.array(*map(F.lit, vocab.SYMBOL_HINTS))
    hinted = F.transform("_lines", lambda x: F.exists(hints, lambda h: F.contains(F.lower(x), h)))
    block = F.greatest(F.array_position(hinted, True).cast("int"), F.lit(1))
    start = F.coalesce(F.col("_b.start"), block)
    end = F.least(F.size("_lines"), F.coalesce(F.col("_b.end"), block + BLOCK), start + EXCERPT)
    rows = rows.withColumn("_from", start).withColumn("_to", end)
    cut = F.regexp_replace(F.array_join(F.slice("_lines", F.col("_from"), F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0))), "\n"), r"(?U)^\s+|\s+$", "")
    out = rows.select(
        "path", "language", F.coalesce("_b.name", F.lit("relevant_block")).alias("symbol"), F.col("_from").alias("start_line"), F.col("_to").alias("end_line"), once(cut).alias("excerpt"),
        F.col("sha256").alias("source_sha256"), (F.col("score") + F.coalesce("_b.score", F.lit(0))).alias("points"),
    ).where("excerpt <> ''")
    out = out.select("path", "language", "symbol", "start_line", "end_line", "excerpt", F.sha2("excerpt", 256).alias("content_sha256"), "source_sha256", "points")
    # one of equal symbols first, so that a common one is not carried on: partial maxima, then the best rows
    best = out.groupBy(F.lower("symbol").alias("_k"), "content_sha256").agg(F.max_by(F.struct(*out.columns), F.struct("points", "path")).alias("_r"))
    top = best.select("_r.*").orderBy(F.desc("points"), F.desc("path")).limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("points"), F.desc("path")))  # at most `limit` rows
    return top.withColumn("id", F.format_string("CE%03d", place)).drop("points").select("id", *[c for c in out.columns if c != "points"])
