"""Experience cards distilled from a ledger, kept as tables: heads, lessons, code evidence, lineage and sources.

A card is one head row of a workspace and any number of part rows. The parts stay rows from the first join to the Markdown
lines, so that a workspace with a third of all runs is many rows of many tasks and never one value. Running numbers (L001,
N001, CE001) are given in blocks of BLOCK places: counts of blocks are summed, then each block is numbered by itself.

Inputs, all with `workspace`:
  workspaces  slug, title, url, metric, direction, created_at, best, revision, domains, mechanisms, metric_family, risks,
              runtime_constraints, summary, card_type, repository, license
  runs        place, id, parent, component, status, hypothesis, change, diagnosis, notes, cv, cv_std, ablation, research_ids,
              artifact, analysis_status, code_version, data_version, fold_version, metric_version, seeds
  analyses    experiment, version, verdict, mechanism, confounders, fold_count, fold_wins, effect, slice_findings, resource_tradeoff
  ablations   id, factor, control, treatment, fixed_conditions
  research    place, id, status, transfer_conditions, failure_conditions, urls
  code        experiment, ord, path, start_line, end_line, language, symbol, excerpt, content_sha256, source_sha256

Cases: rows without a workspace or an id join nothing; a run without analysis is a lesson only if it failed; the highest
version of an analysis counts; of equal code evidence the first (by run, then ord) stays; null texts are empty; empty tables
give heads without parts, which the gate blocks; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import governance, text
from ..sources import store
from . import cards, ledger

#: Places numbered, or digests joined, by one task at a time.
BLOCK = 4096
#: Sources named in one Markdown line.
LINE_SOURCES = 1000
SCHEMA_VERSION = 1
#: Keywords of a card, and its lessons that are looked at for one that alone has as many.
KEYWORDS, EARLY = 48, 16

POSITIVE = ("supported", "partially_supported")
NEGATIVE = ("not_supported", "inconclusive")

# What a reproducible best run records, in the order of the warnings.
REPRODUCTION = ["code_version", "data_version", "fold_version", "metric_version", "seeds"]

_NONE = "array<string>"


def _texts(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.array().cast(_NONE)) for c in columns]


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def base_name(path: Column) -> Column:
    """The last part of a path without trailing slashes; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.translate(text.text_or_empty(path), "\\", "/"), "/+$", ""), "^.*/", "")


def numbered(rows: DataFrame, keys: list[str], place: str, order: list[str]) -> DataFrame:
    """Adds `number` (1, 2, ...) within the keys, by `place` and then `order`; a key's places are numbered block by block."""
    cut = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    sums = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_count")
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(place, *order))
    return cut.withColumn("_own", own).join(sums.select(*keys, "_block", before.alias("_before")), [*keys, "_block"]).withColumn("number", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def lessons(runs: DataFrame, analyses: DataFrame, ablations: DataFrame, research: DataFrame) -> DataFrame:
    """One row a lesson: kind (validated, negative), number, lesson_id and what is known of it."""
    c = F.col
    last = analyses.groupBy("workspace", c("experiment").alias("id")).agg(
        F.max_by(F.struct("verdict", "mechanism", "confounders", "fold_count", "fold_wins", "effect", "slice_findings", "resource_tradeoff"), "version").alias("a")
    )
    plan = ablations.select("workspace", c("id").alias("ablation"), F.struct("factor", "control", "treatment", "fixed_conditions").alias("b"))
    claims = research.select("workspace", c("id").alias("_research"), "transfer_conditions", "failure_conditions", "urls")
    used = (
        runs.select("workspace", "id", F.posexplode("research_ids").alias("_pos", "_research")).join(claims, ["workspace", "_research"]).groupBy("workspace", "id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "transfer_conditions", "failure_conditions", "urls"))).alias("r"))
    )
    own = runs.select("workspace", "place", "id", "component", "status", "hypothesis", "change", "diagnosis", "notes", "ablation", "research_ids", "artifact")
    rows = own.join(last, ["workspace", "id"], "left").join(used, ["workspace", "id"], "left").join(plan, ["workspace", "ablation"], "left")
    verdict = c("a.verdict")
    kind = F.when(verdict.isin(*POSITIVE), "validated").when(verdict.isin(*NEGATIVE) | (c("status") == "failed"), "negative")
    broken = ~F.coalesce(verdict.isin(*POSITIVE, *NEGATIVE), F.lit(False))
    factor = F.coalesce(F.nullif("b.factor", F.lit("")), F.nullif("component", F.lit("")), F.lit("pipeline"))
    claim = F.coalesce(F.nullif("hypothesis", F.lit("")), c("change"), F.lit("None"))
    transfer = F.concat(*_texts("b.fixed_conditions", "r.transfer_conditions"))
    failure = F.concat(*_texts("a.confounders", "r.failure_conditions"))
    urls = F.transform(F.flatten(F.coalesce(c("r.urls"), F.array().cast("array<array<string>>"))), governance.strip_query)
    plain = lambda x: F.when(~broken, text.text_or_empty(x))
    out = rows.select(
        "workspace", kind.alias("kind"), "place", c("id").alias("experiment"), c("ablation"), "research_ids", F.when(broken, "failed").otherwise(verdict).alias("verdict"),
        F.when(broken, F.coalesce(F.nullif("hypothesis", F.lit("")), F.nullif("change", F.lit("")), c("id"))).otherwise(F.concat(factor, F.lit(": "), claim)).alias("title"),
        F.when(broken, "high").otherwise(ledger.confidence(verdict, F.coalesce("a.fold_count", F.lit(0)), F.coalesce("a.fold_wins", F.lit(0)))).alias("confidence"),
        F.when(broken, F.coalesce(F.nullif("diagnosis", F.lit("")), F.lit("execution failure"))).otherwise(text.text_or_empty(c("a.mechanism"))).alias("mechanism"),
        text.text_or_empty(c("change")).alias("implementation"), plain(c("b.control")).alias("control"), plain(c("b.treatment")).alias("treatment"),
        F.when(~broken, c("a.effect")).alias("effect"), F.when(~broken, c("a.slice_findings")).alias("slice_findings"), plain(c("a.resource_tradeoff")).alias("resource_tradeoff"),
        F.when(broken, F.array().cast(_NONE)).otherwise(_distinct(transfer)).alias("transfer_conditions"),
        F.when(broken, _distinct(F.array("diagnosis", "notes"))).otherwise(_distinct(failure)).alias("failure_conditions"),
        F.when(broken, F.array().cast(_NONE)).otherwise(_distinct(urls)).alias("source_urls"), base_name(c("artifact")).alias("artifact_ref"),
    ).where("workspace is not null and kind is not null")
    mark = F.when(c("kind") == "validated", "L").otherwise("N")
    return numbered(out, ["workspace", "kind"], "place", ["experiment"]).withColumn("lesson_id", F.concat(mark, F.lpad(c("number").cast("string"), F.greatest(F.lit(3), F.length(c("number").cast("string"))), F.lit("0"))))


def _marked(code: DataFrame) -> DataFrame:
    """Code evidence with its path as cards have it and 128 bits of the whole row."""
    rows = code.withColumn("path", F.translate(text.text_or_empty(F.col("path")), "\\", "/"))
    whole = [F.col(x) for x in ("workspace", "experiment", "ord", "path", "start_line", "end_line", "language", "symbol", "excerpt", "content_sha256", "source_sha256")]
    return rows.withColumn("_mark", F.xxhash64(*whole)).withColumn("_mark2", F.xxhash64(F.lit(7), *whole))


def evidence(code: DataFrame, runs: DataFrame, found: DataFrame) -> DataFrame:
    """Each piece of code evidence once, with its id and the lesson of the run that first cited it (null: general); `with_excerpts` adds the texts."""
    c = F.col
    rest = ["place", "ord", "experiment", "language", "symbol", "source_sha256", "_mark", "_mark2"]
    rows = _marked(code).drop("excerpt").join(runs.select("workspace", c("id").alias("experiment"), "place"), ["workspace", "experiment"])
    once = rows.groupBy("workspace", "path", "start_line", "end_line", "content_sha256").agg(F.min_by(F.struct(*rest), F.struct("place", "ord")).alias("e"))
    flat = once.select("workspace", "path", "start_line", "end_line", "content_sha256", *[c(f"e.{x}").alias(x) for x in rest])
    digits = c("number").cast("string")
    named = numbered(flat, ["workspace"], "place", ["ord"]).withColumn("evidence_id", F.concat(F.lit("CE"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))))
    return named.join(found.select("workspace", "experiment", "lesson_id", "kind"), ["workspace", "experiment"], "left")


def with_excerpts(cited: DataFrame, code: DataFrame) -> DataFrame:
    """The pieces of `evidence` with their excerpts: one shuffle of the texts, by the marks of their rows."""
    marks = ["_mark", "_mark2"]
    rows = cited.join(_marked(code).select(*marks, "excerpt"), marks).dropDuplicates(marks)  # rows with equal marks are equal
    return rows.select(
        "workspace", "experiment", "path", "start_line", "end_line", "content_sha256", "place", "ord", "language", "symbol", "excerpt", "source_sha256", "number", "evidence_id", "lesson_id", "kind",
    )


def first_distinct(rows: DataFrame, key: str, value: str, order: list[str], most: int) -> DataFrame:
    """(key, list): the first `most` distinct values of each key that are neither null nor empty; counted before they are shuffled."""
    firsts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.min(F.struct(*order)).alias("_order"))
    best = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_order"))).where(F.col("_n") <= most)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("list"))


class Cards:
    """The tables of any number of cards; each is made when it is first asked for, so that a reader of one pays for no other.

    heads, lessons, cited (code evidence without its excerpts), evidence (with them), faults (of the evidence), chain, sources.
    """

    def __init__(self, **parts: Callable[[], DataFrame]):
        self._parts = {name: cache(make) for name, make in parts.items()}

    def __getattr__(self, name: str) -> DataFrame:
        parts = self.__dict__.get("_parts", {})
        if name not in parts:
            raise AttributeError(name)
        return parts[name]()

    def only(self, workspaces: DataFrame) -> Cards:
        """The cards of these workspaces."""
        return Cards(**{name: lambda make=make: make().join(workspaces, "workspace", "left_semi") for name, make in self._parts.items()})


def build(workspaces: DataFrame, runs: DataFrame, analyses: DataFrame, ablations: DataFrame, research: DataFrame, code: DataFrame) -> Cards:
    """Draft cards of all workspaces; a part that several steps read is written once to the shared folder.

    Texts go through as few shuffles as can be: numbers and ids are found without them.
    """
    made: Cards
    found = lessons(runs, analyses, ablations, research)

    def numbers() -> DataFrame:
        """The lessons' ids alone; no text is read for them."""
        return store.kept(found.select("workspace", "experiment", "lesson_id", "kind"), "card-numbers")

    def sources() -> DataFrame:
        urls = research.where("status = 'verified'").select("workspace", "place", F.posexplode("urls").alias("_pos", "_url"))
        urls = urls.select("workspace", governance.strip_query(F.col("_url")).alias("url"), F.struct("place", "_pos").alias("_at")).where("url <> ''")
        firsts = urls.groupBy("workspace", "url").agg(F.min("_at").alias("_at")).select("workspace", "url", "_at.place", "_at._pos")
        return store.kept(numbered(firsts, ["workspace"], "place", ["_pos"]).select("workspace", "number", "url"), "card-sources")

    def chain() -> DataFrame:
        link = runs.select(F.struct("workspace", "id").alias("key"), F.when(F.col("parent").isNotNull(), F.struct(F.col("workspace"), F.col("parent").alias("id"))).alias("up"))
        steps = ledger.lineage(link, made.heads.where("best is not null").select(F.struct("workspace", F.col("best").alias("id")).alias("key")), "key", "up")
        steps = store.kept(steps.select("key.workspace", F.col("key.id").alias("id"), "depth"), "card-steps")  # its size decides how the runs' texts are joined
        return store.kept(steps.join(runs.select("workspace", "id", "component", "change", "cv", "cv_std", base_name(F.col("artifact")).alias("artifact_ref")), ["workspace", "id"]), "card-lineage")

    made = Cards(
        heads=lambda: store.kept(_heads(workspaces, runs, made.lessons, made.cited), "card-heads"), lessons=lambda: store.kept(found, "card-lessons"), cited=lambda: store.kept(evidence(code, runs, numbers()), "card-evidence"),
        evidence=lambda: with_excerpts(made.cited, code), faults=lambda: store.kept(_evidence_faults(made.evidence), "card-faults"), chain=chain, sources=sources,
    )
    return made


def _heads(workspaces: DataFrame, runs: DataFrame, found: DataFrame, cited: DataFrame) -> DataFrame:
    c = F.col
    counts = found.groupBy("workspace").agg(F.count_if(c("kind") == "validated").alias("n_validated"), F.count_if(c("kind") == "negative").alias("n_negative"))
    best = runs.select("workspace", c("id").alias("best"), *REPRODUCTION)
    heads = workspaces.join(best, ["workspace", "best"], "left").join(counts, "workspace", "left").fillna(0, ["n_validated", "n_negative"])
    heads = heads.join(cited.groupBy("workspace").agg(F.count(F.lit(1)).alias("n_evidence")), "workspace", "left").fillna(0, ["n_evidence"])
    slug = F.coalesce(F.nullif("slug", F.lit("")), F.lit("unknown-competition"))
    suffix = F.substring(F.sha2(F.concat(slug, F.lit("|"), text.text_or_empty(c("created_at"))), 256), 1, 8)
    card_id = F.regexp_replace(F.regexp_replace(F.lower(F.concat(slug, F.lit("-postmortem-"), suffix)), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    short = F.format_string("Post-competition distillation for %s: %d validated lessons and %d negative or inconclusive lessons.", slug, "n_validated", "n_negative")
    heads = heads.select(
        "workspace", card_id.alias("card_id"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), F.lit(SCHEMA_VERSION).alias("schema_version"), slug.alias("slug"),
        F.coalesce(F.nullif("title", F.lit("")), slug).alias("title"), governance.strip_query(c("url")).alias("url"), text.text_or_empty(c("metric")).alias("metric"),
        F.coalesce("direction", F.lit("higher")).alias("direction"), *[x.alias(n) for n, x in zip(("domains", "mechanisms", "risks", "runtime_constraints"), _texts("domains", "mechanisms", "risks", "runtime_constraints"))],
        F.coalesce("metric_family", F.lit("unknown")).alias("metric_family"), F.coalesce(F.nullif("summary", F.lit("")), short).alias("summary"), "best", *REPRODUCTION, "card_type", "repository", "license",
        "n_validated", "n_negative", "n_evidence",
    ).where("workspace is not null")
    return heads.join(_keywords(heads, found), "workspace", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast(_NONE)))


def _keywords(heads: DataFrame, found: DataFrame) -> DataFrame:
    """The first KEYWORDS of the profile's terms and then of the lessons' words.

    A lesson of so many distinct words ends its card's list at the latest: no word of it beyond them and no lesson after it counts.
    """
    own = heads.select("workspace", F.posexplode(F.concat("domains", "mechanisms", "risks")).alias("_pos", "word")).select("workspace", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("number"), "_pos", "word")
    words = F.slice(F.array_distinct(text.tokens(F.concat_ws(" ", *[text.text_or_empty(F.col(x)) for x in ("title", "mechanism", "implementation")]))), 1, KEYWORDS)
    said = found.withColumn("_part", F.when(F.col("kind") == "validated", 1).otherwise(2))
    full = said.where(F.col("number") <= EARLY).where(F.size(words) == KEYWORDS).groupBy("workspace").agg(F.min(F.struct("_part", "number")).alias("_last"))
    needed = said.join(store.kept(full, "card-keywords-full"), "workspace", "left").where(F.col("_last").isNull() | (F.struct("_part", "number") <= F.col("_last")))
    rest = needed.select("workspace", "_part", "number", F.posexplode(words).alias("_pos", "word"))
    return first_distinct(own.unionByName(rest), "workspace", "word", ["_part", "number", "_pos"], KEYWORDS).withColumnRenamed("list", "keywords")


def digests(made: Cards) -> DataFrame:
    """(workspace, card_hash): sha256 over the head and the digests of all parts, joined by blocks of rows."""
    parts = None
    for k, (t, order) in enumerate([(made.lessons, ["kind", "number"]), (made.evidence, ["number"]), (made.chain, ["depth"]), (made.sources, ["number"])]):
        at = F.col(order[-1]).cast("long")
        group = F.concat(F.lit(f"{k}"), *[F.col(o) for o in order[:-1]])
        own = t.select("workspace", group.alias("_part"), F.floor(at / BLOCK).alias("_block"), F.struct(at.alias("n"), F.sha2(F.to_json(F.struct(*[F.col(x) for x in sorted(t.columns)])), 256).alias("h")).alias("_row"))
        parts = own if parts is None else parts.unionByName(own)
    joined = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda r: r.h), ""), 256)
    blocks = parts.groupBy("workspace", "_part", "_block").agg(joined("_row").alias("h"))
    body = blocks.groupBy("workspace").agg(joined(F.struct("_part", "_block", "h")).alias("_body"))
    head = F.to_json(F.struct(*[F.col(x) for x in sorted(made.heads.columns)]))
    return made.heads.join(body, "workspace", "left").select("workspace", F.sha2(F.concat(head, F.coalesce("_body", F.lit(""))), 256).alias("card_hash"))


def _broken(level: str, rule: str, table: DataFrame, test: Column, message: Column | str, item: Column | None = None, once: bool = False) -> DataFrame:
    """Problem rows of a table; `once` counts all rows of a card as one problem."""
    item = F.lit("") if item is None else item
    return table.where(F.coalesce(test, F.lit(True))).select("workspace", F.lit(level).alias("level"), F.lit(rule).alias("rule"), item.alias("item"), (F.lit("") if once else item).alias("counted"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _sensitive(made: Cards) -> DataFrame:
    """Workspaces of cards with a secret, a local path or a URL with a query in any text."""
    hits = made.faults.where("sensitive").select("workspace")
    for t in (made.heads, made.lessons, made.chain):
        hits = hits.unionByName(t.where(governance.is_sensitive(F.to_json(F.struct(*[c for c in t.columns])))).select("workspace"))
    return hits.distinct()


def _evidence_faults(pieces: DataFrame) -> DataFrame:
    """(workspace, item, marks, sensitive) of the pieces with a fault: all rules in one scan of the excerpts."""
    c = F.col
    name = c("evidence_id")
    say = lambda s: F.concat(F.lit("code evidence "), name, F.lit(f" {s}"))
    rules = [
        ("path", (c("path") == "") | c("path").rlike("^(?:[A-Za-z]:|/)") | c("path").rlike(r"(^|/)\.\.(/|$)"), say("has an unsafe path")),
        ("excerpt", ~text.text_or_empty(c("excerpt")).rlike(r"(?U)\S"), say("has no excerpt")),
        ("content", F.coalesce("content_sha256", F.lit("")) != F.sha2(text.text_or_empty(c("excerpt")), 256), say("content hash mismatch")),
        ("source", ~F.coalesce("source_sha256", F.lit("")).rlike(cards.HEX64), say("needs a SHA-256 hash of its source file")),
        ("integers", c("start_line").isNull() | c("end_line").isNull(), say("needs integer line bounds")),
        ("bounds", c("start_line").isNotNull() & c("end_line").isNotNull() & ((c("start_line") <= 0) | (c("end_line") < c("start_line"))), say("has invalid line bounds")),
    ]
    marks = F.filter(F.array(*[F.when(t, F.struct(F.lit(f"evidence_{r}").alias("rule"), m.alias("message"))) for r, t, m in rules]), lambda x: x.isNotNull())
    # a generated row is not made again for the filter
    fault = F.explode(F.array(F.struct(marks.alias("marks"), governance.is_sensitive(F.to_json(F.struct(*[c(x) for x in pieces.columns]))).alias("sensitive"))))
    return pieces.select("workspace", name.alias("item"), fault.alias("f")).select("workspace", "item", "f.marks", "f.sensitive").where(c("sensitive") | (F.size("marks") > 0))


def evidence_problems(made: Cards, level: str = "blocker") -> DataFrame:
    return made.faults.select("workspace", F.lit(level).alias("level"), F.explode("marks").alias("m"), "item").select("workspace", "level", "m.rule", "item", F.col("item").alias("counted"), "m.message")


def provenance_problems(made: Cards, level: str = "blocker") -> DataFrame:
    c = F.col
    cited = (F.coalesce("card_type", F.lit("")) == "external_source_competition") & (c("n_evidence") > 0)
    rules = [
        ("repository", governance.strip_query(c("repository")) == "", "external code evidence needs a public repository URL"),
        ("commit", ~F.lower(F.coalesce("code_version", F.lit(""))).rlike("^[a-f0-9]{7,64}$"), "external code evidence needs an immutable commit hash"),
        ("license", F.lower(F.trim(F.coalesce("license", F.lit("")))).isin("", "unknown", "not recorded"), "external code evidence needs an explicit source license"),
    ]
    marks = F.filter(F.array(*[F.when(cited & t, F.struct(F.lit(f"provenance_{r}").alias("rule"), F.lit(m).alias("message"))) for r, t, m in rules]), lambda x: x.isNotNull())
    return made.heads.select("workspace", F.lit(level).alias("level"), F.explode(marks).alias("m"), F.lit("").alias("item")).select("workspace", "level", "m.rule", "item", F.lit("").alias("counted"), "m.message")


def problems(made: Cards, runs: DataFrame, research: DataFrame) -> DataFrame:
    """Every blocker and warning of every card: level, rule, item, message and what counts as one (`counted`)."""
    c = F.col
    heads, good = made.heads, made.lessons.where("kind = 'validated'")
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    lacks = F.filter(F.array(*[F.when(blank(x), F.lit(n)) for x, n in (("mechanism", "mechanism"), ("implementation", "implementation"), ("experiment", "experiment_id"))]), lambda x: x.isNotNull())
    lesson = lambda s: F.concat(F.lit("lesson "), c("lesson_id"), F.lit(f" {s}"))
    waiting = runs.where("status = 'success'").where(~F.coalesce("component", F.lit("")).isin("validation", "baseline") & (F.coalesce("analysis_status", F.lit("")) != "complete"))
    open_claims = research.where("status = 'pending'").groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    out = [
        _broken("blocker", "slug", heads, c("slug") == "unknown-competition", "competition slug is missing"), _broken("blocker", "metric", heads, blank("metric"), "official metric is missing"),
        _broken("blocker", "lessons", heads, c("n_validated") + c("n_negative") == 0, "no validated or negative lesson was distilled"),
        _broken("blocker", "analysis", waiting, F.lit(True), F.concat(F.lit("successful diagnostic experiment still needs analysis: "), c("id")), c("id"), once=True),
        _broken("blocker", "lesson", good, F.size(lacks) > 0, F.concat(F.lit("lesson "), c("lesson_id"), F.lit(" is missing: "), F.array_join(lacks, ", ")), c("lesson_id")),
        _broken("blocker", "sensitive", _sensitive(made), F.lit(True), "card contains a credential-like string or private absolute path"),
        evidence_problems(made), provenance_problems(made),
        _broken("warning", "transfer", good, F.size("transfer_conditions") == 0, lesson("has no explicit transfer conditions"), c("lesson_id")),
        _broken("warning", "failure", good, F.size("failure_conditions") == 0, lesson("has no explicit failure boundary"), c("lesson_id")),
        _broken("warning", "research", open_claims, F.lit(True), F.format_string("%d source-research tasks remain pending; reject or resolve used claims", "n")),
        _broken("warning", "license", heads, (c("n_evidence") > 0) & blank("license"), "code evidence has no recorded license; record ownership or upstream license before redistribution"),
        *[_broken("warning", f"reproduction_{x}", heads, c("best").isNotNull() & blank(x), f"best solution reproduction is missing {x}") for x in REPRODUCTION],
        _broken("warning", "sources", heads.join(made.sources.select("workspace").distinct(), "workspace", "left_anti"), F.lit(True), "no checked public source URL is recorded"),
    ]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.join(heads.select("workspace"), "workspace", "left_semi")


def reviews(heads: DataFrame, found: DataFrame) -> DataFrame:
    """(workspace, status, score, blockers, warnings): any blocker fails; 25 off for a blocker, 4 for a warning."""
    ones = found.groupBy("workspace", "level", "rule", "counted").agg(F.lit(1).alias("one"))
    sums = ones.groupBy("workspace").agg(*[F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("blocker", "warning")])
    rows = heads.select("workspace").join(sums, "workspace", "left").fillna(0, ["blockers", "warnings"])
    score = F.greatest(F.lit(0).cast("long"), 100 - 25 * F.col("blockers") - 4 * F.col("warnings"))
    return rows.select("workspace", F.when(F.col("blockers") == 0, "pass").otherwise("fail").alias("status"), score.alias("score"), "blockers", "warnings")


def integrity(made: Cards, stored: DataFrame, *, promoted: bool = False) -> DataFrame:
    """Problem rows of stored cards; `stored`: workspace, card_id (the name it is stored by), card_hash, status, review_status, blockers, anchored."""
    c = F.col
    now = digests(made).withColumnRenamed("card_hash", "_now")
    kept = stored.select("workspace", c("card_id").alias("_stored"), "card_hash", "status", "review_status", "blockers", "anchored")
    rows = made.heads.join(kept, "workspace").join(now, "workspace")
    sources = made.sources.select("workspace").distinct().withColumn("_linked", F.lit(True))
    rows = rows.join(sources, "workspace", "left")
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    rules = [
        ("schema", c("schema_version") < 1, "schema_version is missing"), ("card_id", blank("card_id"), "card_id is missing"), ("name", ~c("card_id").eqNullSafe(c("_stored")), "card_id does not match the JSON filename"),
        ("hash", ~c("card_hash").eqNullSafe(c("_now")), "card_hash is missing or stale"), ("promoted", F.lit(promoted) & ~c("status").eqNullSafe(F.lit("promoted")), "knowledge-base card is not promoted"),
        ("review", ~c("review_status").eqNullSafe(F.lit("reviewed")), "review gate has not passed"), ("blockers", F.coalesce("blockers", F.lit(0)) > 0, "review gate still has blockers"),
        ("competition", blank("slug") | blank("metric"), "competition slug or metric is missing"), ("lessons", c("n_validated") + c("n_negative") == 0, "card has no lessons"),
        ("origin", c("_linked").isNull() & c("best").isNull() & (c("n_validated") + c("n_negative") == 0), "card has neither verified sources nor a reproducible experiment lineage"),
        ("anchor", ~F.coalesce("anchored", F.lit(False)), "matching Markdown card has no expected anchor"),
    ]
    marks = F.filter(F.array(*[F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, t, m in rules]), lambda x: x.isNotNull())
    own = rows.select("workspace", F.lit("error").alias("level"), F.explode(marks).alias("m")).select("workspace", "level", "m.rule", F.lit("").alias("item"), F.lit("").alias("counted"), "m.message")
    secret = _broken("error", "sensitive", _sensitive(made), F.lit(True), "card contains a credential-like string or private absolute path")
    return own.unionByName(secret).unionByName(evidence_problems(made, "error")).unionByName(provenance_problems(made, "error")).join(kept.select("workspace"), "workspace", "left_semi")


def roll_up(made: Cards, scores: DataFrame) -> DataFrame:
    """One catalog entry a card; `scores`: workspace, score. Lists hold 16 tricks, 24 factors and 20 conditions at most."""
    c = F.col
    rank = F.when(c("kind") == "validated", 0).otherwise(1)
    said = F.when(c("kind") == "validated", F.concat("title", F.lit(": "), "mechanism", F.lit(". Implementation: "), "implementation")).otherwise(F.concat(F.lit("Negative evidence - "), "title", F.lit(": "), "mechanism"))
    top = made.lessons.where("number <= 16").select("workspace", F.struct(rank.alias("rank"), "number", said.alias("trick")).alias("_t"))
    tricks = top.groupBy("workspace").agg(F.slice(F.transform(F.array_sort(F.collect_list("_t")), lambda x: x.trick), 1, 16).alias("trick_highlights"))
    conditions = made.lessons.where("kind = 'validated'").select("workspace", "number", F.posexplode("transfer_conditions").alias("_pos", "value"))
    transfer = first_distinct(conditions, "workspace", "value", ["number", "_pos"], 20).withColumnRenamed("list", "transfer_scenarios")
    names = made.lessons.select("workspace", rank.alias("_rank"), "number", F.posexplode(F.array("mechanism", "title")).alias("_pos", "value"))
    factors = first_distinct(names, "workspace", "value", ["_rank", "number", "_pos"], 24).withColumnRenamed("list", "method_keywords")
    links = made.sources.where("number = 1").select("workspace", c("url").alias("_first"))
    rows = made.heads.join(digests(made), "workspace").join(scores.select("workspace", "score"), "workspace", "left")
    for t in (tricks, transfer, factors, links):
        rows = rows.join(t, "workspace", "left")
    anchor = F.concat(F.lit("experience-"), "card_id")
    return rows.select(
        "workspace", "card_id", "card_hash", anchor.alias("anchor"), F.concat("title", F.lit(" reviewed competition experience")).alias("title"), "slug", "url", F.coalesce("_first", "url").alias("source_url"),
        F.coalesce("license", F.lit("unknown")).alias("source_license"), F.when(c("n_evidence") > 0, "cited").otherwise("none").alias("code_evidence_status"), c("domains").alias("algo_tags"),
        c("keywords").alias("core_keywords"), *[x.alias(n) for n, x in zip(("method_keywords", "transfer_scenarios", "trick_highlights"), _texts("method_keywords", "transfer_scenarios", "trick_highlights"))],
        c("risks").alias("problem_signals"), c("mechanisms").alias("pattern_families"), "summary", cards.catalog_quality(F.coalesce("score", F.lit(0)), c("n_validated"), c("n_negative")).alias("quality_score"),
        c("n_evidence").alias("code_evidence_count"), (c("n_validated") + c("n_negative")).alias("tricks_count"),
    )


def _value(c: Column, kind: str = "text") -> Column:
    """A cell as the card prints it: `not recorded` for nothing, lists as JSON with a space after each comma."""
    if kind == "list":
        quoted = F.transform(c, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))).otherwise("not recorded")
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("not recorded"))


def markdown(made: Cards, review: DataFrame, statuses: DataFrame) -> DataFrame:
    """The cards as Markdown: (workspace, section, number, line_no, line); sorted by them, a card's lines are its text.

    `review`: workspace, status, score; `statuses`: workspace, status of the card (draft, reviewed, promoted).
    """
    c, j = F.col, F.concat
    lit = F.lit
    none = lambda x: F.coalesce(x.cast("string"), lit("None"))
    rows = made.heads.join(statuses.select("workspace", c("status").alias("_status")), "workspace", "left").join(review.select("workspace", c("status").alias("_review"), "score"), "workspace", "left")

    def lines(t: DataFrame, section: Column | int, number: Column, *values: Column | str) -> DataFrame:
        cells = F.array(*[lit(v) if isinstance(v, str) else v for v in values])
        return t.select("workspace", (lit(section) if isinstance(section, int) else section).cast("int").alias("section"), number.cast("long").alias("number"), F.posexplode(cells).alias("line_no", "line")).where("line is not null")

    zero = lit(0)
    task = [("Domains", "domains", "list"), ("Mechanisms", "mechanisms", "list"), ("Validation risks", "risks", "list"), ("Runtime constraints", "runtime_constraints", "list"), ("Metric family", "metric_family", "text")]
    head = lines(
        rows, 0, zero, j(lit("## 1. "), "title", lit(" {#experience-"), "card_id", lit("}")), "",
        j(lit("> Competition: `"), "slug", lit("` | Metric: `"), "metric", lit("` | Status: `"), none(c("_status")), lit("`")), "", "### Summary", c("summary"), "", "### Task Fingerprint",
        *[j(lit(f"- {n}: "), _value(c(x), k)) for n, x, k in task], "", "### Validated Lessons", F.when(c("n_validated") == 0, "No positive lesson passed the evidence gate. See negative lessons."),
    )
    good = lines(
        made.lessons.where("kind = 'validated'"), 1, c("number"), j(lit("#### "), "lesson_id", lit(" "), "title"), j(lit("- Verdict / confidence: `"), "verdict", lit("` / `"), "confidence", lit("`")),
        *[j(lit(f"- {n}: "), _value(c(x), k)) for n, x, k in [("Mechanism", "mechanism", "text"), ("Implementation", "implementation", "text"), ("Effect", "effect", "text"), ("Slice findings", "slice_findings", "text"), ("Transfer conditions", "transfer_conditions", "list"), ("Failure conditions", "failure_conditions", "list"), ("Resource tradeoff", "resource_tradeoff", "text")]],
        j(lit("- Evidence: experiment `"), none(c("experiment")), lit("`, ablation `"), none(c("ablation")), lit("`")), "",
    )
    title = lines(rows, 2, zero, "### Negative And Inconclusive Lessons", F.when(c("n_negative") == 0, "No negative lesson was recorded."))
    bad = lines(
        made.lessons.where("kind = 'negative'"), 3, c("number"), j(lit("#### "), "lesson_id", lit(" "), "title"), j(lit("- Verdict: `"), "verdict", lit("`")),
        j(lit("- Diagnosis: "), _value(c("mechanism"))), j(lit("- Failed or uncertain conditions: "), _value(c("failure_conditions"), "list")), "",
    )
    language = F.coalesce(F.nullif(F.regexp_replace(F.coalesce("language", lit("text")), "[^A-Za-z0-9_+-]", ""), lit("")), lit("text"))
    code = lines(
        made.evidence, 5, c("number"), j(lit("#### "), "evidence_id", lit(" `"), "path", lit(":"), none(c("start_line")), lit("-"), none(c("end_line")), lit("`")), j(lit("- Lessons: "), F.coalesce("lesson_id", lit("general"))),
        j(lit("- Symbol: `"), F.coalesce(F.nullif("symbol", lit("")), lit("relevant_block")), lit("`")), j(lit("````"), language), F.regexp_replace(text.text_or_empty(c("excerpt")), r"(?U)\s+$", ""), "````",
        j(lit("- Excerpt SHA256: `"), none(c("content_sha256")), lit("`")), "",
    )
    table = lines(rows, 6, zero, "### Best Solution Lineage", "| Experiment | Component | Change | CV Mean | CV Std | Artifact |", "|---|---|---|---:|---:|---|")
    steps = lines(made.chain, 7, -c("depth"), j(lit("| "), "id", lit(" | "), none(c("component")), lit(" | "), none(c("change")), lit(" | "), none(c("cv")), lit(" | "), none(c("cv_std")), lit(" | "), "artifact_ref", lit(" |")))
    facts = F.to_json(F.struct(c("best").alias("experiment_id"), *REPRODUCTION, "license"))
    index = lines(rows, 8, zero, "", "### Reproducibility", j(lit("```json\n"), facts, lit("\n```")), "", "### Retrieval Index", j(lit("- Keywords: "), F.array_join("keywords", ", ")))
    some = made.sources.groupBy("workspace", F.floor((c("number") - 1) / LINE_SOURCES).alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "url"))), lambda x: x.url).alias("urls"))
    some = rows.select("workspace").join(some, "workspace", "left").withColumn("number", F.coalesce("number", lit(0)))
    sources = lines(some, 9, c("number"), j(lit("- Verified sources: "), _value(c("urls"), "list")))
    gate = lines(rows, 10, zero, "", "### Review Gate", j(lit("- Status: `"), none(c("_review")), lit("`")), j(lit("- Score: `"), none(c("score")), lit("`")))
    out = head
    for x in (good, title, bad, lines(rows.where("n_evidence > 0"), 4, zero, "### Code Evidence"), code, table, steps, index, sources, gate):
        out = out.unionByName(x)
    return out


def write_markdown(made: Cards, lines: DataFrame, folder: str) -> None:
    """Markdown in one folder a card (card_id=...); its files in the order of their names are the text. A long card is split between tasks."""
    rows = lines.join(made.heads.select("workspace", "card_id"), "workspace")
    order = ["card_id", "section", "number", "line_no"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("card_id", F.col("line").alias("value")).write.partitionBy("card_id").text(folder)
