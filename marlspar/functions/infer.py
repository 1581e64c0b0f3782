"""Vocabulary inference: names scored by the phrases a text holds, all within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import among, constant, has_any, has_phrase, held, normalize, tokens, tokens_py


def _ranked(scores: dict[str, Column], order: list[str] | None = None) -> Column:
    """Names with a positive score, highest first, ties in table order."""
    rows = [F.struct((-s).cast("double").alias("s"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores.items())]
    return F.transform(F.array_sort(F.filter(F.array(*rows), lambda r: r["s"] < 0)), lambda r: r["name"])


def _phrase_points(normalized: Column, table: dict[str, list[str]], long: int, short: int) -> dict[str, Column]:
    out = {}
    for name, phrases in table.items():
        total = F.lit(0)
        for p in phrases:
            total = total + F.when(has_phrase(normalized, p), long if " " in p or len(p) > 8 else short).otherwise(0)
        out[name] = total
    return out


def domain_scores(text: Column, table: dict[str, list[str]] | None = None) -> dict[str, Column]:
    n, own = normalize(text), tokens(text)
    scores = _phrase_points(n, table or vocab.DOMAINS, 4, 2)
    for alias, domain in vocab.ALIASES.items():
        scores[domain] = scores[domain] + F.when(F.array_contains(own, alias), 3).otherwise(0)
    return scores


def domains(text: Column, top: int = 5, table: dict[str, list[str]] | None = None) -> Column:
    """Domains by score; primary ones before supporting ones."""
    ranked = _ranked(domain_scores(text, table))
    primary = F.filter(ranked, lambda x: x.isin(vocab.PRIMARY_DOMAINS))
    return F.slice(F.concat(primary, F.filter(ranked, lambda x: x.isin(vocab.SUPPORT_DOMAINS))), 1, top)


def canonical_domain(c: Column) -> Column:
    key = F.replace(normalize(c), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for pair in vocab.ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.nullif(key, F.lit("")))


def mechanisms(text: Column, top: int = 6) -> Column:
    return F.slice(_ranked(_phrase_points(normalize(text), vocab.MECHANISMS, 3, 1)), 1, top)


def intent(text: Column, explicit: Column | None = None) -> Column:
    found = F.get(_ranked(_phrase_points(normalize(text), vocab.INTENTS, 1, 1)), F.lit(0))
    return found if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), found)


def metric_family(metric: Column) -> Column:
    """The first family with a phrase; `map` does not count next to an `@`."""
    n = normalize(metric)
    out = F.when(n == "", "unknown")
    for family, phrases in vocab.METRICS.items():
        plain = [p for p in phrases if p != "map"]
        test = has_any(n, plain)
        if "map" in phrases:
            test = test | (has_phrase(n, "map") & ~n.contains("@"))
        out = out.when(test, family)
    return out.otherwise("custom")


def named_signals(text: Column, table: dict[str, str]) -> Column:
    n = normalize(text)
    return F.filter(F.array(*[F.when(has_any(n, p), F.lit(k)) for k, p in table.items()]), lambda x: x.isNotNull())


def metric_phrases(text: Column) -> Column:
    n = normalize(text)
    return F.array_distinct(F.filter(F.array(*[F.when(has_phrase(n, p), F.lit(p)) for v in vocab.METRICS.values() for p in v]), lambda x: x.isNotNull()))


def risk_mechanisms(risks: Column) -> Column:
    table = F.create_map(*[x for k, v in vocab.RISK_MECHANISMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(risks, lambda r: F.coalesce(F.try_element_at(table, r), F.array().cast("array<string>")))))


def component(text: Column) -> Column:
    n, out = normalize(text), None
    for name, phrases in vocab.COMPONENTS.items():
        out = (F if out is None else out).when(has_any(n, phrases), name)
    return out.otherwise("pipeline")


def cost(text: Column) -> Column:
    n = normalize(text)
    high, medium = (has_any(n, p) for p in vocab.COSTS.values())
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def entry_domain_scores(token_set: Column, chapter_tokens: Column) -> Column:
    """map<domain, score> of a catalog entry: 2 or 1 a phrase, 5 for a chapter hint; zeros left out."""
    lists = lambda phrases: [t for p in phrases if (t := sorted(set(tokens_py(p))))]
    rows = [
        {"domain": d, "two": lists(p for p in phrases if " " in p), "one": lists(p for p in phrases if " " not in p), "hints": lists(vocab.CHAPTER_HINTS.get(d, []))}
        for d, phrases in vocab.DOMAINS.items()
    ]
    known = constant(rows, "array<struct<domain: string, two: array<array<string>>, one: array<array<string>>, hints: array<array<string>>>>")

    def scores(own: Column) -> Column:
        def score(x: Column) -> Column:
            hint = F.when(F.size(held(chapter_tokens, x["hints"])) > 0, 5).otherwise(0)
            points = 2 * F.size(held(own, x["two"])) + F.size(held(own, x["one"])) + hint
            return F.struct(x["domain"].alias("key"), points.alias("value"))

        return F.map_from_entries(F.filter(F.transform(known, score), lambda x: x["value"] > 0))

    return among(token_set, [t for r in rows for t in r["two"] + r["one"]], scores)


def profile(slug: Column, title: Column, description: Column, metric: Column, data: Column, constraints: Column) -> Column:
    """A task's profile as one struct."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (slug, title, description, metric, data, constraints)])
    found, risks = domains(text), named_signals(text, vocab.RISKS)
    checks = [
        (F.coalesce(metric, F.lit("")) == "", "official metric and local implementation"),
        (F.coalesce(data, F.lit("")) == "", "file inventory, train/test schema, target and ID columns"),
        (F.size(F.array_intersect(found, F.array(*map(F.lit, vocab.PRIMARY_DOMAINS)))) == 0, "primary data modality and prediction unit"),
        (F.size(risks) == 0, "validation grouping, chronology, duplicate and shift risks"),
    ]
    unknown = F.filter(F.array(*[F.when(test, F.lit(what)) for test, what in checks]), lambda x: x.isNotNull())
    return F.struct(
        found.alias("domains"), F.array_distinct(F.concat(mechanisms(text), risk_mechanisms(risks))).alias("mechanisms"), metric_family(metric).alias("metric_family"),
        risks.alias("validation_risks"), named_signals(F.concat_ws(" ", constraints, description), vocab.CONSTRAINTS).alias("runtime_constraints"), unknown.alias("unknowns"),
    )
