"""Complete retrieval for many profiles at once: lenses, recall, facets, fusion, payloads, diversity, bridges, coverage.

Profiles are rows. All their lenses are queries of one search in an index (or a scan) of the entries; facets are computed for
the pairs of a profile and an entry that the search returned, from columns kept with the index; ranks, fusion, diversity
and bridges are by profile, over pools whose size does not depend on the catalog.

Cases: a profile without lenses, or whose lenses find nothing, has a coverage row with zeros and no results; entries that
share an identity (competition, source, title, kind of source; else anchor or id) are one candidate, shown by the one with
the greatest score of any lens; equal scores go by entry id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import governance, infer, text, vocab
from ..sources import store
from . import retrieval

STRINGS = "array<string>"
#: Columns of a profile; the others of `profiles` are not read.
PROFILE = {
    "profile": "string", "slug": "string", "title": "string", "description": "string", "metric": "string", "metric_family": "string", "data": "string", "stage": "string",
    "domains": STRINGS, "mechanisms": STRINGS, "validation_risks": STRINGS, "queries": STRINGS, "intent": "string",
}
#: Longest lists of a result's payload, and characters of its summary.
PAYLOAD = {"core_keywords": 14, "method_keywords": 14, "problem_signals": 12, "transfer_scenarios": 8, "pattern_families": 8, "trick_highlights": 10}
SUMMARY, REASONS = 1000, 8
TEXTS = ["id", "title", "chapter", "competition_slug", "competition_url", "source", "source_url", "source_type", "catalog_tier", "provenance_status", "trust_level", "source_license", "source_content_sha256", "code_evidence_status", "anchor", "summary"]
LISTS = ["algo_tags", *PAYLOAD]
NUMBERS = ["tricks_count", "code_evidence_count", "quality_score"]
#: What `facet` reads of a profile, and of an entry beside its title, summary and words.
ASKED = ["slug", "metric", "domains", "mechanisms", "validation_risks", "intent"]
FACED = ["_scores", "_risks", "_mechanisms", "_identity", "_slug", *NUMBERS, "catalog_tier", "source_type"]


def shaped(entries: DataFrame) -> DataFrame:
    """Entries with every column of a catalog (missing ones null) and the columns that facets need, to be indexed by `id`."""
    kind = dict.fromkeys(LISTS, STRINGS) | dict.fromkeys(NUMBERS, "double")
    own = [F.col(c).cast(kind.get(c, "string")).alias(c) if c in entries.columns else F.lit(None).cast(kind.get(c, "string")).alias(c) for c in [*TEXTS[1:], *LISTS, *NUMBERS]]
    df = entries.select("id", *own)
    words = F.array_distinct(text.tokens(F.concat_ws(" ", F.transform(retrieval.entry_fields(), lambda f: f["text"]))))
    df = df.withColumn("_words", words)
    scores = infer.entry_domain_scores(F.col("_words"), F.array_distinct(text.tokens(F.col("chapter"))))
    named = lambda table: text.names_held(F.col("_words"), table)
    identity = text.entry_key(F.col("competition_slug"), F.col("source"), F.col("title"), F.col("source_type"), F.col("anchor"), F.col("id").cast("string"))
    diverse = F.array_distinct(text.tokens(F.concat_ws(" ", "title", "core_keywords", "algo_tags")))
    return df.select(
        "*", scores.alias("_scores"), named(vocab.RISKS).alias("_risks"), named(vocab.MECHANISMS).alias("_mechanisms"), identity.alias("_identity"), diverse.alias("_diverse"),
        text.normalize(F.col("competition_slug")).alias("_slug"),
    )


def prepared(profiles: DataFrame) -> DataFrame:
    """Profiles with all their columns (missing ones empty) and the intent: the given one, else the one their words show."""
    empty = lambda t: F.array().cast(STRINGS) if t == STRINGS else F.lit("")
    rows = profiles.select(*[F.coalesce(F.col(c).cast(t), empty(t)).alias(c) if c in profiles.columns else empty(t).alias(c) for c, t in PROFILE.items()])
    said = F.concat_ws(" ", F.array_join("queries", " "), "description")
    return rows.withColumn("intent", infer.intent(said, F.col("intent")))


def lens_rows(profiles: DataFrame) -> DataFrame:
    """(profile, lens, weight, words) of prepared profiles; a profile has some thirty lenses at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                have = {k: [*v] if PROFILE[k] == STRINGS else v for k, v in r.items()}
                out += [(r["profile"], name, float(weight), words) for name, words, weight, _ in retrieval.lenses(have, have["queries"])]
            yield pd.DataFrame(out, columns=["profile", "lens", "weight", "words"])

    return profiles.select(*[c for c in PROFILE if c != "intent"]).mapInPandas(run, "profile string, lens string, weight double, words string")


def facet(pairs: DataFrame) -> DataFrame:
    """Adds facet (score), level and reasons to pairs of a prepared profile (struct p) and a shaped entry (struct e)."""
    p, e, r = F.col("p"), F.col("e"), vocab.RANKING
    names = lambda xs: F.array(*map(F.lit, xs))
    own = F.map_keys(F.map_filter(e["_scores"], lambda _, v: v >= 2))
    wanted = F.array_intersect(p["domains"], names(vocab.PRIMARY_DOMAINS))
    df = pairs.select(
        "*", F.array_sort(F.array_intersect(wanted, own)).alias("_primary"), F.array_sort(F.array_intersect(F.array_intersect(p["domains"], own), names(vocab.SUPPORT_DOMAINS))).alias("_support"),
        F.array_intersect(p["validation_risks"], e["_risks"]).alias("_risk"), F.array_intersect(p["mechanisms"], e["_mechanisms"]).alias("_mechanism"),
        F.array_sort(F.array_except(F.array_intersect(own, names(vocab.PRIMARY_DOMAINS)), wanted)).alias("_clash"), (F.size(wanted) > 0).alias("_has_wanted"),
        F.arrays_overlap(text.tokens(p["metric"]), e["_words"]).alias("_metric"), ((e["_slug"] != "") & (e["_slug"] == text.normalize(p["slug"]))).alias("_exact"),
    )
    exact, metric = F.coalesce("_exact", F.lit(False)), F.coalesce("_metric", F.lit(False))
    primary, support, risk, mechanism = (F.size(c) > 0 for c in ("_primary", "_support", "_risk", "_mechanism"))
    clash = F.col("_has_wanted") & ~primary & (F.size("_clash") > 0)
    gained = F.aggregate("_primary", F.lit(0.0), lambda a, d: a + F.least(F.try_element_at(e["_scores"], d), F.lit(8)) * 0.55)
    quality = F.when(p["intent"] == "code", _quality("code")).when(p["intent"] == "strategy", _quality("strategy")).when(p["intent"] == "high_score", _quality("high_score")).otherwise(_quality(None))
    score = (
        quality + F.when(exact, 70.0).otherwise(0.0) + F.when(primary, 8.0 + gained).otherwise(0.0) + F.when(support, 2.5 + F.size("_support")).otherwise(0.0)
        + r["risk_bonus"] * F.size("_risk") + r["mechanism_bonus"] * F.size("_mechanism")
        - F.when(clash & (risk | mechanism), r["cross_modal_shared_mechanism_penalty"]).when(clash, r["cross_modal_penalty"]).otherwise(0.0) + F.when(metric, 3.5).otherwise(0.0)
    )
    level = F.when(exact, "exact").when(primary & (risk | mechanism | metric), "direct").when(primary, "near").when(risk | mechanism | support, "adjacent").otherwise("analogy")
    note = lambda name, c, n=99: F.concat(F.lit(f"{name}:"), F.array_join(F.slice(c, 1, n), ","))
    both = F.array_distinct(F.concat("_mechanism", "_risk"))
    reasons = F.array(
        F.when(exact, F.lit("exact-slug")), F.when(primary, note("primary", F.col("_primary"))), F.when(support, note("support", F.col("_support"))),
        F.when(risk, note("risk", F.col("_risk"))), F.when(mechanism, note("mechanism", F.col("_mechanism"))),
        F.when(clash & (risk | mechanism), note("cross-domain-mechanism", both, 4)).when(clash, note("cross-modal", F.col("_clash"), 3)), F.when(metric, F.lit("metric")),
    )
    out = df.withColumn("facet", score).withColumn("level", level).withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return out.drop("_primary", "_support", "_risk", "_mechanism", "_clash", "_has_wanted", "_metric", "_exact")


def _quality(intent: str | None) -> Column:
    """`retrieval.source_quality` over the entry struct."""
    return retrieval.source_quality(intent, lambda c: F.col("e")[c])


@dataclass
class Evidence:
    """candidates: fused pools; results: chosen ones and bridges with payloads; coverage: one row a profile. The last two are made when first asked for."""

    profiles: DataFrame
    candidates: DataFrame
    _index: object
    _limit: int

    @cached_property
    def results(self) -> DataFrame:
        return _results(self._index, self.candidates, self._limit)

    @cached_property
    def coverage(self) -> DataFrame:
        return _coverage(self.results, self.profiles)


def retrieve(index, profiles: DataFrame, recall: int = 80, limit: int = 12) -> Evidence:
    """Evidence for every profile from an index (or scan) of `shaped` entries."""
    r = vocab.RANKING
    have = store.kept(prepared(profiles), "profiles")
    lens = store.kept(lens_rows(have), "lenses")
    queries = lens.withColumn("query", F.concat_ws("\n", "profile", "lens"))
    asked = retrieval.query_tokens(queries, "query", F.col("words"))
    found = index.rank(asked, top=max(recall * r["candidate_multiplier"], r["minimum_candidate_pool"]))
    hits = store.kept(found.select("query", "entry", F.col("score").alias("lexical")).join(queries.select("query", "profile", "lens", "weight"), "query"), "hits")
    pairs = hits.select("profile", "entry").distinct().join(have.select("profile", F.struct(*ASKED).alias("p")), "profile").join(_faces(index, hits, have), "entry")
    faced = facet(pairs).select("profile", "entry", "facet", "level", "reasons", F.col("e._identity").alias("identity"))
    both = hits.join(faced, ["profile", "entry"]).withColumn("raw", F.col("lexical") + F.col("facet")).where("raw > 0")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("profile", "lens").orderBy(F.desc(F.round("raw", 9)), "entry"))).where(F.col("rank") <= recall)
    pool = fused(ranked)
    # payloads of a pool only
    size = max(recall, 6 * limit, 40)
    pool = pool.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("final"), "entry"))).where(F.col("place") <= size)
    return Evidence(have, store.kept(pool, "pool"), index, limit)


def _faces(index, hits: DataFrame, have: DataFrame) -> DataFrame:
    """(entry, e) of the hits' entries with what `facet` reads: of its words those of any profile's metric, its text only where an intent asks for it."""
    high = F.lit(not have.where("intent = 'high_score'").isEmpty())
    asked = have.select(F.explode(text.tokens(F.col("metric"))).alias("w")).agg(F.collect_set("w").alias("_asked"))  # one row
    shown = [F.when(high, F.col(c)).alias(c) for c in ("title", "summary")]
    rows = index.entries(hits, "entry", [F.col("id").alias("entry"), *FACED, *shown, "_words"]).crossJoin(F.broadcast(asked))
    return rows.select("entry", F.struct(*FACED, "title", "summary", F.array_intersect("_words", "_asked").alias("_words")).alias("e"))


def fused(ranked: DataFrame) -> DataFrame:
    """Reciprocal ranks summed by profile and identity.

    ranked: profile, lens, weight, entry, identity, rank, raw, level, reasons.
    """
    order = F.array(*map(F.lit, vocab.LEVELS))
    shown = F.struct(F.col("raw"), F.col("entry"), F.col("reasons"))
    g = ranked.groupBy("profile", "identity").agg(
        F.sum(F.col("weight") / (vocab.RANKING["rrf_k"] + F.col("rank"))).alias("rrf"), F.max("raw").alias("raw_max"), F.array_sort(F.collect_set("lens")).alias("lenses"),
        F.min(F.array_position(order, F.col("level"))).cast("int").alias("_level"),
        # of equal scores the smaller id; at most some thirty lenses times the entries of one identity in a pool
        F.array_sort(F.collect_set(shown), lambda a, b: F.when(a["raw"] > b["raw"], -1).when(a["raw"] < b["raw"], 1).when(a["entry"] < b["entry"], -1).when(a["entry"] > b["entry"], 1).otherwise(0)).alias("_by"),
    )
    times = F.element_at(F.array(*[F.lit(vocab.LEVEL_MULTIPLIER[x]) for x in vocab.LEVELS]), F.col("_level"))
    return g.select(
        "profile", "identity", F.get("_by", F.lit(0))["entry"].alias("entry"), F.round((1000 * F.col("rrf") + 6 * F.log1p("raw_max")) * times, 3).alias("final"), "raw_max",
        F.element_at(order, F.col("_level")).alias("level"), "lenses", F.slice(F.array_distinct(F.flatten(F.transform("_by", lambda x: x["reasons"]))), 1, REASONS).alias("reasons"),
    )


def _results(index, pool: DataFrame, limit: int) -> DataFrame:
    wide = index.entries(pool, "entry")
    unknown = F.coalesce(F.nullif("competition_slug", F.lit("")), F.nullif("title", F.lit("")), F.lit("unknown"))
    cand = pool.join(wide.select(F.col("id").alias("entry"), unknown.alias("slug"), F.col("_diverse").alias("tokens")), "entry")
    picked = retrieval.diversify(cand.select("profile", "entry", F.col("final").alias("score"), "level", "slug", "tokens"), "profile", limit)
    picked = store.kept(picked, "picked")
    shared = F.exists("reasons", lambda x: x.startswith("cross-domain-mechanism"))
    # a bridge is no result, and none stands at a result's anchor, competition and source
    spot = wide.select(F.col("id").alias("entry"), F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("anchor", "competition_slug", "source")]).alias("spot"))
    taken = picked.join(spot, "entry").select("profile", "spot").distinct()
    rest = pool.where(shared).join(picked.select("profile", "entry"), ["profile", "entry"], "left_anti").join(spot, "entry")
    rest = rest.join(taken, ["profile", "spot"], "left_anti")
    rest = rest.withColumn("position", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("final"), "entry"))).where(F.col("position") <= vocab.RANKING["mechanism_bridge_limit"])
    named = picked.select("profile", "entry", "position", F.lit("result").alias("kind")).unionByName(rest.select("profile", "entry", "position", F.lit("bridge").alias("kind")))
    named = store.kept(named, "named")
    risky = governance.risk_flags(F.concat_ws(" ", "title", "summary", F.array_join(F.coalesce("trick_highlights", F.array().cast(STRINGS)), " ")))
    filled = {"provenance_status": "unknown", "trust_level": "untrusted_external", "source_license": "unknown", "source_content_sha256": "", "code_evidence_status": "unknown"}
    cut = {c: F.slice(F.coalesce(c, F.array().cast(STRINGS)), 1, PAYLOAD.get(c, 1 << 30)) for c in LISTS}
    cut |= {"summary": F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY)} | {c: F.coalesce(F.nullif(c, F.lit("")), F.lit(v)) for c, v in filled.items()}
    payload = index.entries(named, "entry").select(F.col("id").alias("entry"), *[cut.get(c, F.col(c)).alias(c) for c in [*TEXTS[1:], *LISTS, *NUMBERS]], risky.alias("flags"))
    return named.join(pool.select("profile", "entry", "final", "level", "lenses", "reasons"), ["profile", "entry"]).join(payload, "entry")


def _coverage(results: DataFrame, have: DataFrame) -> DataFrame:
    seen = results.where("kind = 'result'").withColumn("public_link", governance.public_url(F.col("source_url"))).withColumn("slug", F.coalesce(F.nullif("competition_slug", F.lit("")), "title"))
    wants = have.select("profile", F.arrays_overlap("domains", F.array(*map(F.lit, vocab.PRIMARY_DOMAINS))).alias("_p"), (F.size("validation_risks") > 0).alias("_r"))
    return retrieval.coverage(wants.join(seen, "profile", "left"), ["profile"], F.coalesce("_p", F.lit(False)), F.col("_r"))
