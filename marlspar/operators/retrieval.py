"""Hybrid retrieval: weighted BM25 by lens, facet rerank, reciprocal-rank fusion, diversification, coverage.

Tables: `postings(entry, token, tf)` with field-weighted term frequencies; `lenses(lens, weight, text)`. Every order has
the entry id as its last key, so results do not depend on partitioning. Query sides are small and joined by
broadcast only after their size is bounded by `MAX_QUERY_TOKENS`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer, text, vocab

K1, B, QUERY_FACTOR = 1.3, 0.72, 0.15
#: Distinct query tokens that are broadcast at most; above, the postings join shuffles.
MAX_QUERY_TOKENS = 200_000
#: Characters by which `holding` looks heads up.
KEY = 8


def entry_fields() -> Column:
    """array<struct<text, weight>> of a catalog entry; list fields are joined by spaces."""
    lists = {"algo_tags", "core_keywords", "method_keywords", "problem_signals", "transfer_scenarios", "pattern_families", "trick_highlights"}
    part = lambda n: F.array_join(F.coalesce(F.col(n), F.array().cast("array<string>")), " ") if n in lists else F.coalesce(F.col(n), F.lit(""))
    return F.array(*[F.struct(part(n).alias("text"), F.lit(w).alias("weight")) for n, w in vocab.ENTRY_FIELD_WEIGHTS.items()])


def postings(rows: DataFrame, entry: str, fields: Column) -> DataFrame:
    """(entry, token, tf): per entry the sum over fields of weight times count; partly summed before the shuffle."""
    long = rows.select(F.col(entry).alias("entry"), F.explode(fields).alias("f"))
    return long.select("entry", F.explode(text.tokens(F.col("f.text"))).alias("token"), F.col("f.weight").alias("w")).groupBy("entry", "token").agg(F.sum("w").alias("tf"))


def bm25(post: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(query, entry, score, rank) with score > 0; queries has (query, token, qtf).

    Document length, document frequency and size come from the postings; `top` keeps the best of each query.
    """
    lengths = post.groupBy("entry").agg(F.sum("tf").alias("dl"))
    size = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))
    small = queries.limit(MAX_QUERY_TOKENS + 1).count() <= MAX_QUERY_TOKENS
    side = F.broadcast(queries) if small else queries
    wanted = F.broadcast(queries.select("token").distinct()) if small else queries.select("token").distinct()
    df = post.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = post.join(side, "token").join(df, "token").join(lengths, "entry").join(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))
    part = idf * F.col("tf") * (K1 + 1) / norm * (1 + QUERY_FACTOR * F.log1p(F.col("qtf")))
    scored = hits.groupBy("query", "entry").agg(F.sum(part).alias("score")).where("score > 0")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entry")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def tokenised(rows: DataFrame, entry: str, fields: Column) -> DataFrame:
    """(entry, fields: array<struct<tokens, weight>>), one row an entry; the input of `bm25_scan`, to be kept if read again."""
    return rows.select(F.col(entry).alias("entry"), F.transform(fields, lambda f: F.struct(text.tokens(f.text).alias("tokens"), f.weight.cast("double").alias("weight"))).alias("fields"))


def _counted(batch: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted length of each row, and (row, token number, weighted count) of the tokens among `words`."""
    fields = batch.column("fields")
    parts = fields.flatten()
    row = np.repeat(np.arange(len(fields)), pc.fill_null(pc.list_value_length(fields), 0).to_numpy(zero_copy_only=False))
    tokens, weight = parts.field("tokens"), parts.field("weight").to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    number = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, weight = np.repeat(row, size), np.repeat(weight, size)
    length = np.bincount(row, weights=weight, minlength=len(fields))
    row, number, weight = row[number >= 0], number[number >= 0], weight[number >= 0]
    key, back = np.unique(row * len(words) + number, return_inverse=True)
    return length, key // max(1, len(words)), key % max(1, len(words)), np.bincount(back, weights=weight, minlength=len(key))


def query_blocks(token: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, tokens: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, weights of its own tokens by query, own number of each token) of runs of 256 queries, as small matrices."""
    blocks = []
    for q in range(0, queries, 256):
        mine = np.flatnonzero((query >= q) & (query < q + 256))
        own, column = np.unique(token[mine], return_inverse=True)
        table = np.zeros((len(own), min(256, queries - q)))
        table[column, query[mine] - q] = weight[mine]
        number = np.full(tokens, -1, np.int64)
        number[own] = np.arange(len(own))
        blocks.append((q, table, number))
    return blocks


def keep_best(best: dict[int, list], blocks: list, entries: pa.Array, row: np.ndarray, number: np.ndarray, part: np.ndarray, top: int) -> None:
    """Scores entries (postings: row, number of the token, part) against all queries and keeps the best `top` of each.

    best: query to its (-rounded score, entry, score) in order.
    """
    order = np.argsort(row, kind="stable")
    row, number, part = row[order], number[order], part[order]
    for q, table, column in blocks:
        step = max(1, (1 << 21) // max(1, table.shape[0]))
        for a in range(0, len(entries), step):
            span = slice(*np.searchsorted(row, [a, a + step]))
            at = column[number[span]]
            some = at >= 0
            dense = np.zeros((min(step, len(entries) - a), table.shape[0]))
            dense[row[span][some] - a, at[some]] = part[span][some]
            scores = dense @ table
            # ties at the edge stay for the merge
            floor = np.array([-best[q + k][-1][0] - 1e-8 if len(best.get(q + k, ())) >= top else 0.0 for k in range(scores.shape[1])])
            for k in np.flatnonzero((scores.max(axis=0) > 0) & (scores.max(axis=0) >= floor)).tolist():
                hit = np.flatnonzero((scores[:, k] > 0) & (scores[:, k] >= floor[k]))
                if len(hit) > top:
                    edge = np.partition(scores[hit, k], len(hit) - top)[len(hit) - top]
                    hit = hit[scores[hit, k] >= edge - 1e-8]
                ids = entries.take(pa.array(hit + a)).to_pylist()
                found = [(-round(float(s), 9), e, float(s)) for e, s in zip(ids, scores[hit, k], strict=True)]
                best[q + k] = heapq.nsmallest(top, [*best.get(q + k, []), *found])


def bm25_scan(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """`bm25` with the best `top` entries of each query, from `tokenised` rows, without a row for each pair.

    Up to MAX_QUERY_TOKENS rows of queries go to every task. One pass counts documents by query token; another scores
    each batch against all queries as products of small matrices and keeps the best of each query, so that a task hands
    on `top` rows a query at most, and the last step merges those. Larger sets of queries take the join of `bm25`.
    """
    asked = queries.select("query", "token", "qtf").limit(MAX_QUERY_TOKENS + 1).collect()
    if len(asked) > MAX_QUERY_TOKENS:
        long = rows.select("entry", F.explode("fields").alias("f")).select("entry", F.explode("f.tokens").alias("token"), F.col("f.weight").alias("w"))
        return bm25(long.groupBy("entry", "token").agg(F.sum("w").alias("tf")), queries, top)
    names = [*dict.fromkeys(r["query"] for r in asked)]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(r["token"] for r in asked))}
    place = {n: k for k, n in enumerate(names)}
    words = pa.array([*vocabulary], pa.string())
    schema = queries.schema["query"].dataType.simpleString(), rows.schema["entry"].dataType.simpleString()
    if not asked:
        return rows.sparkSession.createDataFrame([], f"query {schema[0]}, entry {schema[1]}, score double, rank int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(words), np.int64), 0, 0.0
        for batch in batches:
            length, _, number, _ = _counted(batch, words)
            df += np.bincount(number, minlength=len(words))
            n, total = n + int((length > 0).sum()), total + float(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1]), pa.array([*df[some].tolist(), n]), pa.array([0.0] * len(some) + [total])], ["token", "n", "total"])

    sums = {r["token"]: r for r in rows.mapInArrow(count, "token long, n long, total double").groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n_docs, mean = sums[-1]["n"] if -1 in sums else 0, 1.0
    if n_docs:
        mean = max(1.0, sums[-1]["total"] / n_docs)
    df = np.array([sums[k]["n"] if k in sums else 0 for k in range(len(words))], np.float64)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    at = np.array([(vocabulary[r["token"]], place[r["query"]], r["qtf"]) for r in asked], np.int64)
    side = rows.sparkSession.sparkContext.broadcast((at, idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (token, query, qtf), weight = side.value[0].T, side.value[1]
        blocks = query_blocks(token, query, (1 + QUERY_FACTOR * np.log1p(qtf)) * weight[token], len(names), len(weight))
        best: dict[int, list] = {}
        for batch in batches:
            length, row, number, tf = _counted(batch, words)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
            keep_best(best, blocks, batch.column("entry"), row, number, part, top)
        out = [(names[k], e, s) for k, found in best.items() for _, e, s in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query", "entry", "score"])

    scored = rows.where("entry is not null").mapInArrow(score, f"query {schema[0]}, entry {schema[1]}, score double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entry")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def query_tokens(rows: DataFrame, query: str, text_col: Column) -> DataFrame:
    return rows.select(F.col(query).alias("query"), F.explode(text.tokens(text_col)).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("qtf"))


def lenses(profile: dict, custom: list[str] | None = None) -> list[tuple[str, str, float, list[str]]]:
    """(name, text, weight, domains) of a profile's query lenses; those without tokens are dropped.

    profile: slug, title, description, metric, metric_family, data, stage, domains, mechanisms, validation_risks.
    """
    get = lambda k: profile.get(k) or ""
    w, add, domains, stage = vocab.LENS_WEIGHTS, vocab.LENS_WORDS, list(profile.get("domains") or []), profile.get("stage") or "intake"
    risks, mechanisms = profile.get("validation_risks") or [], profile.get("mechanisms") or []
    own = list(dict.fromkeys(q.strip() for q in custom or [] if q.strip()))[: vocab.RANKING["max_custom_queries"]]
    common = " ".join([get("title"), get("description"), get("metric"), get("data"), " ".join(own)]).strip()
    primary = [d for d in domains if d in vocab.PRIMARY_DOMAINS][:2]
    plus = lambda *more: list(dict.fromkeys([*domains, *more]))
    out = [(f"user_query_{k:02d}", q, w["user_query"], domains) for k, q in enumerate(own, 1)]
    if get("slug"):
        out.append(("exact_competition", get("slug"), w["exact_competition"], domains))
    out.append(("task_shape", common, w["task_shape"], domains))
    if primary:
        words = " ".join(" ".join(vocab.DOMAINS[d]) for d in primary)
        out.append(("modality_transfer", f"{common} {words}", w["modality_transfer"], primary))
    if get("metric"):
        out.append(("metric_behavior", f"{get('metric')} {get('metric_family')} {add['metric_behavior']}", w["metric_behavior"], domains))
    if risks:
        out.append(("validation_risk", f"{common} {' '.join(risks)} {add['validation_risk']}", w["validation_risk"], plus("feature", "system")))
    if risks or mechanisms:
        words = " ".join([*mechanisms, *risks])
        out.append(("mechanism_transfer", f"{words} {add['mechanism_transfer']}", w["mechanism_transfer"], sorted(vocab.SUPPORT_DOMAINS)))
    by_stage = {
        "data_and_validation_gate": (("intake", "eda"), ("feature", "system")),
        "reliable_baseline": (("baseline",), ("system",)),
        "final_inference": (("finalize",), ("system",)),
    }
    for name, (stages, more) in by_stage.items():
        if stage in stages:
            out.append((name, f"{common} {add[name]}", w[name], plus(*more)))
    out.append(("implementation", f"{common} {add['implementation']}", w["implementation"], domains))
    late = "ensemble_stage" if stage == "ensemble" else "ensemble_intake" if stage in ("intake", "eda", "baseline") else "ensemble_improve"
    out.append(("ensemble_late_game", f"{common} {add['ensemble_late_game']}", w[late], plus("ensemble")))
    return [x for x in out if text.tokens_py(x[1])]


def source_quality(intent: str | None = None, column=F.col) -> Column:
    """Points of an entry's source; column(name) gives its columns."""
    c = lambda n: F.coalesce(column(n).cast("double"), F.lit(0.0))
    code, tricks = F.least(c("code_evidence_count"), F.lit(20.0)), F.least(c("tricks_count"), F.lit(20.0))
    tier = F.when(column("catalog_tier") == "curated", vocab.RANKING["curated_bonus"]).when(column("catalog_tier") == "learned", vocab.RANKING["learned_bonus"]).otherwise(0.0)
    out = F.log1p(F.greatest(c("quality_score"), F.lit(0.0))) * 0.55 + code * 0.08 + tricks * 0.06 + tier
    kind = text.normalize(column("source_type"))
    if intent == "code":
        out = out + code * 0.22 + F.when(kind.contains("analysis"), 1.0).otherwise(0.0)
    elif intent == "strategy":
        out = out + tricks * 0.14 + F.when(kind.contains("writeup"), 1.2).otherwise(0.0)
    elif intent == "high_score":
        words = text.normalize(F.concat_ws(" ", column("title"), column("summary")))
        for p in vocab.HIGH_SCORE_PHRASES:
            out = out + F.when(text.has_phrase(words, p), 1.2).otherwise(0.0)
    return out


def facets(entries: DataFrame, profile: dict, intent: str | None = None) -> DataFrame:
    """Adds facet (score), level and reasons of each entry against one profile."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    risks, mechanisms = profile.get("validation_risks") or [], profile.get("mechanisms") or []
    whole = F.concat_ws(" ", F.transform(entry_fields(), lambda f: f.text))
    df = entries.withColumn("_set", F.array_distinct(text.tokens(whole))).withColumn("_chapter", F.array_distinct(text.tokens(F.col("chapter"))))
    df = df.withColumn("_scores", infer.entry_domain_scores(F.col("_set"), F.col("_chapter")))
    df = df.withColumn("_own", F.map_keys(F.map_filter("_scores", lambda _, v: v >= 2)))
    held = lambda names, table: F.array_intersect(lit(names), text.names_held(F.col("_set"), {n: table.get(n, []) for n in names}))
    wanted = lit(profile.get("domains") or [])
    wanted_primary = F.array_intersect(wanted, lit(vocab.PRIMARY_DOMAINS))
    df = df.withColumn("_primary", F.array_sort(F.array_intersect(wanted_primary, F.col("_own"))))
    df = df.withColumn("_support", F.array_sort(F.array_intersect(F.array_intersect(wanted, F.col("_own")), lit(vocab.SUPPORT_DOMAINS))))
    df = df.withColumn("_risks", held(risks, vocab.RISKS)).withColumn("_mechanisms", held(mechanisms, vocab.MECHANISMS))
    df = df.withColumn("_clash", F.array_sort(F.array_except(F.array_intersect(F.col("_own"), lit(vocab.PRIMARY_DOMAINS)), wanted_primary)))
    slug = text.normalize(F.lit(profile.get("slug") or ""))
    exact = (slug != "") & (slug == text.normalize(F.col("competition_slug")))
    metric_tokens = text.tokens_py(profile.get("metric") or "")
    metric = F.arrays_overlap(F.col("_set"), lit(metric_tokens)) if metric_tokens else F.lit(False)
    has_p, has_s, has_r, has_m = (F.size(c) > 0 for c in ("_primary", "_support", "_risks", "_mechanisms"))
    clash = (F.size(wanted_primary) > 0) & ~has_p & (F.size("_clash") > 0)
    gained = F.aggregate("_primary", F.lit(0.0), lambda acc, d: acc + F.least(F.try_element_at(F.col("_scores"), d), F.lit(8)) * 0.55)
    r = vocab.RANKING
    score = (
        source_quality(intent)
        + F.when(exact, 70.0).otherwise(0.0)
        + F.when(has_p, 8.0 + gained).otherwise(0.0)
        + F.when(has_s, 2.5 + F.size("_support")).otherwise(0.0)
        + r["risk_bonus"] * F.size("_risks")
        + r["mechanism_bonus"] * F.size("_mechanisms")
        - F.when(clash & (has_r | has_m), r["cross_modal_shared_mechanism_penalty"]).when(clash, r["cross_modal_penalty"]).otherwise(0.0)
        + F.when(metric, 3.5).otherwise(0.0)
    )
    level = F.when(exact, "exact").when(has_p & (has_r | has_m | metric), "direct").when(has_p, "near").when(has_r | has_m | has_s, "adjacent").otherwise("analogy")
    note = lambda name, c, n=99: F.concat(F.lit(f"{name}:"), F.array_join(F.slice(c, 1, n), ","))
    bridge = F.array_distinct(F.concat("_mechanisms", "_risks"))
    reasons = F.array(
        F.when(exact, F.lit("exact-slug")), F.when(has_p, note("primary", F.col("_primary"))), F.when(has_s, note("support", F.col("_support"))),
        F.when(has_r, note("risk", F.col("_risks"))), F.when(has_m, note("mechanism", F.col("_mechanisms"))),
        F.when(clash & (has_r | has_m), note("cross-domain-mechanism", bridge, 4)).when(clash, note("cross-modal", F.col("_clash"), 3)), F.when(metric, F.lit("metric")),
    )
    df = df.withColumn("facet", score).withColumn("level", level).withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return df.drop("_set", "_chapter", "_scores", "_own", "_primary", "_support", "_risks", "_mechanisms", "_clash")


def fuse(ranked: DataFrame, keys: list[str], k: float = vocab.RANKING["rrf_k"]) -> DataFrame:
    """Reciprocal-rank fusion of (lens, weight, entry, rank, score[, level]) by keys and entry; final is the scaled score."""
    order = F.array(*map(F.lit, vocab.LEVELS))
    level = F.col("level") if "level" in ranked.columns else F.lit("adjacent")
    g = ranked.groupBy(*keys, "entry").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"), F.max("score").alias("raw_max"), F.array_sort(F.collect_set("lens")).alias("lenses"),
        F.min(F.array_position(order, level)).cast("int").alias("_level"),
    )
    times = F.element_at(F.array(*[F.lit(vocab.LEVEL_MULTIPLIER[x]) for x in vocab.LEVELS]), F.col("_level"))
    final = F.round((1000 * F.col("rrf") + 6 * F.log1p("raw_max")) * times, 3)
    return g.withColumn("final", final).withColumn("level", F.element_at(order, F.col("_level"))).drop("_level")


def pool_scores(pool: DataFrame, post: DataFrame, queries: DataFrame) -> DataFrame:
    """Second recall mode: one pool, reranked per lens by token overlap: .25 pool + overlap + 4 overlap / all."""
    total = queries.groupBy("query").agg(F.sum(1 + F.log1p("qtf")).alias("all"))
    hit = post.join(pool.select("entry", F.col("score").alias("pool")), "entry").join(queries, "token")
    g = hit.groupBy("query", "entry", "pool").agg(F.sum(1 + F.log1p("qtf")).alias("overlap")).join(total, "query")
    return g.select("query", "entry", (0.25 * F.col("pool") + F.col("overlap") + 4 * F.col("overlap") / F.col("all")).alias("lexical"))


def diversify(candidates: DataFrame, group: str, limit: int) -> DataFrame:
    """Greedy maximal marginal relevance within each group: (group, entry, position).

    candidates: group, entry, score, level, slug, tokens (array<string>); a group's candidates are a bounded pool, so one
    group is one task's work.
    """
    schema = f"{group} {candidates.schema[group].dataType.simpleString()}, entry {candidates.schema['entry'].dataType.simpleString()}, position int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "entry"], ascending=[False, True]).to_dict("records")
        best = max((r["score"] for r in rows), default=0) or 1.0
        sets, chosen, used = [set(r["tokens"]) for r in rows], [], {}
        near = [0.0] * len(rows)
        left = list(range(len(rows)))
        while left and len(chosen) < limit:
            value = lambda i: 0.78 * rows[i]["score"] / best + 0.22 * (1 - near[i]) + vocab.LEVEL_BONUS[rows[i]["level"]] - 0.13 * used.get(rows[i]["slug"], 0)
            at = max(left, key=lambda i: (value(i), -i))
            left.remove(at)
            chosen.append(at)
            used[rows[at]["slug"]] = used.get(rows[at]["slug"], 0) + 1
            for i in left:
                if sets[i] and sets[at]:
                    near[i] = max(near[i], len(sets[i] & sets[at]) / len(sets[i] | sets[at]))
        return pd.DataFrame({group: [rows[i][group] for i in chosen], "entry": [rows[i]["entry"] for i in chosen], "position": range(1, len(chosen) + 1)})

    return candidates.groupBy(group).applyInPandas(pick, schema)


def bridges(candidates: DataFrame, selected: DataFrame, limit: int = vocab.RANKING["mechanism_bridge_limit"]) -> DataFrame:
    """The best candidates that were not selected and share a mechanism across domains."""
    shared = F.exists("reasons", lambda r: r.startswith("cross-domain-mechanism"))
    return candidates.join(selected.select("entry"), "entry", "left_anti").where(shared).orderBy(F.desc("final"), "entry").limit(limit)


def coverage(hits: DataFrame, keys: list[str], has_primary: Column, risks_wanted: Column) -> DataFrame:
    """Conditional counts, confidence and gaps of the selected hits, by keys.

    hits: level, code_evidence_count, code_evidence_status, source_type, reasons, public_link, provenance_status, flags, slug.
    """
    code = F.coalesce(F.col("code_evidence_count"), F.lit(0)) > 0
    cited = F.coalesce(F.col("code_evidence_status") == "cited", F.lit(False))
    g = hits.groupBy(*keys).agg(
        F.count_if(F.col("level").isin("exact", "direct", "near")).alias("direct_or_near"), F.count_if(code & cited).alias("code_hits"), F.count_if(code & ~cited).alias("derived_code_claim_hits"),
        F.count_if(F.contains(text.normalize(F.col("source_type")), F.lit("writeup"))).alias("writeup_hits"), F.count_if(F.exists("reasons", lambda r: r.startswith("risk:"))).alias("validation_hits"),
        F.count_if("public_link").alias("source_link_hits"), F.count_if(F.col("provenance_status") == "reviewed").alias("reviewed_hits"), F.count_if(F.size("flags") > 0).alias("risk_flagged_hits"),
        F.count_distinct("slug").alias("unique_competitions"), F.max(has_primary).alias("_primary"), F.max(risks_wanted).alias("_risks"),
    )
    c = F.col
    covered = (c("validation_hits") >= 1) | ~c("_risks")
    high = (c("direct_or_near") >= 4) & (c("code_hits") >= 2) & (c("source_link_hits") >= 4) & (c("unique_competitions") >= 4) & covered
    medium = (c("direct_or_near") >= 2) & (c("unique_competitions") >= 2) & c("_primary")
    gaps = [
        (c("code_hits") == 0, "no hash-cited code evidence in selected hits"), (c("source_link_hits") == 0, "no public source link in selected hits"),
        (c("writeup_hits") == 0, "no write-up evidence in selected hits"), (~covered, "validation risks are not covered by retrieved evidence"),
        (c("direct_or_near") < 2, "too few direct or near-domain cases"),
    ]
    out = g.withColumn("confidence", F.when(high, "high").when(medium, "medium").otherwise("low"))
    return out.withColumn("gaps", F.filter(F.array(*[F.when(t, F.lit(x)) for t, x in gaps]), lambda x: x.isNotNull())).drop("_primary", "_risks")


def _local(df: DataFrame) -> DataFrame:
    """A table of a bounded number of rows, made once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def retrieve(entries: DataFrame, profile: dict, queries: list[str] | None = None, intent: str | None = None, recall: int = 80, limit: int = 12) -> DataFrame:
    """The flagship pipeline: (position, entry, final, level, reasons, lenses) for one profile; entries have `id`."""
    spark = entries.sparkSession
    specs = lenses(profile, queries)
    table = spark.createDataFrame([(n, t, float(w)) for n, t, w, _ in specs], "query string, text string, weight double")
    hits = bm25_scan(tokenised(entries, "id", entry_fields()), query_tokens(table, "query", F.col("text")), top=max(2 * recall, vocab.RANKING["minimum_candidate_pool"]))
    # facets of what the search returned only: some thirty lenses times their pool, whatever the catalog's size
    hits = _local(hits)
    named = F.broadcast(hits.select(F.col("entry").alias("id")).distinct())
    scored = _local(facets(entries.join(named, "id", "left_semi"), profile, intent).select(F.col("id").alias("entry"), "facet", "level", "reasons", "title", "competition_slug"))
    both = hits.join(scored, "entry").withColumn("raw", F.col("score") + F.col("facet")).where("raw > 0").join(F.broadcast(table.select("query", "weight")), "query")
    order = Window.partitionBy("query").orderBy(F.desc("raw"), "entry")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= recall)
    fused = fuse(ranked.select(F.col("query").alias("lens"), "weight", "entry", "rank", F.col("raw").alias("score"), "level"), [])
    pool = _local(fused.orderBy(F.desc("final"), "entry").limit(max(recall, 6 * limit, 40)))  # wide columns only for these
    few = F.broadcast(pool.select(F.col("entry").alias("id")))
    words = F.array_distinct(text.tokens(F.concat_ws(" ", F.transform(entry_fields(), lambda f: f.text))))
    wide = entries.join(few, "id", "left_semi").select(F.col("id").alias("entry"), F.coalesce(F.nullif("competition_slug", F.lit("")), "title", F.lit("unknown")).alias("slug"), words.alias("tokens"))
    cand = pool.join(wide, "entry").select(F.lit(1).alias("one"), "entry", F.col("final").alias("score"), "level", "slug", "tokens")
    chosen = diversify(cand, "one", limit).drop("one")
    return chosen.join(pool, "entry").join(scored.select("entry", "reasons", "title", "competition_slug"), "entry").select("position", "entry", "final", "level", "reasons", "lenses", "title", "competition_slug")


def experiments(hits: DataFrame, stage: str, budget: str = "standard", allowed: DataFrame | None = None) -> DataFrame:
    """(ordinal, priority, component, cost, trick, anchor, slug): P0 first, then tricks of the hits under quotas.

    hits: position, anchor, competition_slug, level, trick_highlights; a result list of at most some tens of rows, so
    the two greedy passes run as one group. allowed: (slug, claim) pairs with normalised claims.
    """
    most = {"quick": 5, "standard": 8, "deep": 12}.get(budget, 8)
    long = hits.select("position", F.coalesce("anchor", F.lit("unknown")).alias("anchor"), F.coalesce("competition_slug", F.lit("")).alias("slug"), "level", F.posexplode("trick_highlights").alias("k", "trick"))
    long = long.withColumn("claim", text.normalize(F.col("trick"))).where(F.length("claim") >= 12)
    if allowed is not None:
        long = long.join(allowed, ["slug", "claim"], "left_semi")
    long = long.withColumn("component", infer.component(F.col("trick"))).withColumn("cost", infer.cost(F.col("trick")))
    if stage in ("intake", "eda", "baseline"):
        long = long.where("component <> 'ensemble'")
    if budget == "quick":
        long = long.where("cost <> 'high'")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.sort_values(["position", "k"]).to_dict("records")]
        out = [(0, "P0", "validation", "low", None, None, None)]
        seen, parts, sources = set(), {}, {}
        for quota in (1, 2):
            for position in sorted({r["position"] for r in rows}):
                for r in (r for r in rows if r["position"] == position):
                    if len(out) >= most or sources.get(r["anchor"], 0) >= quota:
                        break
                    if r["claim"] in seen or parts.get(r["component"], 0) >= 2:
                        continue
                    seen.add(r["claim"])
                    parts[r["component"]] = parts.get(r["component"], 0) + 1
                    sources[r["anchor"]] = sources.get(r["anchor"], 0) + 1
                    out.append((len(out), "P1" if r["level"] in ("exact", "direct") else "P2", r["component"], r["cost"], r["trick"], r["anchor"], r["slug"]))
                    break
        yield pd.DataFrame(out, columns=["ordinal", "priority", "component", "cost", "trick", "anchor", "slug"])

    return long.coalesce(1).mapInPandas(pick, "ordinal int, priority string, component string, cost string, trick string, anchor string, slug string")


def holding(rows: DataFrame, key: str, body: str, heads: list[str]) -> DataFrame:
    """(key, head) of each text in column `body` that holds a head, once, whatever the place.

    One pass over a text: places whose next KEY characters have the hash of a head's are compared with those heads. The
    heads go to every task; they are a benchmark's, not the catalog's.
    """
    by: dict[str, list[str]] = {}
    for h in dict.fromkeys(heads):
        by.setdefault(h[:KEY], []).append(h)
    brief = [h for h in by if len(h) < KEY]

    def hashes(t: str) -> np.ndarray:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(c) - KEY + 1, np.uint32)
        for k in range(KEY):
            out *= np.uint32(2654435761)
            out += c[k : len(out) + k]
        return out >> np.uint32(14)

    marked = np.zeros(1 << 18, bool)
    for h in by:
        if len(h) == KEY:
            marked[hashes(h)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                if t is None:
                    continue
                own = {h for h in brief if h in t}
                if len(t) >= KEY:
                    for k in np.flatnonzero(marked[hashes(t)]).tolist():
                        own.update(h for h in by.get(t[k : k + KEY], ()) if t.startswith(h, k))
                at += [n] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [key, "head"])

    return rows.select(key, body).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, head string")


def evaluate(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """mrr and recall@k over the cases that expect something; ranked: case, item, rank; expected: case, item."""
    first = expected.join(ranked, ["case", "item"], "left").groupBy("case").agg(F.min("rank").alias("first"))
    return first.agg(
        F.round(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("mrr"),
        F.round(F.count_if(F.col("first") <= k) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("recall_at_k"), F.count(F.lit(1)).alias("n_cases"),
    )
