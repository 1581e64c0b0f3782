"""Catalog ETL: Markdown books to sections and entries, tier merge, evidence packets, deep dives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import governance, text

#: The headings of books.
_TITLE = r"(?m)^##\s+(\d+\.\s+.+?)(?:\s+\{#([^}]+)\})?\s*$"
_CHAPTER = r"(?m)^#\s+(第\d+章\s+.+?)(?:\s+\{#([^}]+)\})?\s*$"
#: Metadata keys of a list block.
META_KEYS = ["比赛", "来源", "类型", "tricks", "代码证据", "代码证据条数", "质量分"]


def _pieces(body: Column, pattern: str) -> Column:
    """The text cut before each match, with positions: array<struct<start, body>>; what precedes the first match is the first piece."""
    parts = F.split(body, f"(?m)(?={pattern.replace('(?m)', '')})")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, body: string>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc.out, F.array(F.struct(acc["at"].alias("start"), x.alias("body")))).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc.out)


def sections(books: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, ordinal, title, anchor, start, section): numbered `##` headings up to the next one."""
    cut = F.filter(_pieces(body, _TITLE), lambda p: p.body.rlike(f"\\A{_TITLE}"))
    rows = books.select(key, F.posexplode(cut).alias("k", "p")).select(key, (F.col("k") + 1).alias("ordinal"), F.col("p.start").alias("start"), F.col("p.body").alias("section"))
    title = F.trim(F.regexp_extract("section", _TITLE, 1))
    anchor = F.trim(F.regexp_extract("section", _TITLE, 2))
    auto = F.concat(F.lit("auto-section-"), F.col("ordinal").cast("string"), F.lit("-"), text.slugify(title))
    return rows.select(key, "ordinal", title.alias("title"), F.when(anchor != "", anchor).otherwise(auto).alias("anchor"), "start", "section")


def chapters(books: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, start, chapter, chapter_anchor)."""
    cut = F.filter(_pieces(body, _CHAPTER), lambda p: p.body.rlike(f"\\A{_CHAPTER}"))
    rows = books.select(key, F.inline(cut))
    return rows.select(key, "start", F.trim(F.regexp_extract("body", _CHAPTER, 1)).alias("chapter"), F.trim(F.regexp_extract("body", _CHAPTER, 2)).alias("chapter_anchor"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """As-of join: each left row with the values of the last right row of its key at or before it.

    Both sides are sorted together once; there is no pairwise join.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, *values).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("_v", taken).where("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def metadata(section: Column) -> Column:
    """map<key, value> of a section's quoted metadata line, else of its first list items."""
    lines = F.split(section, "\n")
    quoted = F.get(F.filter(lines, lambda x: x.startswith("> ") & x.rlike("比赛[：:]") & x.rlike("来源[：:]")), F.lit(0))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^：:]*)[：:]", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^：:]*[：:](.*)$", 1)).alias("value"))
    chunks = F.filter(F.split(F.substring(quoted, 3, 1 << 20), r"\s*·\s*"), lambda x: x.rlike("[：:]"))
    items = F.filter(F.slice(lines, 1, 40), lambda x: x.rlike(r"^\s*-\s*[^:：]+\s*[:：]\s*.+"))
    listed = F.filter(F.transform(F.transform(items, lambda x: F.regexp_replace(x, r"^\s*-\s*", "")), pair), lambda e: e.key.isin(META_KEYS))
    last = lambda entries: F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f.key == e.key)))
    return F.when(quoted.isNotNull(), last(F.transform(chunks, pair))).otherwise(last(listed))


def summary(section: Column) -> Column:
    own = text.first_labelled(section, "摘要", "essence", "teaching_takeaway")
    block = F.regexp_extract(section, r"(?is)(?:^|\n)[ \t]*#{3,5} summary[ \t]*\n(.*?)(?=\n##### |\z)", 1)
    return F.substring(F.when(own != "", own).otherwise(text.clean_line(block)), 1, 1200)


def tricks(section: Column) -> Column:
    named = F.slice(F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^######\s+\d+\)\s+(.+)$"), F.lit(1)), text.clean_line), 1, 20)
    return F.when(F.size(named) > 0, named).otherwise(F.slice(text.split_list(text.labelled(section, "重点 trick")), 1, 20))


def parse_book(books: DataFrame, key: str, body: Column) -> DataFrame:
    """Catalog entries of Markdown books; sections without 比赛 and 来源 are skipped."""
    rows = as_of(sections(books, key, body), chapters(books, key, body), key, "start", ["chapter", "chapter_anchor"])
    rows = rows.withColumn("meta", metadata(F.col("section"))).withColumn("_m", F.coalesce("meta", F.expr("map()").cast("map<string,string>")))
    get = lambda k: F.coalesce(F.try_element_at(F.col("_m"), F.lit(k)), F.lit(""))
    rows = rows.where((get("比赛") != "") | (get("来源") != ""))
    listed = lambda label: text.split_list(text.labelled(F.col("section"), label))
    url = text.first_labelled(F.col("section"), "source_url", "来源链接")
    return rows.select(
        key, "ordinal", "title", "anchor", "start", F.coalesce("chapter", F.lit("")).alias("chapter"), get("比赛").alias("competition_slug"), text.markdown_link(get("来源")).label.alias("source"),
        get("类型").alias("source_type"), text.parse_int(get("tricks")).alias("tricks_count"), text.parse_int(F.coalesce(F.nullif(get("代码证据"), F.lit("")), get("代码证据条数"))).alias("code_evidence_count"),
        text.parse_int(get("质量分")).alias("quality_score"), listed("algo_tags").alias("algo_tags"), listed("core_keywords").alias("core_keywords"), listed("method_keywords").alias("method_keywords"),
        listed("problem_signals").alias("problem_signals"), text.all_labelled(F.col("section"), "transfer_scenarios").alias("transfer_scenarios"), listed("pattern_families").alias("pattern_families"),
        tricks(F.col("section")).alias("trick_highlights"), summary(F.col("section")).alias("summary"), governance.strip_query(url).alias("source_url"),
    )


def merge_tiers(rows: DataFrame, key: Column, ordinal: str, tier: str, fill: list[str]) -> DataFrame:
    """One row for each key: the first, unless a later curated row replaces a row that is not curated.

    `fill` fields that are empty take the first value found in rows after the winner. Two map-side combinable
    aggregations; a key with many rows is never gathered.
    """
    df = rows.withColumn("_key", key)
    curated = F.col(tier) == "curated"
    rank = F.struct(F.when(curated, 0).otherwise(1).alias("t"), F.col(ordinal).alias("o"))
    winner = df.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), rank).alias("w"))
    later = df.join(winner.select("_key", F.col(f"w.{ordinal}").alias("_from")), "_key").where(F.col(ordinal) > F.col("_from"))
    firsts = [F.min_by(F.when(F.col(f).cast("string") != "", F.col(f)), F.when(F.col(f).cast("string") != "", F.col(ordinal))).alias(f"_f_{f}") for f in fill]
    out = winner.join(later.groupBy("_key").agg(*firsts), "_key", "left")
    filled = lambda f: F.when(F.col(f"w.{f}").isNull() | (F.col(f"w.{f}").cast("string") == ""), F.coalesce(F.col(f"_f_{f}"), F.col(f"w.{f}"))).otherwise(F.col(f"w.{f}")).alias(f)
    return out.select(*[filled(c) if c in fill else F.col(f"w.{c}").alias(c) for c in rows.columns])


def packet(found: DataFrame, order: str, body: str, per_section: int, total: int, head: int = 0) -> DataFrame:
    """Sections that fit a character budget, in order, each cut to its allowance (300 more are counted for each).

    The allowance depends on what is left, so it is a running sum of min(length, per_section) + 300 cut at the end.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one packet's sections: some tens
    used = F.lit(head) + F.coalesce(F.sum(F.least(F.length(body), F.lit(per_section)) + 300).over(w), F.lit(0))
    df = found.withColumn("used_before", used).where(F.col("used_before") < total)
    allowance = F.least(F.lit(per_section), total - F.col("used_before"))
    return df.withColumn("truncated", F.length(body) > allowance).withColumn(body, F.substring(F.col(body), F.lit(1), allowance.cast("int")))


def deep_dives(hits: DataFrame, per_group: int = 3) -> DataFrame:
    """(slug, group_rank, points): hits by competition in order of first appearance, at most so many distinct claims each."""
    first = hits.groupBy("slug").agg(F.min("position").alias("first"))
    claims = hits.select("slug", "position", F.posexplode("trick_highlights").alias("k", "trick")).withColumn("claim", text.normalize(F.col("trick"))).where("claim <> ''")
    claims = claims.groupBy("slug", "claim").agg(F.min_by("trick", F.struct("position", "k")).alias("trick"), F.min(F.struct("position", "k")).alias("o"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("o"))
    kept = claims.withColumn("n", n).where(F.col("n") <= per_group)
    points = kept.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "trick"))), lambda x: x.trick).alias("points"))
    rank = F.row_number().over(Window.orderBy("first"))  # one row a competition among a result's hits
    return first.withColumn("group_rank", rank).join(points, "slug", "left").select("slug", "group_rank", F.coalesce("points", F.array().cast("array<string>")).alias("points"))
