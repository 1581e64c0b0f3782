"""Text normalisation, tokens and small parsers as Column expressions (no UDFs)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

CJK = "\\u4e00-\\u9fff"


#: The characters of Unicode's White_Space property but the space itself.
WHITE_SPACE = "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_line(c: Column) -> Column:
    """White space (any Unicode) collapsed and trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def _without_urls(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)https?://\S+", " ")


def normalize(c: Column) -> Column:
    """Lower case without URLs, `_` and `-` as spaces, white space collapsed."""
    c = _without_urls(c)
    return F.trim(F.regexp_replace(F.translate(c, "_-" + WHITE_SPACE, " " * (2 + len(WHITE_SPACE))), " {2,}", " "))


def tokens(c: Column) -> Column:
    """ASCII tokens, then of each CJK run the run itself (2 to 12 long), its 2-grams and its 3-grams; no stopwords."""
    # no token holds what `normalize` changes beyond that, so the slow mapping of characters is left out
    t = _without_urls(c)

    def grams(run: Column, width: int) -> Column:
        n = F.length(run) - width + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))

    def expand(run: Column) -> Column:
        own = F.when(F.length(run).between(2, 12), F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(own, grams(run, 2), grams(run, 3))

    found = F.concat(
        F.regexp_extract_all(t, F.lit("[a-z0-9][a-z0-9+#.]{1,}"), F.lit(0)),
        F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), expand)),
    )
    # a literal list of this length becomes a hash set
    return F.filter(found, lambda x: ~x.isin(vocab.STOPWORDS) & (F.length(x) > 1))


def fts_tokens(c: Column) -> Column:
    """Distinct tokens of letters and digits, in order of first use."""
    bare = F.transform(tokens(c), lambda x: F.regexp_replace(F.lower(x), f"[^a-z0-9{CJK}]+", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > 1))


def normalize_py(text: str) -> str:
    """`normalize` for a vocabulary phrase."""
    text = re.sub(r"https?://\S+", " ", text.lower()).replace("_", " ").replace("-", " ")
    return re.sub(r"\s+", " ", text).strip()


def phrase_pattern(phrase: str) -> str:
    """A pattern (for Java and RE2) that finds a phrase in normalised text: CJK anywhere, else between boundaries."""
    p = normalize_py(phrase)
    if re.search(f"[{CJK}]", p):
        return re.escape(p).replace(r"\ ", " ")
    body = re.sub(r"([^\w\s@])", r"\\\1", p).replace(" ", r"\s+")
    return f"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)"


def has_phrase(normalized: Column, phrase: str) -> Column:
    return normalized.rlike(phrase_pattern(phrase)) if normalize_py(phrase) else F.lit(False)


def has_any(normalized: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(normalized, p)
    return out


def tokens_py(phrase: str) -> list[str]:
    """`tokens` for a vocabulary phrase."""
    t = normalize_py(phrase)
    out = re.findall(r"[a-z0-9][a-z0-9+#.]+", t)
    for run in re.findall(f"[{CJK}]+", t):
        out += [run] * (2 <= len(run) <= 12) + [run[i : i + w] for w in (2, 3) for i in range(len(run) - w + 1)]
    return [x for x in out if x not in vocab.STOPWORDS and len(x) > 1]


def holds_tokens(token_set: Column, phrase: str) -> Column:
    """All tokens of the phrase (at least one) are in the set."""
    own = sorted(set(tokens_py(phrase)))
    return F.size(F.array_except(F.array(*map(F.lit, own)), token_set)) == 0 if own else F.lit(False)


def constant(value: object, kind: str) -> Column:
    """A nested literal as one expression, whatever its size; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def held(token_set: Column, phrases: Column) -> Column:
    """Those of an array of token lists of which the set has every token."""
    return F.filter(phrases, lambda p: F.size(F.array_except(p, token_set)) == 0)


def among(token_set: Column, lists: list[list[str]], use: Callable[[Column], Column]) -> Column:
    """`use` of the set's tokens that occur in the lists: each test of a list reads these few, not the whole set."""
    own = F.array_intersect(constant(sorted({t for x in lists for t in x}), "array<string>"), token_set)
    return F.get(F.transform(F.array(own), use), F.lit(0))  # a bound value


def names_held(token_set: Column, table: dict[str, list[str]]) -> Column:
    """Names of a table with a phrase (of one token at least) whose tokens are all in the set, in the table's order."""
    rows = [{"name": n, "phrases": [t for p in phrases if (t := sorted(set(tokens_py(p))))]} for n, phrases in table.items()]
    known = constant(rows, "array<struct<name: string, phrases: array<array<string>>>>")
    names = lambda own: F.transform(F.filter(known, lambda x: F.size(held(own, x["phrases"])) > 0), lambda x: x["name"])
    return among(token_set, [t for r in rows for t in r["phrases"]], names)


def slugify(c: Column) -> Column:
    """Lower case without a leading number, other characters as single dashes, 80 characters, or `section`."""
    s = F.regexp_replace(F.lower(text_or_empty(c)), r"^\s*\d+\.\s*", "")
    s = F.regexp_replace(s, f"[^a-z0-9{CJK}]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 80), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("section"))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), "[,，、]"), lambda x: F.trim(x)), lambda x: x != "")


def markdown_link(c: Column) -> Column:
    """(label, url) of `[label](url)`, else (text, '')."""
    label, url = (F.regexp_extract(c, r"\[([^\]]+)\]\(([^)]+)\)", k) for k in (1, 2))
    return F.struct(F.when(url != "", label).otherwise(F.trim(text_or_empty(c))).alias("label"), url.alias("url"))


def parse_int(c: Column) -> Column:
    """The first run of digits, commas dropped; null if none."""
    return F.nullif(F.regexp_extract(F.replace(text_or_empty(c), F.lit(","), F.lit("")), r"\d+", 0), F.lit("")).try_cast("int")


def labelled(section: Column, label: str) -> Column:
    """Value of the first `- label: value` line (ASCII or full-width colon), or ''."""
    return F.trim(F.regexp_extract(section, rf"(?m)^\s*-+\s*{re.escape(label)}\s*[:：]\s*(.+)$", 1))


def first_labelled(section: Column, *labels: str) -> Column:
    return F.coalesce(*[F.nullif(labelled(section, x), F.lit("")) for x in labels], F.lit(""))


def all_labelled(section: Column, label: str, limit: int = 30) -> Column:
    found = F.regexp_extract_all(section, F.lit(rf"(?mi)^\s*-+\s*{re.escape(label)}\s*[:：]\s*(.+)$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")), 1, limit)


def compact(c: Column, limit: int = 2400) -> Column:
    return F.substring(clean_line(c), 1, limit)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(text_or_empty(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.rtrim(F.replace(text_or_empty(c), F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)


def identity(*parts: Column) -> Column:
    """Normalised parts joined by `|`."""
    return F.concat_ws("|", *[F.lower(clean_line(p)) for p in parts])


def entry_key(slug: Column, source: Column, title: Column, source_type: Column, anchor: Column, entry_id: Column) -> Column:
    first = [normalize(x) for x in (slug, source, title)]
    empty = (first[0] == "") & (first[1] == "") & (first[2] == "")
    return F.when(empty, normalize(F.coalesce(F.nullif(anchor, F.lit("")), entry_id))).otherwise(F.concat_ws("|", *first, normalize(source_type)))


def ordered_distinct(values: Column, limit: int | None = None) -> Column:
    """Without nulls, empty strings and repeats, in order of first use."""
    out = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, limit) if limit else out


def ngram_jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def keywords(text: Column, leading: list[str], limit: int = 24) -> Column:
    """Leading words, then the most frequent ones (ties by first use), within one text."""
    stop = F.array(*map(F.lit, vocab.KEYWORD_STOPWORDS))
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(f"[a-z][a-z0-9_+#.-]{{2,}}|[{CJK}]{{2,12}}"), F.lit(0))
    kept = F.filter(words, lambda x: ~F.array_contains(stop, x) & (F.length(x) <= 40))
    start = F.expr("cast(map() as map<string, int>)")
    counts = F.aggregate(kept, start, lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x), F.create_map(x, F.coalesce(F.try_element_at(acc, x), F.lit(0)) + 1)))
    ranked = F.sort_array(F.transform(F.map_entries(counts), lambda e: F.struct((-e.value).alias("n"), F.array_position(kept, e.key).alias("p"), e.key.alias("k"))))
    return F.slice(F.array_distinct(F.concat(F.array(*map(F.lit, leading)).cast("array<string>"), F.transform(F.slice(ranked, 1, limit * 3), lambda r: r.k))), 1, limit)


def sentences_with_cues(text: Column, limit: int = 16) -> Column:
    """Sentences of 24 to 420 characters that name a technique; list marks stripped, code lines left out."""
    parts = F.split(text_or_empty(text), r"(?<=[.!?。！？])\s+|\n+")
    lines = F.transform(parts, lambda x: clean_line(F.regexp_replace(x, r"^\s*(?:[-*+] |\d+[.)]\s*)", "")))
    good = F.filter(lines, lambda x: x.rlike(vocab.TRICK_CUES) & F.length(x).between(24, 420) & ~x.rlike("^(import |from |def |class )"))
    return F.slice(F.array_distinct(good), 1, limit)


def expand_template(template: str, **values: Column) -> Column:
    """`{name}` replaced by its column; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), text_or_empty(value))
    return out
