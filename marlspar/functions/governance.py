"""Safety flags, redaction, URL and licence rules as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import text_or_empty

_PRIVATE_V4 = r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.0\.|198\.1[89]\.|2[4-5]\d\.)(?:\d+\.){0,2}\d+$"
_URL = r"(?is)^(https?)://(?:([^/?#@]*)@)?([^/?#:\[\]]+|\[[^\]]*\])(:\d+)?([^?#]*)"


def risk_flags(text: Column) -> Column:
    """Names of the instruction-like patterns that a text matches."""
    return F.filter(F.array(*[F.when(text_or_empty(text).rlike(p), F.lit(k)) for k, p in vocab.RISK_FLAGS.items()]), lambda x: x.isNotNull())


def _may_match(text: Column, pattern: str) -> Column:
    """False only where no literal of the pattern (vocab.HOLDS) occurs: a search of bytes instead of a slow pattern."""
    held = vocab.HOLDS.get(pattern)
    if held is None:
        return F.lit(True)
    own = F.lower(text) if pattern.startswith("(?i)") else text
    out = F.lit(False)
    for x in held:
        out = out | F.contains(own, F.lit(x))
    return out


def is_sensitive(text: Column) -> Column:
    """A credential, a local path or a URL with a query; `text` is evaluated once for all patterns."""

    def any_match(x: Column) -> Column:
        out = F.lit(False)
        for p in vocab.SENSITIVE:
            out = out | (_may_match(x, p) & x.rlike(vocab.QUICKER.get(p, p)))
        return out

    return F.exists(F.array(text_or_empty(text)), any_match)


def redact(text: Column, rules: list[tuple[str, str]]) -> Column:
    def replaced(pattern: str, replacement: str) -> Callable[[Column], Column]:
        return lambda x: F.when(_may_match(x, pattern), F.regexp_replace(x, pattern, replacement)).otherwise(x)

    out = F.array(text_or_empty(text))  # a bound value: `x` above stands for it several times
    for pattern, replacement in rules:
        out = F.transform(out, replaced(pattern, replacement))
    return F.get(out, F.lit(0))


def sanitize(text: Column, keep_lines: bool = True) -> Column:
    """Keys, secrets and local paths replaced; line ends stripped, or all white space collapsed."""
    out = redact(text, vocab.REDACT_LINES)
    if keep_lines:
        lines = F.split(F.replace(out, F.lit("\r\n"), F.lit("\n")), "\n")
        return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"), r"(?U)^\s+|\s+$", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def sanitize_book(text: Column) -> Column:
    return redact(text, vocab.REDACT_BOOK)


def sanitize_excerpt(text: Column) -> Column:
    out = redact(text, vocab.REDACT_LINES[:2])
    return F.regexp_replace(F.array_join(F.transform(F.split(out, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"), r"(?U)^\s+|\s+$", "")


def public_url(url: Column) -> Column:
    """http(s) with a host, without user info, and neither a local nor a private address."""
    u = F.trim(text_or_empty(url))
    host = F.lower(F.regexp_extract(u, _URL, 3))
    local6 = host.rlike(r"^\[(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)\]$")
    return (host != "") & (F.regexp_extract(u, _URL, 2) == "") & (host != "localhost") & ~host.endswith(".local") & ~host.rlike(_PRIVATE_V4) & ~local6


def strip_query(url: Column) -> Column:
    """Scheme, authority and path of an http(s) URL, else ''."""
    return F.regexp_extract(F.trim(text_or_empty(url)), r"(?i)^(https?://[^/?#]+[^?#]*)", 1)


def strip_credentials(url: Column) -> Column:
    """Scheme, host, port and path; user info, query and fragment dropped."""
    u = F.trim(text_or_empty(url))
    host = F.lower(F.regexp_extract(u, _URL, 3))
    parts = [F.lower(F.regexp_extract(u, _URL, 1)), F.lit("://"), host, F.regexp_extract(u, _URL, 4), F.regexp_extract(u, _URL, 5)]
    return F.when(host != "", F.concat(*parts)).otherwise("")


def licence(text: Column) -> Column:
    """The first of MIT, Apache-2.0, GPL, BSD that a licence text names, else unknown."""
    t = F.lower(F.substring(text_or_empty(text), 1, 20000))
    found = F.when(t.contains("mit license"), "MIT").when(t.contains("apache license") & t.contains("version 2"), "Apache-2.0")
    return found.when(t.contains("gnu general public license"), "GPL").when(t.contains("redistribution and use in source and binary forms"), "BSD").otherwise("unknown")


def wrap_evidence(text: Column, source: Column, anchor: Column, title: Column) -> Column:
    """A text between markers with its provenance and flags; markers inside are escaped."""
    html = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    safe = F.replace(F.replace(text_or_empty(text), F.lit(vocab.EVIDENCE_BEGIN), F.lit(vocab.EVIDENCE_BEGIN_ESCAPED)), F.lit(vocab.EVIDENCE_END), F.lit(vocab.EVIDENCE_END_ESCAPED))
    flags = risk_flags(text)
    lines = [
        F.lit(vocab.EVIDENCE_BEGIN), F.lit(f"security_notice: {vocab.EVIDENCE_NOTICE}"), F.concat(F.lit("source: "), html(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")))),
        F.when(anchor != "", F.concat(F.lit("anchor: "), html(anchor))), F.when(title != "", F.concat(F.lit("title: "), html(title))), F.lit("trust_level: untrusted_external"),
        F.concat(F.lit("risk_flags: "), F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise("none_detected")), F.lit(""),
        F.regexp_replace(safe, r"(?U)\s+$", ""), F.lit(vocab.EVIDENCE_END), F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def excerpt(text: Column, start: int, end: int) -> Column:
    """Lines start..end (1-based, at most 120), redacted."""
    if not 1 <= start <= end or end - start >= 120:
        raise ValueError("an excerpt has 1 to 120 lines")
    return sanitize_excerpt(F.array_join(F.slice(F.split(text_or_empty(text), r"\r\n|[\n\r]"), start, end - start + 1), "\n"))


def file_role(stem: Column) -> Column:
    s = F.lower(stem)
    named = lambda x: (s == x) | s.startswith(f"{x}_") | s.endswith(f"_{x}")
    sub = s.contains("submission")
    return F.when(s.contains("sample") & sub, "sample_submission").when(named("train"), "train").when(named("test"), "test").when(sub, "submission_related").otherwise("auxiliary")
