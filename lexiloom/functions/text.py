"""Scalar functions on labels, URIs and answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_name(uri: Column) -> Column:
    """Text after the last '#' as it is; without one, the last path segment in lower case."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(
        F.lower(F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1))
    )


def uri_path(uri: Column) -> Column:
    """The path of a URI reference: without fragment, query, scheme, authority and the last segment's parameters."""
    path = F.regexp_replace(uri, r"#[\s\S]*$", "")
    path = F.regexp_replace(path, r"\?[\s\S]*$", "")
    path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    path = F.regexp_replace(path, r"^//[^/]*", "")
    return F.regexp_replace(path, r";[^/]*$", "")


def uri_term(uri: Column) -> Column:
    """The last segment of the path; where there is no path, the text after the last '#', else the whole."""
    segment = F.substring_index(F.rtrim(uri_path(uri), F.lit("/")), "/", -1)
    term = F.when(segment != "", segment).otherwise(uri)
    return F.substring_index(term, "#", -1)


def clean_uris(values: Column) -> Column:
    """Every value split at '|', each part as its term."""
    return F.transform(F.flatten(F.transform(values, lambda v: F.split(v, F.lit(r"\|")))), lambda p: uri_term(p))


def strip_path(values: Column) -> Column:
    """Second pass on parents and children: the path without leading slashes."""
    return F.transform(values, lambda v: F.ltrim(uri_path(v), F.lit("/")))


def first_distinct(values: Column, k: int) -> Column:
    """The first k different values in their order."""
    return F.slice(F.array_distinct(values), 1, k)


def clean_terms(values: Column) -> Column:
    """Values of two characters at least, without underscore and digit (superscripts and circled digits included)."""
    return F.filter(values, lambda v: (F.length(v) >= 2) & ~v.rlike("[_\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿]"))


def list_text(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit("none")).otherwise(F.array_join(values, ", "))


def yes_no(response: Column) -> Column:
    """1 if the first answer tag says yes, in any case; else 0."""
    said = F.lower(F.regexp_extract(F.coalesce(response, F.lit("")), r"(?iU)<answer>\s*(yes|no)\s*</answer>", 1))
    return F.when(said == "yes", 1).otherwise(0)


def confidence(response: Column) -> Column:
    """The number in the first confidence tag (lower case) if it is 0 to 10; else 0."""
    n = F.regexp_extract(F.coalesce(response, F.lit("")), r"<confidence>\s*(\d{1,2})\s*</confidence>", 1).try_cast("int")
    return F.when(n.between(0, 10), n).otherwise(0)


def token_estimate(text: Column) -> Column:
    """Tokens of a text, by four characters each."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def file_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def gate_score(conf: Column, f1: Column | float = 0.0, gamma: float = 1.0, delta: float = 1.0, epsilon: float = 0.0, seed: int = 42) -> Column:
    """Above 0 the answer is accepted: (gamma + delta) * confidence - 11 * delta, and noise that F1 scales."""
    score = F.lit(gamma + delta) * conf - F.lit(11.0 * delta)
    return score + F.randn(seed) * F.lit(epsilon) * f1 if epsilon else score


def same_code(a: Column, b: Column) -> Column:
    """Whether two nodes have one code."""
    return a["code"] == b["code"]


def relation_kind(rel: Column) -> Column:
    """synonym, parent or child, from a relation's label."""
    rel = F.lower(rel)
    return F.when(F.contains(rel, F.lit("syn")), "synonym").when(F.contains(rel, F.lit("classof")), "parent").otherwise("child")


def nearer_term(start: Column, end: Column, sim_start: Column, sim_end: Column) -> Column:
    """The end of an edge that is more like the concept; the far one on a tie."""
    return F.when(sim_start > sim_end, start).otherwise(end)
