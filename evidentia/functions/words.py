"""Tokens, claims, instruction patterns and hashed features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stop lists, and the instruction patterns with their weights.
SEARCH_STOP = "is are the a an to of for on in we our do does should what which how still with and or be keep need about it this that from at by us".split()
CLAIM_STOP = "the a an is are was were be been to of for on in and or not no it this that with as at by from has have had which should would can may".split()
QUESTION_PREFIXES = ["Is ", "Are ", "Do ", "Does ", "Should ", "What ", "Which ", "How "]
INJECTION = [
    ("override_instruction", 0.95, r"\b(ignore|disregard|override)\b[^.]{0,40}\b(previous|prior|other|above|earlier)\b[^.]{0,30}\b(instruction|prompt|source|document|advisor)"),
    ("system_impersonation", 0.85, r"\b(system\s+note|system\s+prompt|system\s+message)\b"),
    ("addressed_to_model", 0.90, r"\bfor\s+(automated|ai|llm|model|assistant)\s+(summari[sz]er|reader|system|agent)"),
    ("answer_steering", 0.80, r"\bwhen\s+(answering|responding|summari[sz]ing)\b[^.]{0,60}\b(report|state|say|answer)\b"),
    ("concealment_instruction", 0.85, r"\bdo\s+not\s+(mention|disclose|reveal|report|cite)\b"),
    ("supersession_claim", 0.70, r"\bthis\s+(thread|document|entry|advisory)\s+supersedes\b"),
    ("imperative_to_model", 0.75, r"\byou\s+(must|should|are\s+required\s+to)\b[^.]{0,40}\b(answer|respond|report|state)\b"),
    ("role_prefix", 0.60, r"\b(assistant|chatbot|language\s+model)\s*[:,]"),
    ("tag_injection", 0.80, r"</?(system|instruction|prompt)>"),
]
WORD, TERM = r"[a-z0-9]+", r"[a-z0-9][a-z0-9.\-_]*"
DIMENSIONS = 384


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def search_terms(text: Column) -> Column:
    """Terms of a text with their repeats, names such as cve-2021-44228 whole, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(SEARCH_STOP))


def salient_terms(text: Column) -> Column:
    """Distinct search terms of three characters or more, in their order."""
    return F.array_distinct(F.filter(search_terms(text), lambda t: F.length(t) >= 3))


def subject(text: Column) -> Column:
    """A question without its mark and the word that opens it."""
    bare = F.trim(F.rtrim(text, F.lit("?")))
    cut = bare
    for prefix in reversed(QUESTION_PREFIXES):
        cut = F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(cut)
    return cut


def claim_terms(text: Column) -> Column:
    """The distinct words that a claim says something with."""
    return F.array_distinct(F.filter(words(text), lambda t: ~t.isin(CLAIM_STOP) & (F.length(t) > 2)))


def coverage(premise: Column, claim: Column) -> Column:
    """The share of the claim's terms that the premise has; 0 for a claim without terms."""
    said = claim_terms(claim)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(claim_terms(premise), said)), F.size(said)), F.lit(0.0))


def injection_hits(text: Column) -> Column:
    """Structs (name, weight) of the patterns that match."""
    rules = [F.when(F.regexp_like(text, F.lit(f"(?i){p}")), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, p in INJECTION]
    return F.array_compact(F.array(*rules))


def noisy_or(hits: Column) -> Column:
    """1 less the product of what each hit leaves."""
    return 1 - F.aggregate(hits, F.lit(1.0), lambda left, hit: left * (1 - hit["weight"]))


def features(text: Column) -> Column:
    """Words, the three-character slices of each between # marks, and adjacent pairs, with repeats."""
    w = words(text)
    slices = F.flatten(F.transform(w, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(F.concat(F.lit("#"), t, F.lit("#")), i, F.lit(3)))))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit("_"), b)))
    return F.concat(w, slices, F.coalesce(pairs, F.array().cast("array<string>")))


def bucket(feature: Column) -> Column:
    """The dimension that a feature counts in."""
    return F.conv(F.substr(F.md5(feature), F.lit(1), F.lit(8)), 16, 10).cast("long") % DIMENSIONS


def sign(feature: Column) -> Column:
    """1 or -1, as a feature counts in its dimension."""
    return F.when(F.conv(F.substr(F.md5(feature), F.lit(9), F.lit(2)), 16, 10).cast("long") % 2 == 1, 1.0).otherwise(-1.0)
