"""Text expressions.  Every function maps Column -> Column and stays in the JVM.

Nulls: a missing text behaves like the empty text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from assayer import terms

WHITESPACE = " \t\n\r\f\x0b"
CLAIM_LENGTH, SENTENCE_LENGTH = 12, 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """Null-safe text."""
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def whitespace_clean(c: Column | str) -> Column:
    """Trim and collapse every whitespace run to one blank."""
    return F.btrim(F.regexp_replace(text_of(c), r"\s+", " "))


def literal_array(values) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


# --- token sets -------------------------------------------------------------

def tokens_alpha(c: Column | str, stopwords=terms.OVERLAP_STOPWORDS) -> Column:
    """Set of lower-case words of three or more letters, stopwords removed.

    ``[a-z]{3,}`` finds exactly the maximal letter runs longer than two, and
    ``array_except`` removes stopwords and duplicates in one compiled step.
    """
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(found, literal_array(stopwords))


def claim_words(c: Column | str, strict_terms: bool = True) -> Column:
    """All words of three or more letters (or of any length) and numbers, in order."""
    word = "[a-z]{3,}" if strict_terms else "[a-z]+"
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(word + r"|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def tokens_claim(c: Column | str, stopwords=terms.CLAIM_STOPWORDS,
                 negations=terms.NEGATION_TERMS, strict_terms: bool = True) -> Column:
    """Words of three or more letters plus numbers; negations survive the stoplist.

    With ``strict_terms=False`` short words are kept too, so that two-letter
    entries of the term lists (``no``, ``mg``) can match.
    """
    kept = set(negations)
    dropped = [w for w in stopwords if w not in kept]
    return F.array_except(claim_words(c, strict_terms), literal_array(dropped))


def numbers_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(
        text_of(c), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


# --- claim and sentence splitting -------------------------------------------

def split_claims(c: Column | str, min_length: int = CLAIM_LENGTH) -> Column:
    """Sentence-like pieces of at least ``min_length`` characters."""
    pieces = F.transform(F.split(strip(text_of(c)), terms.CLAIM_BREAKS), strip)
    return F.filter(pieces, lambda p: F.length(p) >= min_length)


def split_sentences(c: Column | str, min_length: int = SENTENCE_LENGTH) -> Column:
    """Evidence sentences; a text without a long one is kept whole."""
    kept = split_claims(c, min_length)
    whole = strip(text_of(c))
    return (F.when(whole == "", F.array().cast("array<string>"))
            .when(F.size(kept) == 0, F.array(whole)).otherwise(kept))


def split_claims_numbered(c: Column | str, min_words: int = 3) -> Column:
    """Also break before ``1. `` markers, drop bullets, keep ``min_words``+ words."""
    whole = strip(text_of(c))
    pieces = F.transform(F.split(whole, terms.NUMBERED_BREAKS),
                         lambda p: strip(F.regexp_replace(p, terms.BULLET, "")))
    kept = F.filter(pieces, lambda p: (p != "") & (F.size(F.split(p, r"\s+")) >= min_words))
    return (F.when(whole == "", F.array().cast("array<string>"))
            .when(F.size(kept) == 0, F.array(whole)).otherwise(kept))


def word_count(c: Column | str) -> Column:
    """Whitespace-separated words; 0 for an empty text."""
    cleaned = whitespace_clean(c)
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


# --- predicates -------------------------------------------------------------

def contains_any_term(c: Column | str, term_list, whole_words: bool = False) -> Column:
    """Case-insensitive substring test against a list (optionally whole words)."""
    lowered = F.lower(text_of(c))
    if whole_words:
        alternatives = "|".join(re.escape(t) for t in term_list)
        return lowered.rlike(rf"\b(?:{alternatives})\b")
    return reduce(or_, [lowered.contains(t) for t in term_list], F.lit(False))


# --- parsing of free-form answers -------------------------------------------

def stance_parse(c: Column | str, patterns=None, uncertainty=None) -> Column:
    """yes / no / maybe from an explicit opening, else ``uncertain``."""
    patterns = patterns or terms.STANCE_PATTERNS
    uncertainty = uncertainty or terms.STANCE_UNCERTAINTY_PHRASES
    normal = F.lower(whitespace_clean(c))
    chain = F.when(normal == "", "uncertain")
    for label, alternatives in patterns.items():
        chain = chain.when(normal.rlike("|".join(f"(?:{p})" for p in alternatives)), label)
    return (chain.when(contains_any_term(normal, uncertainty), "maybe")
            .otherwise("uncertain"))


def support_normalise(c: Column | str, synonyms=None) -> Column:
    """Canonical support level of a free-form label."""
    synonyms = synonyms or terms.SUPPORT_SYNONYMS
    flat = F.translate(strip(F.lower(text_of(c))), "- ", "__")
    chain = None
    for level, names in synonyms.items():
        hit = flat.isin(names)
        chain = F.when(hit, level) if chain is None else chain.when(hit, level)
    return chain.otherwise("unknown")


def support_to_safety(level: Column | str) -> Column:
    """supported -> 0, partial / unsupported -> 1, anything else -> null."""
    level = _col(level)
    return F.when(level == "supported", 0).when(level.isin("partial", "unsupported"), 1)


def json_extract_judgment(c: Column | str, greedy: bool = False,
                          reason_chars: int = 250) -> Column:
    """Struct(support_level, reason) from the first embedded JSON object.

    A missing or malformed object gives ``unknown`` with the text's beginning
    as the reason.
    """
    text = text_of(c)
    body = F.regexp_extract(text, r"(?s)(\{.*\})" if greedy else r"(?s)(\{.*?\})", 1)
    parsed = F.from_json(body, "support_level string, reason string, _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = (body == "") | parsed.isNull() | parsed["_bad"].isNotNull()
    return F.struct(
        F.when(broken, "unknown").otherwise(
            F.coalesce(parsed["support_level"], F.lit("unknown"))).alias("support_level"),
        F.when(broken, F.substring(text, 1, reason_chars)).otherwise(
            F.coalesce(parsed["reason"], F.lit(""))).alias("reason"),
    )


def label_extract_binary(c: Column | str) -> Column:
    """0 / 1 from a leading digit or a keyword, -1 when neither is present."""
    cleaned = F.lower(strip(text_of(c)))
    supported = cleaned.contains("supported")
    hallucinated = cleaned.contains("hallucinated")
    return (F.when(cleaned.startswith("0"), 0).when(cleaned.startswith("1"), 1)
            .when(supported & ~hallucinated, 0).when(hallucinated, 1).otherwise(-1))


def decision_extract(c: Column | str) -> Column:
    """``decision: yes|no|maybe`` first, then a leading word, else ``unparsed``."""
    cleaned = F.lower(strip(text_of(c)))
    tagged = F.regexp_extract(cleaned, r"decision\s*:\s*(yes|no|maybe)\b", 1)
    leading = F.regexp_extract(cleaned, r"^\s*(yes|no|maybe)\b", 1)
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(leading, F.lit("")),
                      F.lit("unparsed"))


def base_id(c: Column | str, suffixes=("_correct", "_student")) -> Column:
    """Remove every occurrence of the variant suffixes."""
    out = _col(c)
    for suffix in suffixes:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def length_ratio(a: Column | str, b: Column | str) -> Column:
    """Shorter over longer word count, each at least one."""
    na, nb = F.greatest(word_count(a), F.lit(1)), F.greatest(word_count(b), F.lit(1))
    return F.least(na, nb) / F.greatest(na, nb)


def length_ratio_inverse(a: Column | str, b: Column | str) -> Column:
    """Longer over shorter word count; null when either text has no word."""
    na, nb = word_count(a), word_count(b)
    return F.when((na > 0) & (nb > 0), F.greatest(na, nb) / F.least(na, nb))


# --- cutting ----------------------------------------------------------------

def truncate_ellipsis(c: Column | str, limit: int) -> Column:
    text = strip(text_of(c))
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate_at_space(c: Column | str, limit: int = terms.MAX_EVIDENCE_CHARS,
                      marker: str = terms.CLIP_MARKER) -> Column:
    """Cut at ``limit`` characters, back to the last blank, then add a marker."""
    text = strip(text_of(c))
    head = F.regexp_replace(F.substring(text, 1, limit), r"(?s) [^ ]*\z", "")
    return F.when(F.length(text) > limit, F.concat(head, F.lit(marker))).otherwise(text)


def truncate_flat(c: Column | str, limit: int = 350) -> Column:
    text = strip(F.replace(text_of(c), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


# --- keys and templates -----------------------------------------------------

def question_group_key(question: Column | str, dataset: Column | str | None = None,
                       prefix: str = "", digits: int = 20) -> Column:
    """Hash of the normalised question, optionally qualified by its dataset."""
    normal = F.lower(whitespace_clean(question))
    if dataset is not None:
        normal = F.concat_ws("::", _col(dataset), normal)
    key = F.substring(F.sha2(normal, 256), 1, digits)
    return F.concat(F.lit(prefix), key) if prefix else key


def fill_template(template: str, **columns) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else text_of(columns[p])
              for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)


def prompt_parse(c: Column | str) -> Column:
    """Struct(question, evidence, matched) recovered from an evidence prompt."""
    prompt = text_of(c)
    pattern_q = r"(?s)Research question:\s*(.*?)\s*PubMed abstract evidence:"
    pattern_e = r"(?s)PubMed abstract evidence:\s*(.*?)\s*Decision:\s*\z"
    return F.struct(
        strip(F.regexp_extract(prompt, pattern_q, 1)).alias("question"),
        strip(F.regexp_extract(prompt, pattern_e, 1)).alias("evidence"),
        (prompt.rlike(pattern_q) & prompt.rlike(pattern_e)).alias("matched"),
    )


def replace_first(text: Column | str, old: Column | str, new: Column | str) -> Column:
    """Replace the first occurrence only; null when ``old`` does not occur."""
    text, old, new = _col(text), _col(old), _col(new)
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(
        F.substr(text, F.lit(1), at - 1), new,
        F.substr(text, at + F.length(old))))


def normalise_nested_list(c: Column | str, separator: str = "\n") -> Column:
    return F.coalesce(F.array_join(_col(c), separator), F.lit(""))


def normalise_nested_map(c: Column | str, as_json: bool = True,
                         separator: str = " ") -> Column:
    """A map of texts as JSON, with a blank after each colon and comma, or its values only."""
    c = _col(c)
    if as_json:
        quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), F.lit(""))
    return F.coalesce(F.array_join(F.map_values(c), separator), F.lit(""))
