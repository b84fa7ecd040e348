"""Text helpers: keys, tokens, phrases, model-output parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions import vocab
from spanlens.functions.rules import fitting, strings

CHOICE_LABEL = r"(?U)^\s*([A-Za-z0-9]+)[.):：]\s*"
IMAGE_DATA = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+"


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def safe_key(value: Column) -> Column:
    """Path-safe stable key: cleaned head of the id plus ten hex digits of its SHA-1."""
    clean = F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")
    clean = F.regexp_replace(clean, r"^[._]+|[._]+$", "")
    head = F.substring(F.when(clean == "", F.lit("video")).otherwise(clean), 1, 80)
    return F.concat(head, F.lit("_"), F.substring(F.sha1(value), 1, 10))


def resolve_path(path: Column, root: Column | None) -> Column:
    """Join root and relative path; absolute paths stay."""
    if root is None:
        return path
    joined = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)
    return F.when(path.startswith("/") | root.isNull(), path).otherwise(joined)


def word_tokens(text: Column) -> Column:
    """Unicode word tokens in lower case, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def lexical_tokens(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Set of ASCII words and CJK runs longer than one character, without stopwords."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+|[一-鿿]+)"), 1)
    kept = F.array_except(F.array_distinct(raw), strings(vocab.STOPWORDS if stopwords is None else stopwords))
    return F.filter(kept, lambda t: F.length(t) > 1)


def _quoted(phrase: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in phrase)


def _phrase_pattern(phrases: Sequence[str]) -> str:
    return f"(?<![a-z0-9])(?:{'|'.join(map(_quoted, phrases))})(?![a-z0-9])"


def contains_phrase(text: Column, *phrases: str) -> Column:
    """Any of the constant phrases inside a text, not touching other letters or digits."""
    return text.rlike(_phrase_pattern(phrases))


def phrase_hits(text: Column, phrases: dict[str, Sequence[str]]) -> Column:
    """Names whose phrase list occurs in the text, as an array in table order."""
    return F.transform(fitting(text, [_phrase_pattern(p) for p in phrases.values()]), lambda i: F.element_at(strings(list(phrases)), i))


def ngrams(words: Column, longest: int) -> Column:
    """Distinct runs of 1..longest words, joined by spaces."""

    def runs(size: int) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1)))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s, size), " "))

    present = F.filter(F.array(*[runs(size) for size in range(1, longest + 1)]), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(present))


def choice_labels(options: Column) -> Column:
    """Leading label of each option, else A, B, C… by position."""

    def label(option: Column, i: Column) -> Column:
        found = F.upper(F.regexp_extract(option, CHOICE_LABEL, 1))
        return F.when(found == "", F.chr(i + 65)).otherwise(found)

    return F.transform(options, label)


def json_object_text(text: Column) -> Column:
    """First ``{`` to last ``}`` of a model reply without code fences; null if that is no JSON object."""
    clean = F.regexp_replace(F.regexp_replace(text, "```json", ""), "```", "")
    body = F.nullif(F.regexp_extract(clean, r"(?s)(\{.*\})", 1), F.lit(""))
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), body)


def missing_keys(json_text: Column, required: Sequence[str]) -> Column:
    """Required keys a JSON object lacks, sorted."""
    return F.array_sort(F.array_except(strings(required), F.json_object_keys(json_text)))


def forbidden_terms(summary: Column, terms: Sequence[str] | None = None) -> Column:
    """Forbidden terms found as whole words, in list order."""
    lowered = F.lower(summary)
    hits = []
    for term in vocab.SUMMARY_FORBIDDEN_TERMS if terms is None else terms:
        quoted = "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in term)
        hits.append(F.when(lowered.rlike(rf"\b{quoted}\b"), term))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def scrub_error(message: Column, limit: int = 2000) -> Column:
    """Error text without inlined images, cut to a fixed length for logs."""
    return F.substring(F.regexp_replace(message, IMAGE_DATA, "<image-data>"), 1, limit)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    clean = strip(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"(?U)\s+")))
