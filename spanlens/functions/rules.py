"""Rule tables turned into column expressions.

The rules run on each row where it is: a narrow projection with patterns compiled once per task. No
distinct + join-back is used, because one frequent surface would make that join skewed.

A table is asked once per text and answers with rule numbers; what a rule says is looked up by number in
constant arrays. The patterns stand inside a lambda, which Spark evaluates row by row with compiled patterns:
however often a result is named and however long the table is, generated code does not grow.

A pattern is tried only on texts that hold the constant words it cannot do without (``needed``): a search for bytes
costs a small part of a regular expression, and most patterns of a table fit no given text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from re import _constants as _re_names
from re import _parser as _re_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions import vocab

ENTITY_TYPE = "struct<canonical:string,category:string>"


def strings(values: Sequence[str]) -> Column:
    """Constant string array."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def squeeze(text: Column) -> Column:
    """Lower case, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text.cast("string")), r"(?U)\s+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


# Constructs whose meaning differs between Java and Python, or that change what a letter fits.
_UNSURE = re.compile(r"\(\?[a-zA-Z-]|\[[^\]]*\[|&&|\\[^bBsSdDwW.^$*+?(){}|/\[\]\\-]|\\\\|[*+?}]\+")
_MOST_WORDS = 12


@lru_cache(maxsize=4096)
def needed(pattern: str) -> tuple[str, ...]:
    """Constant texts of which at least one occurs wherever the pattern fits; empty if none are known."""
    if _UNSURE.search(pattern):
        return ()
    try:
        return tuple(_required(_re_parser.parse(pattern)))
    except re.error:
        return ()


def _required(parsed) -> list[str]:
    """The best of the alternatives that the parts of a sequence ask for: fewest first, then longest."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _re_names.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append([run])
        run = ""
        if op is _re_names.SUBPATTERN:
            found.append(_required(arg[3]))
        elif op is _re_names.MAX_REPEAT and arg[0] > 0:
            found.append(_required(arg[2]))
        elif op is _re_names.BRANCH:
            parts = [_required(part) for part in arg[1]]
            found.append([w for part in parts for w in part] if all(parts) else [])
    # A word that holds another one asks for nothing more.
    found = [sorted(w for w in set(words) if not any(o != w and o in w for o in words)) for words in found]
    found = [words for words in found if 0 < len(words) <= _MOST_WORDS]
    return min(found, key=lambda words: (-min(map(len, words)), len(words)), default=[])


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Any of the constant words occurs in the text, wherever it starts."""
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def fits(text: Column, pattern: str) -> Column:
    """The pattern occurs in the text."""
    words = needed(pattern)
    return has_any(text, words) & text.rlike(pattern) if words else text.rlike(pattern)


def fitting(clean: Column, patterns: Sequence[str]) -> Column:
    """Numbers from 1 of all patterns that occur in the text, in table order."""
    if not patterns:
        return F.array().cast("array<int>")
    hits = lambda t: F.array(*[F.when(fits(t, p), i) for i, p in enumerate(patterns, 1)])
    return F.filter(once(clean, hits), lambda i: i.isNotNull())


def first_fitting(clean: Column, patterns: Sequence[str]) -> Column:
    """Number from 1 of the first pattern that occurs in the text, null if none does."""
    if not patterns:
        return F.lit(None).cast("int")

    def chain(t: Column) -> Column:
        out = F.when(fits(t, patterns[0]), 1)
        for i, p in enumerate(patterns[1:], 2):
            out = out.when(fits(t, p), i)
        return out

    return once(clean, chain)


def entity(clean: Column, hint: Column, rules=None) -> Column:
    """(canonical, category) of a squeezed surface: first rule, then word class, then hint."""

    table = [(*r, False) for r in rules or vocab.ENTITY_RULES] + list(vocab.ENTITY_FALLBACKS)
    patterns, names, kinds, wins = map(list, zip(*table))
    by_hint = F.create_map(*[F.lit(v) for pair in vocab.HINT_FALLBACKS for v in pair])
    flags = F.array(*[F.lit(w) for w in wins])

    def made(i: Column) -> Column:
        kind = F.try_element_at(strings(kinds), i)
        found = F.struct(F.try_element_at(strings(names), i).alias("canonical"), F.when(F.try_element_at(flags, i), F.coalesce(hint, kind)).otherwise(kind).alias("category"))
        rest = F.struct(
            F.coalesce(F.try_element_at(by_hint, hint), F.lit("generic_object")).alias("canonical"), F.coalesce(hint, F.lit("object")).alias("category")
        )
        return F.when(i.isNotNull(), found).otherwise(rest)

    return once(first_fitting(clean, patterns), made)


def entity_words(rules=None) -> list[str]:
    """Constant texts of which one occurs wherever some entity rule fits; empty if a rule needs none."""
    words = [needed(pattern) for pattern, _, _ in rules or vocab.ENTITY_RULES]
    return sorted({w for group in words for w in group}) if all(words) else []


def rule_canonical(clean: Column, rules=None) -> Column:
    """Canonical of the first entity rule that fits, null when only a fallback would."""
    table = rules or vocab.ENTITY_RULES
    return F.try_element_at(strings([c for _, c, _ in table]), first_fitting(clean, [p for p, _, _ in table]))


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda i: (i > low) & (i <= high)


def attributes(clean: Column, rules: Mapping[str, Sequence[tuple[str, str]]] | None = None) -> Column:
    """Map of attribute group to sorted values; groups without a hit are left out."""
    table = rules or vocab.ATTRIBUTE_RULES
    flat = [(pattern, value) for group in table.values() for pattern, value in group]
    values = strings([v for _, v in flat])

    def made(found: Column) -> Column:
        parts, at = [], 0
        for name, group in table.items():
            own = F.filter(found, _between(at, at + len(group)))
            parts += [F.lit(name), F.array_sort(F.array_distinct(F.transform(own, lambda i: F.element_at(values, i))))]
            at += len(group)
        return F.map_filter(F.create_map(*parts), lambda _, v: F.size(v) > 0)

    return once(fitting(clean, [p for p, _ in flat]), made)


def attribute_values(attribute_map: Column) -> Column:
    """All values of an attribute map as one sorted set."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(attribute_map))))


def predicates(clean: Column, rules=None) -> Column:
    """Predicates of a squeezed action phrase: first rule, else ``other_action``."""
    table = rules or vocab.ACTION_RULES
    found = F.array(*[strings(values) for _, values in table])
    return F.coalesce(F.try_element_at(found, first_fitting(clean, [p for p, _ in table])), strings(["other_action"]))


def informative(concepts: Column, stop: Sequence[str] | None = None) -> Column:
    """Concepts without the ones too general to carry meaning."""
    return F.array_except(concepts, strings(vocab.STOP_CONCEPTS if stop is None else stop))
