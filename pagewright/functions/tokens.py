"""Placeholder tokens: protecting entities, fixed terms and glossary terms, and restoring them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import bound, interleave


def token(kind: str, prefix: str, index: Column) -> Column:
    clean = "".join(c for c in prefix if c.isascii() and c.isalnum()).upper()
    return F.concat(F.lit(f"ZXQ{kind}{clean}X"), F.lpad(index.cast("string"), 4, "0"), F.lit("ZXQ"))


def entity_pattern(mode: str) -> str:
    return "(?U)" + C.ENTITIES[mode]


def protect_entities(text: Column, prefix: str = "", mode: str = "default") -> tuple[Column, Column]:
    """(text with numbered tokens, map of token to match)."""
    pattern = entity_pattern(mode)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(found, lambda x, i: F.struct(token("ENT", prefix, i), x))
    return interleave(text, pattern, lambda x, i: token("ENT", prefix, i)), F.map_from_entries(pairs)


def protect_terms(text: Column, terms: dict[str, str], kind: str, prefix: str = "", ignore_case: bool = False) -> tuple[Column, Column]:
    """(text, map of token to the term's replacement): longest term first, a token a term that occurs."""
    rules = []
    for term in sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t)):
        whole = all(c.isascii() and (c.isalnum() or c in "_-") for c in term)
        literal = "".join("\\" + c if not c.isalnum() else c for c in term)
        pattern = ("(?i)" if ignore_case else "") + (rf"(?<![A-Za-z0-9_]){literal}(?![A-Za-z0-9_])" if whole else literal)
        rules.append(F.struct(F.lit(pattern).alias("pattern"), F.lit(terms[term]).alias("term")))
    # A fold over the rules: the expression's size doesn't depend on nested copies of the text.
    none = F.array().cast("array<struct<token:string,term:string>>")
    if not rules:
        return text, F.map_from_entries(none)

    def step(state: Column, rule: Column) -> Column:
        made = token(kind, prefix, F.size(state["entries"]))
        now = F.struct(
            F.regexp_replace(state["text"], rule["pattern"], made).alias("text"),
            F.concat(state["entries"], F.array(F.struct(made.alias("token"), rule["term"].alias("term")))).alias("entries"),
        )
        return F.when(F.rlike(state["text"], rule["pattern"]), now).otherwise(state)

    done = F.aggregate(F.array(*rules), F.struct(text.alias("text"), none.alias("entries")), step)
    return done["text"], F.map_from_entries(done["entries"])


def _lowered(mapping: Column) -> Column:
    return F.transform_keys(mapping, lambda k, v: F.lower(k))


def restore_exact(text: Column, mapping: Column) -> Column:
    return bound(_lowered(mapping), lambda names: interleave(text, C.TOKEN, lambda x, i: F.coalesce(F.try_element_at(names, F.lower(x)), x)))


def _rebuilt(text: Column, mapping: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    parts = F.struct(part(1).alias("kind"), part(2).alias("prefix"), part(3).alias("index"), _lowered(mapping).alias("names"))

    def rebuilt(s: Column) -> Column:
        name = lambda i: F.lower(F.concat(F.lit("ZXQ"), F.get(s["kind"], i), F.get(s["prefix"], i), F.lit("X"), F.lpad(F.get(s["index"], i), 4, "0"), F.lit("ZXQ")))
        return interleave(text, pattern, lambda x, i: F.coalesce(F.try_element_at(s["names"], name(i)), x))

    return bound(parts, rebuilt)


def restore_fuzzy(text: Column, mapping: Column) -> Column:
    """Tokens with lost or doubled letters and zeros."""
    return _rebuilt(text, mapping, C.TOKEN_FUZZY)


def restore_spaced(text: Column, mapping: Column) -> Column:
    """Tokens with white space inside."""
    return _rebuilt(text, mapping, C.TOKEN_SPACED)


def restore(text: Column, mapping: Column) -> Column:
    """The three in order, each on the one before's result."""
    exact = restore_exact(text, mapping)
    return bound(exact, lambda x: bound(restore_fuzzy(x, mapping), lambda y: restore_spaced(y, mapping)))
