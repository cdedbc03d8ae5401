"""Text functions as Column expressions. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def clean_lines(c: Column) -> Column:
    """Trimmed non-blank lines after unifying line ends, spaces, ligatures and dashes."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = _replaced(c, C.SPACES | C.LIGATURES | C.DASHES)
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def dehyphenate(c: Column) -> Column:
    """Join a hyphen at a line's end with a next line that begins in lower case."""
    return F.regexp_replace(c, r"-\n(?=\p{Ll})", "")


def toc_like(lines: Column) -> Column:
    dots = F.size(F.filter(lines, lambda x: x.rlike(C.LEADER_DOTS)))
    ends = F.size(F.filter(lines, lambda x: x.rlike(C.TOC_END)))
    return (F.size(lines) >= 2) & ((dots >= 1) | (ends >= 2))


def clean_text(c: Column) -> Column:
    """A contents list keeps its lines; running text becomes one line without space before punctuation."""
    lines = clean_lines(c)
    merged = dehyphenate(F.array_join(lines, "\n"))
    listed = strip(F.array_join(F.transform(F.split(merged, "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n"))
    flowing = strip(F.regexp_replace(F.replace(merged, F.lit("\n"), F.lit(" ")), r"[ \t]+", " "))
    return F.when(toc_like(lines), listed).otherwise(F.regexp_replace(flowing, r"(?U)\s+([,.;:!?])", "$1"))


def normalize_lang(c: Column) -> Column:
    code = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(code.isin(*C.PT_BR_NAMES), "pb").otherwise(F.substring_index(code, "-", 1))


def provider_lang(provider: Column, lang: Column) -> Column:
    name, code = F.lower(strip(provider)), normalize_lang(lang)
    return F.when(code != "pb", code).when(name == "mymemory", "pt-br").when(name == "translategemma", "pt-BR").otherwise("pt")


def postprocess(dst: Column, src: Column) -> Column:
    """Tidy a translated text line by line; a short heading in capitals stays in capitals."""
    def tidy(line: Column) -> Column:
        dotted = (F.regexp_count(line, F.lit(r"\.")) >= 10) & line.rlike(r"(?:\.\s){5,}|\.{10,}")
        x = F.regexp_replace(line, r"(?U)\s+([,.;:!?])", "$1")
        x = F.regexp_replace(x, r"([,.;:!?])([A-Za-zÀ-ÖØ-öø-ÿ])", "$1 $2")
        x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+%", "%"), r"[ \t]{2,}", " ")
        return F.when(dotted, F.regexp_replace(line, r"(?U)\s+$", "")).otherwise(strip(x))

    text = F.array_join(F.transform(F.split(F.replace(dst, F.lit("\u00a0"), F.lit(" ")), "\n", -1), tidy), "\n")
    letters, uppers = F.regexp_count(src, F.lit(r"\p{L}")), F.regexp_count(src, F.lit(r"\p{Lu}"))
    words = F.size(F.filter(F.split(src, r"(?U)\s+", -1), lambda x: x != ""))
    return F.when((words <= 8) & (letters > 0) & (uppers >= letters * 0.85), F.upper(text)).otherwise(text)


def match_case(new: Column, old: Column) -> Column:
    head = F.substring(old, 1, 1)
    return (
        F.when((F.upper(old) == old) & (F.lower(old) != old), F.upper(new))
        .when((F.upper(head) == head) & (F.lower(head) != head), F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, 2, 10_000))))
        .otherwise(new)
    )


def interleave(text: Column, pattern: str, made) -> Column:
    """text with match i (from 0) replaced by made(match, i)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = lambda gaps: F.concat(F.array_join(F.transform(found, lambda x, i: F.concat(F.get(gaps, i), made(x, i))), ""), F.element_at(gaps, -1))
    return bound(F.split(text, pattern, -1), joined)


def _respelled(pattern: str, new: str):
    return lambda gap: interleave(gap, pattern, lambda old, _: match_case(F.lit(new), old))


def ptbr(text: Column) -> Column:
    """The spelling rules in order, outside placeholder tokens, keeping each word's case."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(0)), F.split(text, C.TOKEN, -1)
    for pattern, new in C.PT_BR_RULES:
        gaps = F.transform(gaps, _respelled("(?i)(?U)" + pattern, new))
    return bound(tokens, lambda kept: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), ""))


def short(c: Column, n: int) -> Column:
    one = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(one) > n, F.concat(F.substring(one, 1, n - 1), F.lit("…"))).otherwise(one)


def hard_split(c: Column, n: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.char_length(c) / n).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * n + 1, F.lit(n)))


def chunk_text(c: Column, n: int) -> Column:
    """Greedy runs of sentences of at most n characters; a longer sentence is cut."""
    text = strip(F.coalesce(c, F.lit("")))
    sentences = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+", -1), lambda x: x != "")
    runs = F.aggregate(
        sentences,
        F.array().cast("array<string>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.char_length(F.element_at(a, -1)) + 1 + F.char_length(s) <= n), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), s)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(F.char_length(text) <= n, F.array(text)).otherwise(F.flatten(F.transform(runs, lambda r: hard_split(r, n))))


def norm_tokens(pattern: str, c: Column) -> Column:
    return F.array_sort(F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + pattern), F.lit(0)), lambda x: F.lower(strip(x))), lambda x: x != ""))


def guard(before: Column, after: Column) -> Column:
    """Why an edited text can't be taken: changed tokens, numbers or references."""
    rules = (("zxq_tokens_changed", C.TOKEN), ("numbers_units_changed", C.GUARD_NUMBERS), ("references_changed", C.GUARD_REFERENCES))
    return F.array_compact(F.array(*[F.when(norm_tokens(p, before) != norm_tokens(p, after), name) for name, p in rules]))


def should_retry(c: Column, least: int = 12, most: int = 800) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    code = (~t.rlike(r"(?U)\s")) & t.rlike(r"^[A-Za-z0-9_\-.]+$") & (F.char_length(t) <= 10)
    english = F.concat(F.lit(" "), F.lower(t), F.lit(" ")).rlike(" (" + "|".join(C.RETRY_WORDS) + ") ")
    return F.char_length(t).between(least, most) & t.rlike("[A-Za-z]") & ~code & (english | (F.regexp_count(t, F.lit("[A-Za-z]{2,}")) >= 3))


def ocr_noise(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    solid = F.regexp_replace(t, r"(?U)\s+", "")
    letters, digits, n = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit(r"\d")), F.char_length(solid)
    ratio = (letters + digits) / F.greatest(n, F.lit(1))
    tokens = F.split(t, r"(?U)\s+", -1)
    short_ones = F.size(F.filter(tokens, lambda x: F.char_length(x) <= 2)) / F.size(tokens)
    few = (letters <= 2) & (digits <= 2)
    return (
        (n < 2) | (letters + digits == 0) | solid.rlike(r"^[A-Za-z]{1,2}$|^[A-Za-z]\)$") | ((ratio < 0.30) & (letters < 4) & (digits < 2))
        | ((F.size(tokens) >= 5) & (short_ones >= 0.8) & few) | (solid.rlike("[©®™]") & few) | ((ratio < 0.35) & few) | solid.rlike("^[©®°□■▪▫◆◇]+$")
    )
