"""Tokenizers, normalisers, keys and text predicates as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the default alphabet, the niggahita spellings, and the spelling folds of comparison keys.
LETTERS = "a-zāīūṭḍṇṅñṃḷ"
NIGGAHITA = "ṁŋ"
FOLDED = "ṃṃ"


def tokens(text: Column, letters: str = LETTERS) -> Column:
    """Lower-case runs of the alphabet's letters, in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]+"), F.lit(0))


def count_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Number of runs of letters in either case, without lower-casing."""
    return F.regexp_count(text, F.lit(f"(?iu)[{letters}]+")).cast("long")


def placed(gaps: Column, hits: Column) -> Column:
    """Where each of the ``hits`` starts in the text that they and the ``gaps`` before them make up: ``array<int>``, from 0.

    Blocks of about the square root of the hits are placed first, then the hits of each, so that no array grows by
    more steps than that.
    """
    none, known = F.expr("cast(array() as array<int>)"), F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"))), lambda p: p)

    def place(p: Column) -> Column:
        n = F.size(p["hits"])
        wide = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
        every = F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int"))
        block = lambda b: F.sequence(b * wide, F.least(n, (b + 1) * wide) - 1)
        size = lambda i: F.length(F.get(p["gaps"], i)) + F.length(F.get(p["hits"], i))
        sums = F.transform(every, lambda b: F.aggregate(block(b), F.lit(0), lambda a, i: a + size(i)))
        grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        firsts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), grow, lambda a: a["out"])

        def step(a: Column, i: Column) -> Column:
            return F.struct((a["at"] + size(i)).alias("at"), F.array_append(a["out"], a["at"] + F.length(F.get(p["gaps"], i))).alias("out"))

        walk = lambda f: F.flatten(F.transform(every, lambda b: F.aggregate(block(b), F.struct(F.get(f, b).alias("at"), none.alias("out")), step, lambda a: a["out"])))
        return F.when(n == 0, none).otherwise(F.get(F.transform(F.array(firsts), walk), F.lit(0)))

    return F.get(F.transform(known, place), F.lit(0))


def token_offsets(text: Column, letters: str = LETTERS) -> Column:
    """``array<struct<token, start>>``: tokens of the text with the place of their first character, from 0; null gives null."""
    hits, gaps = F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]+"), F.lit(0)), F.split(F.lower(text), f"[{letters}]+", -1)
    return F.when(text.isNotNull(), F.arrays_zip(hits.alias("token"), placed(gaps, hits).alias("start")))


def strip_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Tokens of marked-up text: tags become spaces, one niggahita spelling, split at what is no letter."""
    plain = F.lower(F.translate(F.regexp_replace(text, "<[^>]+>", " "), "ṁ", "ṃ"))
    return F.filter(F.split(plain, f"[^{letters}]+"), lambda x: x != "")


def collation_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Tokens for comparing editions: spellings folded, hyphens and asterisks deleted so that compounds join."""
    plain = F.replace(F.translate(F.lower(text), NIGGAHITA + "-*", FOLDED), F.lit("saṅgh"), F.lit("saṃgh"))
    return F.regexp_extract_all(plain, F.lit(f"[{letters}]+"), F.lit(0))


def folded_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Tokens with both niggahita spellings folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), NIGGAHITA, FOLDED), F.lit(f"[{letters}]+"), F.lit(0))


def normalise(text: Column) -> Column:
    """One niggahita spelling, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "ṁ", "ṃ"), r"(?U)\s+", " "))


def title_key(title: Column) -> Column:
    """Title without its genre suffix, ordinal prefix and spaces, in lower case."""
    t = F.regexp_replace(F.trim(F.lower(title)), r"\s*sutta[ṃm]?\.?\s*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^(paṭhama|dutiya|tatiya|catuttha|pañcama)\s*", ""), r"\s+", "")


def comparison_key(word: Column) -> Column:
    """Spelling-independent key of a word; null and empty give an empty key."""
    w = F.translate(F.lower(word), NIGGAHITA, FOLDED)
    return F.coalesce(F.replace(F.replace(w, F.lit("saṅgh"), F.lit("saṃgh")), F.lit("saṅk"), F.lit("saṃk")), F.lit(""))


def spelling_variant(a: Column, b: Column) -> Column:
    """True where two words differ in spelling only."""
    return comparison_key(a) == comparison_key(b)


def markup_to_text(html: Column) -> Column:
    """Tags dropped, four entities decoded, white space collapsed."""
    t = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def is_verse(text: Column, share: float = 0.15) -> Column:
    """Commas and semicolons per word above ``share``; wordless and null text is no verse."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.coalesce((words > 0) & (F.regexp_count(text, F.lit("[,;]")) / words > share), F.lit(False))


def escape_latex(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\x00"))
    # Characters that LaTeX reads as commands, and how they are written.
    for char, written in (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        out = F.replace(out, F.lit(char), F.lit(written))
    return F.replace(out, F.lit("\x00"), F.lit(r"\textbackslash{}"))


def snippet(text: Column, word: Column, around: int = 30, fallback: int = 120) -> Column:
    """Characters around the first hit of ``word``, with ellipses where cut; the text's start without a hit."""
    at = F.instr(text, word)
    low = F.greatest(F.lit(1), at - around)
    high = F.least(F.length(text), at + F.length(word) - 1 + around)
    cut = F.concat(F.when(low > 1, "...").otherwise(""), F.substring(text, low, high - low + 1), F.when(high < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, fallback))


def roman_value(numeral: Column) -> Column:
    """Value of a Roman numeral in either case; 0 for anything else."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).otherwise(F.when(c == "M", 1000).otherwise(0))
    digits = F.transform(F.split(F.upper(numeral), ""), lambda c: value(c))
    total = F.aggregate(F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(numeral.rlike("(?i)^[ivxlcdm]+$"), total).otherwise(0)


def in_range(unit: Column, span: Column) -> Column:
    """True where ``unit`` (letters, then a number) lies in a span such as ``abc1-20``, bounds included."""
    prefix = F.regexp_extract(span, r"^([a-z]+)(\d+)-(\d+)$", 1)
    low, high = (F.expr("1") * F.regexp_extract(span, r"^([a-z]+)(\d+)-(\d+)$", k).try_cast("int") for k in (2, 3))
    own, number = F.regexp_extract(unit, r"^([a-z]+)(\d+)$", 1), F.regexp_extract(unit, r"^([a-z]+)(\d+)$", 2).try_cast("int")
    return F.coalesce((prefix != "") & (own == prefix) & number.between(low, high), F.lit(False))
