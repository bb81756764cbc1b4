"""Text normalisation as Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the web platform defines it: wider than Java's ``\s``.
WS_CHARS = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]"
#: The same characters as a string.
WS_TEXT = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _plain(ch: str) -> str:
    decomposed = unicodedata.normalize("NFKD", ch)
    return "".join(c for c in decomposed if not 0x0300 <= ord(c) <= 0x036F)


@cache
def _fold_table() -> tuple[str, str, list[str], list[str]]:
    """Characters beyond ASCII whose compatibility form has ASCII letters or digits.

    First those with one character as (source, target) strings, then those with several as two lists; in these, what is
    neither letter nor digit is a space.
    """
    source, target, long_source, long_target = [], [], [], []
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        plain = "".join(c if c.isascii() and c.isalnum() else " " for c in _plain(chr(point)))
        if not plain.strip():
            continue
        if len(plain) == 1:
            source.append(chr(point))
            target.append(plain)
        else:
            long_source.append(chr(point))
            long_target.append(plain)
    return "".join(source), "".join(target), long_source, long_target


def _runs(points: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers; ``points`` are rising."""
    firsts = [p for i, p in enumerate(points) if not i or points[i - 1] + 1 < p]
    lasts = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] > p + 1]
    return list(zip(firsts, lasts, strict=True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""

    def trimmed(x: Column) -> Column:
        # A regular expression tries every character; it is needed only for its "$", which also stands before a last U+0085.
        return F.when(x.endswith("\u0085"), F.regexp_replace(x, f"^{WS}+|{WS}+$", "")).otherwise(F.trim(x, F.lit(WS_TEXT)))

    return let(c, trimmed)


def fold_accents(c: Column) -> Column:
    """Compatibility-decompose letters and digits of all of Unicode; plain ASCII skips the work."""
    source, target, long_source, long_target = _fold_table()
    folded = F.translate(F.regexp_replace(c, r"[\u0300-\u036f]+", ""), source, target)

    def expanded(x: Column) -> Column:
        # Only the rare characters that become several are looked up, each distinct one once.
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(several), F.lit(0)))
        # Constants of ``create_map`` are put together once; those of ``map_from_arrays`` again for each row.
        forms = F.create_map(*[F.lit(c) for pair in zip(long_source, long_target, strict=True) for c in pair])
        return F.aggregate(found, x, lambda out, ch: F.replace(out, ch, F.try_element_at(forms, ch)))

    # As ranges: a class of single characters is tried one by one.
    several = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _runs([ord(ch) for ch in long_source])) + "]"
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(let(folded, lambda x: F.when(x.rlike(several), expanded(x)).otherwise(x)))


def normalize_text(c: Column) -> Column:
    """Matching key: no accents, lower case, apostrophes dropped, one space between words."""
    lowered = F.lower(fold_accents(c))
    # ``translate`` would look every character up.
    bare = F.replace(F.replace(lowered, F.lit("'"), F.lit("")), F.lit("\u2019"), F.lit(""))
    # Single spaces stay as they are, so that a text that is a key already is only read.
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))


def normalize_variety(c: Column) -> Column:
    """Variety key: known spelling variants joined, e.g. ``SL-28`` and ``sl28`` are one."""
    key = normalize_text(c)
    return (
        F.when(key == "geisha", F.lit("gesha"))
        .otherwise(F.regexp_replace(key, r"^(sl|ruiru|batian) (\d+)$", "$1$2"))
    )


def singularize(word: Column) -> Column:
    """English plural stripping for lexicon lookup."""
    size = F.length(word)
    chop = lambda n: F.substring(word, F.lit(1), size - n)
    return (
        F.when(~word.endswith("s"), word)
        .when(word.endswith("ies") & (size > 4), F.concat(chop(3), F.lit("y")))
        .when(word.rlike("(ch|sh|x|ss)es$"), chop(2))
        .when(word.endswith("oes") & (size > 4), chop(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (size > 3), chop(1))
        .otherwise(word)
    )


def singularize_words(words: Column) -> Column:
    return F.transform(words, singularize)


def words_of(normalized: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def clean_url(c: Column) -> Column:
    """Scheme, lower-case host and path of a web address; NULL for anything else.

    Port, query, fragment and trailing slashes go. Other schemes and social
    profiles are rejected.
    """
    # Schemes, and hosts that are profiles rather than sites.
    other_scheme = r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:(?!\d)"
    social = r"(^|\.)(instagram|facebook|twitter|x|tiktok|yelp|linktr)\.(com|ee)$"
    shape = r"^(?i:(https?))://(?:[^/?#@]*@)?([^/?#:@\s<>^|%\\]+)(?::\d*)?([^?#]*)"

    def parts(raw: Column) -> Column:
        full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
        return F.struct(
            ((raw != "") & ~raw.rlike(other_scheme)).alias("ok"),
            F.lower(F.regexp_extract(full, shape, 1)).alias("scheme"),
            F.lower(F.regexp_extract(full, shape, 2)).alias("host"),
            F.regexp_replace(F.regexp_extract(full, shape, 3), "/+$", "").alias("path"),
        )

    def joined(u: Column) -> Column:
        usable = u["ok"] & (u["host"] != "") & u["path"].rlike("^(/|$)") & ~u["host"].rlike(social)
        return F.when(usable, F.concat(u["scheme"], F.lit("://"), u["host"], u["path"]))

    return let(let(trim_all(c), parts), joined)


def host_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def any_of(patterns: Sequence[str]) -> str | None:
    """A pattern that occurs where any of ``patterns`` does; None where they cannot be put together.

    Where all begin at a word's edge, that is looked for once.
    """
    if len(patterns) < 2 or any(re.search(r"\\[1-9k]", p) for p in patterns):
        return None
    edged = all(p.startswith(r"\b") and not _has_branches(p) for p in patterns)
    return (r"\b(?:" + "|".join(p[2:] for p in patterns) + ")") if edged else "|".join(f"(?:{p})" for p in patterns)


def _has_branches(pattern: str) -> bool:
    """Whether the pattern may have a ``|`` outside parentheses."""
    depth = 0
    for ch in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            return True
    return False


def first_match(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Value of the first rule whose pattern occurs in ``c``; NULL when none does."""

    def choose(x: Column) -> Column:
        out = F
        for pattern, value in rules:
            out = out.when(x.rlike(pattern), F.lit(value))
        return out if some is None else F.when(x.rlike(some), out)

    # Most texts match no rule: one pattern tells.
    some = any_of([pattern for pattern, _ in rules])
    return let(c, choose)


def all_matches(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Values of every matching rule, in rule order, without repeats."""

    def matches(x: Column) -> Column:
        found = F.array_distinct(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(v)) for p, v in rules])))
        return found if some is None else F.when(F.coalesce(x.rlike(some), F.lit(False)), found).otherwise(F.array().cast("array<string>"))

    some = any_of([pattern for pattern, _ in rules])
    return let(c, matches)


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that tells "no match" (NULL) from an empty match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)
