"""Text functions as column expressions. Positions and lengths count code points.

Regexes over Unicode text take the flags d (only newline ends a line), m, i, u and U (Unicode case, spaces and words).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: Private-use marks of mark_and_split: before a match, after each of its parts, before what follows it.
BEFORE, PART, AFTER = "\ue000", "\ue001", "\ue002"
FLAGS = "(?dimuU)"


def let(value: Column, body) -> Column:
    """``body(value)``, the value being worked out once. A column that a lambda uses would otherwise be worked out for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode whitespace at either end (Spark's trim knows the space only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalise_spaces(c: Column) -> Column:
    """Runs of spaces and tabs become one space, runs of newlines one newline; other whitespace stays."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{2,}", "\n")


def collapse_repeated_lines(c: Column) -> Column:
    """Drops a line that equals the one before it."""
    return let(F.split(c, "\n", -1), lambda lines: F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.element_at(lines, F.greatest(i, F.lit(1))))), "\n"))


def clean_text(c: Column) -> Column:
    return collapse_repeated_lines(normalise_spaces(c))


def quoted(c: Column) -> Column:
    """A regex that matches the column's value literally."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def clean_title(title: Column, kind: Column, number: Column) -> Column:
    """The title without its leading 'kind [số] number' and one leading dash or colon; null titles become ''."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    prefix = F.concat(F.lit("(?iuU)^"), quoted(text(kind)), F.lit(r"\s*(?:số\s*)?"), quoted(text(number)))
    rest = strip(F.regexp_replace(title, prefix, F.lit("")))
    return F.coalesce(strip(F.regexp_replace(rest, r"(?U)^[-–:]\s*", "")), F.lit(""))


def full_name(kind: Column, number: Column, title: Column) -> Column:
    """'kind number clean-title'; null parts read None, as in the source data."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return strip(F.concat(text(kind), F.lit(" "), text(number), F.lit(" "), clean_title(title, kind, number)))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive substring test for any of the words; null gives false."""
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words), F.lit(False)), F.lit(False))


def law_like(title: Column, pattern: str = config.LAW_LIKE_PATTERN) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?iuU)" + pattern)


def mark_and_split(text: Column, pattern: str, groups: int) -> Column:
    """All matches with positions: array of (start, stop, groups, body), body being the text up to the next match.

    Each match is rewritten as BEFORE whole PART group PART group ... AFTER, then the text is split at BEFORE. ``start`` is the
    length of all that comes earlier. A text without a match gives an empty array.
    """
    whole = "".join(f"{PART}${i + 2}" for i in range(groups))
    plain = F.translate(text, BEFORE + PART + AFTER, "")
    marked = F.regexp_replace(plain, f"{FLAGS}({pattern})", f"{BEFORE}$1{whole}{AFTER}")
    return let(F.split(marked, BEFORE, -1), lambda split: _matches(split, groups))


def _matches(split: Column, groups: int) -> Column:
    cut = F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda x: F.struct(F.split(F.substring_index(x, AFTER, 1), PART, -1).alias("head"), F.substring_index(x, AFTER, -1).alias("body")))
    size = lambda x: F.length(x["head"][0]) + F.length(x["body"])
    first = F.length(F.element_at(split, 1))
    empty = F.array().cast("array<struct<start:int,stop:int,groups:array<string>,body:string>>")

    def step(acc: Column, x: Column) -> Column:
        item = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["head"][0])).alias("stop"), F.slice(x["head"], 2, groups).alias("groups"), x["body"].alias("body"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["found"], F.array(item)).alias("found"))

    folded = F.aggregate(cut, F.struct(first.alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return F.coalesce(folded, empty)


def last_before(headers: Column, position: Column) -> Column:
    """As-of lookup, backward and strict: the label of the last header that starts before the position, else ''."""
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: h["start"] < position), F.lit(-1))["label"], F.lit(""))


def headers(text: Column, pattern: str) -> Column:
    return F.transform(mark_and_split(text, pattern, 1), lambda m: F.struct(m["start"].alias("start"), strip(m["groups"][0]).alias("label")))


def non_blank(parts: Column) -> Column:
    """Stripped elements without the empty ones."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clauses(text: Column, pattern: str = config.CLAUSE_START) -> Column:
    """Numbered clauses; a text without any is one piece, a blank one none."""
    return non_blank(F.split(text, "(?dmU)" + pattern, -1))


def sentences(text: Column, pattern: str = config.SENTENCE_END) -> Column:
    return non_blank(F.split(text, "(?U)" + pattern, -1))


def tokens(text: Column) -> Column:
    """Whitespace tokens: the default tokenizer."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), lambda x: x != "")


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def token_blocks(text: Column, most: int) -> Column:
    """Runs of ``most`` tokens, joined by a space."""

    def blocks(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t), F.lit(most))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(t, s, most), " "))

    return let(tokens(text), blocks)


def breadcrumb(kind: Column, name: Column, levels: list[Column], number: Column, title: Column) -> Column:
    """Non-blank parts joined by ' > '; the last is 'number. title', or the number alone."""
    number, title = blank_to_null(number), blank_to_null(title)
    tail = F.when(title.isNotNull(), F.concat(number, F.lit(". "), title)).otherwise(number)
    return F.concat_ws(" > ", *(blank_to_null(c) for c in [kind, name, *levels]), tail)


def enriched_text(short: Column, key: Column, body: Column) -> Column:
    """Optional summary, optional bullet list, and the whole text, joined by blank lines."""
    bullets = F.array_join(F.transform(key, lambda k: F.concat(F.lit("• "), k)), "\n")
    return F.concat_ws(
        "\n\n",
        F.when(F.coalesce(short, F.lit("")) != "", F.concat(F.lit("[TÓM TẮT] "), short)),
        F.when(F.size(key) > 0, F.concat(F.lit("[Ý CHÍNH]\n"), bullets)),
        F.concat(F.lit("[NỘI DUNG ĐẦY ĐỦ]\n"), body),
    )


def _reply(candidate: Column) -> Column:
    short, key = F.get_json_object(candidate, "$.short"), F.get_json_object(candidate, "$.key")
    listed = F.from_json(key, "array<string>")
    parsed = F.struct(short.alias("short"), F.when(listed.isNotNull(), listed).otherwise(F.array(key)).alias("key"))
    return F.when(short.isNotNull() & key.isNotNull(), parsed)


def summary_reply(reply: Column) -> Column:
    """struct(short, key) from a model's reply: the first flat JSON object with both fields, else the widest braces; else null."""
    strict, widest = (F.regexp_extract(reply, p, 1) for p in config.REPLY_PATTERNS)
    return F.coalesce(_reply(strict), _reply(widest))


def summary_prompt(text: Column, most: int) -> Column:
    return filled(config.SUMMARY_PROMPT, text=F.substring(text, 1, most))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column; the columns' own braces stay."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def law_numbers(text: Column, pattern: str = config.LAW_NUMBER_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def separators(c: Column, mark: str = "|") -> Column:
    """How often the mark occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
