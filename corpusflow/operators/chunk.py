"""Chunking under a token budget, as folds over the pieces of one article. Nothing is shuffled.

Token counts come from the text functions' whitespace tokens; ``count`` may be any column function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

Counter = Callable[[Column], Column]


def pack_groups(sizes: Column, most: int) -> Column:
    """Group number of each size: a group takes sizes while their sum stays within ``most``; only a group's first may exceed it."""
    empty = F.array().cast("array<int>")

    def step(acc: Column, n: Column) -> Column:
        fits = (F.size(acc["ids"]) == 0) | (acc["sum"] + n <= most)
        group = F.when(F.size(acc["ids"]) == 0, 0).when(fits, acc["group"]).otherwise(acc["group"] + 1)
        return F.struct(group.alias("group"), F.when(fits, acc["sum"] + n).otherwise(n).cast("int").alias("sum"), F.concat(acc["ids"], F.array(group)).alias("ids"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("group"), F.lit(0).alias("sum"), empty.alias("ids")), step, lambda acc: acc["ids"])


def grouped(items: Column, ids: Column) -> Column:
    """Arrays of the items of each group; groups are runs of items."""

    def cut(x: Column) -> Column:
        last = F.coalesce(F.array_max(x["ids"]), F.lit(-1))
        numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        begin = lambda g: F.array_position(x["ids"], g).cast("int")
        end = lambda g: F.when(g == last, F.size(x["ids"]) + 1).otherwise(F.array_position(x["ids"], g + 1)).cast("int")
        return F.transform(numbers, lambda g: F.slice(x["items"], begin(g), end(g) - begin(g)))

    return X.let(F.struct(items.alias("items"), ids.alias("ids")), cut)


def group_starts(sizes: Column, most: int) -> Column:
    """First place (from 1) of each group that ``pack_groups`` makes. The fold's array grows with the groups, not with the sizes."""

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["at"] > 0) & (acc["sum"] + n <= most)
        return F.struct((acc["at"] + 1).alias("at"), F.when(fits, acc["sum"] + n).otherwise(n).cast("int").alias("sum"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"] + 1))).alias("starts"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])


def packed(items: Column, most: int, size: Callable[[Column], Column]) -> Column:
    """Arrays of items packed into groups of at most ``most`` in all."""

    def cut(x: Column) -> Column:
        after = lambda i: F.coalesce(F.try_element_at(x["starts"], i + 2), F.size(x["items"]) + 1)
        return F.transform(x["starts"], lambda start, i: F.slice(x["items"], start, after(i) - start))

    return X.let(items, lambda all_: X.let(F.struct(all_.alias("items"), group_starts(F.transform(all_, size), most).alias("starts")), cut))


def split_long(piece: Column, most: int, count: Counter = X.count_tokens) -> Column:
    """Pieces of at most ``most`` tokens: whole sentences packed together, longer sentences cut into blocks of tokens."""

    def parts(units: Column) -> Column:
        sized = F.transform(units, lambda s: F.struct(s.alias("s"), count(s).alias("n")))
        # a longer sentence weighs more than anything may join, so it is a group of its own
        groups = packed(sized, most, lambda x: F.least(x["n"], F.lit(most + 1)))
        one = lambda g: F.when(g[0]["n"] > most, X.token_blocks(g[0]["s"], most)).otherwise(F.array(F.array_join(F.transform(g, lambda x: x["s"]), "\n")))
        return F.when(F.size(units) == 0, X.token_blocks(piece, most)).otherwise(F.flatten(F.transform(groups, one)))

    return F.when(count(piece) <= most, F.array(piece)).otherwise(X.let(X.sentences(piece), parts))


def pieces_of(text: Column, most: int, count: Counter = X.count_tokens) -> Column:
    return F.flatten(F.transform(X.clauses(X.strip(text)), lambda p: split_long(p, most, count)))


def overlapped(chunks: Column, most: int, count: Counter = X.count_tokens) -> Column:
    """Each chunk with the last piece of the one before it in front, where both fit."""

    def widen(all_: Column, chunk: Column, i: Column) -> Column:
        wide = F.concat(F.array(F.element_at(F.element_at(all_, F.greatest(i, F.lit(1))), -1)), chunk)
        return F.when((i > 0) & (count(F.array_join(wide, "\n\n")) <= most), wide).otherwise(chunk)

    return X.let(chunks, lambda all_: F.transform(all_, lambda chunk, i: widen(all_, chunk, i)))


def chunk_articles(articles: DataFrame, most: int = 1024, count: Counter = X.count_tokens) -> DataFrame:
    """One row per chunk: the article's columns, breadcrumb, chunk_id, part_idx and chunk_text. A blank doc_uid is an error."""
    col = F.col
    uid = F.when(F.coalesce(X.strip(col("doc_uid")), F.lit("")) == "", F.raise_error(F.lit("each article needs a doc_uid")).cast("string")).otherwise(X.strip(col("doc_uid")))
    rows = articles.withColumn("breadcrumb", X.breadcrumb(col("loai_van_ban"), col("ten_van_ban"), [col("phan"), col("chuong"), col("muc")], col("dieu_so"), col("dieu_ten")))
    pieces = pieces_of(F.coalesce(col("noi_dung"), F.lit("")), most, count)
    # outer, as for posexplode the optimizer would infer a filter that works out all chunks once more
    rows = rows.withColumn("_chunks", overlapped(packed(pieces, most, count), most, count))
    rows = rows.select(*articles.columns, "breadcrumb", uid.alias("_uid"), F.posexplode_outer("_chunks").alias("part_idx", "_chunk")).filter("part_idx is not null")
    body = F.array_join("_chunk", "\n\n")
    return rows.select(
        *articles.columns, "breadcrumb", F.concat("_uid", F.lit("#"), col("part_idx").cast("string")).alias("chunk_id"), "part_idx",
        F.when(col("breadcrumb") != "", F.concat("breadcrumb", F.lit("\n"), body)).otherwise(body).alias("chunk_text"),
    )
