"""The scope filter: metadata with content, of the right status, type and subject; named, gated and deduplicated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from . import dedup, gates, joins


@dataclass(frozen=True)
class ScopeColumns:
    """Which columns play which part, so that other tables can be filtered alike."""

    id: str = "id"
    title: str = "title"
    kind: str = "loai_van_ban"
    number: str = "so_ky_hieu"
    field: str = "linh_vuc"
    sector: str = "nganh"
    status: str = "tinh_trang_hieu_luc"


def has_status(status: Column, wanted: str) -> Column:
    return F.coalesce(status.contains(wanted), F.lit(False))


def in_list(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(False))


def in_list_null_as_none(c: Column, values: tuple[str, ...]) -> Column:
    """A null counts as the word None, which the list may hold."""
    return F.coalesce(c, F.lit("None")).isin(list(values))


def in_scope(c: ScopeColumns, scope: config.Scope) -> Column:
    about = X.contains_any(F.col(c.title), scope.title_keywords) | in_list(F.col(c.field), scope.fields) | in_list(F.col(c.sector), scope.sectors)
    return about & has_status(F.col(c.status), scope.status) & in_list_null_as_none(F.col(c.kind), scope.document_types)


def scope_filter(metadata: DataFrame, content: DataFrame, scope: config.Scope | None = None, columns: ScopeColumns | None = None, ordinal: list[str] | None = None, check: bool = False) -> DataFrame:
    """Adds law_id and ten_van_ban; one row of each pair of these, the first by ``ordinal`` (default: the id).

    With ``check`` the number of rows and the uniqueness of ids are asserted first, over the rows before deduplication.
    """
    scope, c = scope or config.Scope(), columns or ScopeColumns()
    kept = joins.having_content(metadata, content, c.id).filter(in_scope(c, scope))
    named = kept.withColumn("law_id", F.col(c.number)).withColumn("ten_van_ban", X.full_name(F.col(c.kind), F.col(c.number), F.col(c.title)))
    if check:
        gates.require_range(named, scope.least_rows, scope.most_rows)
        gates.require_unique(named, [c.id])
    return dedup.keep_first(named, ["law_id", "ten_van_ban"], ordinal or [c.id])
