"""The digest: new signals of a window, corroborated, in venues, in display order."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.functions.fields import field, kind, parsed
from harbinger.functions.textnorm import collapse, matchable_address, matchable_name, truncated
from harbinger.operators import corroborate as co
from harbinger.operators import venues as ve
from harbinger.operators.store import Store
from harbinger.operators.tables import written

#: Sources whose weak rows corroboration never lifts.
NOT_RESCUED = ("business",)
DESCRIBED = ("permit", "electrical", "plumbing", "planning")
SNIPPET = 120
# Pages of a row, by source.
URLS = {
    "abc": "https://www.abc.ca.gov/licensing/license-lookup/single-license/?RPTTYPE=12&LICENSE=", "permit": "https://dbiweb02.sfgov.org/dbipts/default.aspx?page=Permit&PermitNumber=", "planning": "https://sfplanninggis.org/pim?search=",
}


def selection_floor(min_score: int) -> int:
    """The lowest stored score that corroboration could lift to min_score; at least 1."""
    return max(1, min_score - co.ADDRESS_BONUS - co.NAME_BONUS)


def url_for(source: Column, external_id: Column) -> Column:
    out = F.lit("")
    for name, base in URLS.items():
        out = F.when(source == name, F.concat(F.lit(base), external_id)).otherwise(out)
    return out


def snippet(source: Column, raw: Column) -> Column:
    """A line of the description of permit-like sources; null where there is none."""
    row = parsed(raw)
    text = collapse(F.when(kind(row, "description") == "STRING", field(row, "description")))
    return F.when(source.isin(*DESCRIBED) & (text != ""), truncated(text, SNIPPET))


def candidates(signals: DataFrame, cutoff: str, today: str, floor: int, neighborhood: str | None = None) -> DataFrame:
    """Undelivered rows of the window, as digest entries; a plain filter that reaches the scan. The neighborhood is part of a
    pattern, so that % and _ in it stand for any characters and any one."""
    rows = signals.where(~F.col("seen") & (F.col("score") >= floor) & (F.col("date") >= cutoff) & (F.col("date") <= today))
    if neighborhood is not None:
        rows = rows.where(F.col("neighborhood").ilike(f"%{neighborhood}%"))
    return rows.select("source", F.col("external_id").alias("id"), "name", "address", "date", "neighborhood", "score", "reasons", snippet(F.col("source"), F.col("raw")).alias("description"), url_for(F.col("source"), F.col("external_id")).alias("url"))


def rescued(entries: DataFrame, min_score: int) -> DataFrame:
    return entries.where((F.col("score") >= min_score) | ~F.col("source").isin(*NOT_RESCUED))


def in_neighborhood(entries: DataFrame, name: str) -> DataFrame:
    """Entries whose neighborhood, inherited or not, holds the name as it stands, in any case."""
    return entries.where(F.contains(F.lower("neighborhood"), F.lower(F.lit(name))))


@dataclass
class Digest:
    """The entries after corroboration, with their venue and their position in it, and the venues shown, with the keys of
    their order."""

    entries: DataFrame
    shown: DataFrame

    def filings(self) -> DataFrame:
        return ve.filings(self.shown, self.entries)

    @contextlib.contextmanager
    def kept(self) -> Iterator[Digest]:
        """The digest computed once, for all that is made of it within the block; stays as it is whatever is committed."""
        entries, shown = self.entries.persist(), self.shown.persist()
        try:
            entries.count()
            shown.count()
            yield self
        finally:
            entries.unpersist()
            shown.unpersist()


def cutoff_of(as_of: str, days: int) -> str:
    return (datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)).isoformat()


def keys_of(entries: DataFrame, key: Column) -> DataFrame:
    return entries.select(F.explode(F.array(key)).alias("key")).where("key <> ''").distinct()


def assembled(entries: DataFrame, addresses: DataFrame, names: DataFrame, hoods: DataFrame, min_score: int, neighborhood: str | None) -> Digest:
    """Operator order matters: history is unfiltered, inheritance comes before the neighborhood filter, that before
    clustering, and min_score is asked of venues, whose weaker filings ride along. The entries are written here, as all
    that follows reads them again and again and nothing else."""
    entries = written(co.inherit(co.corroborate(entries, addresses, names), hoods), "entries")
    if neighborhood:
        entries = in_neighborhood(entries, neighborhood)
    assigned = ve.assign(entries)
    return Digest(ve.members(assigned), ve.display_order(ve.summarize(assigned), min_score))


def build(signals: DataFrame, as_of: str, days: int = 7, min_score: int = 2, neighborhood: str | None = None) -> Digest:
    """Of any signals: their whole history is keyed and ranked."""
    entries = rescued(candidates(signals, cutoff_of(as_of, days), as_of, selection_floor(min_score)), min_score)
    history = co.corroborators(signals)
    return assembled(entries, co.address_index(history), co.name_index(history), co.neighborhoods(signals), min_score, neighborhood)


def from_store(store: Store, as_of: str, days: int = 7, min_score: int = 2, neighborhood: str | None = None) -> Digest:
    """The same of a store: only files that can have rows of the window are read, and of its lists only the entries' keys."""
    cutoff = cutoff_of(as_of, days)
    entries = rescued(candidates(store.window(cutoff, as_of), cutoff, as_of, selection_floor(min_score)), min_score)
    at, named = keys_of(entries, matchable_address(F.col("address"))), keys_of(entries, matchable_name(F.col("name")))
    addresses, names = co.listed_index(store.listed("address"), at), co.listed_index(store.listed("name"), named)
    return assembled(entries, addresses, names, co.listed_neighborhoods(store.listed("hood"), at), min_score, neighborhood)
