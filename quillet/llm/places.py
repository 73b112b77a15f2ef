"""Rows of a table named by the place they stand at, and chosen again by it without moving any of them.

A place is (file, at): the 64-bit hash of a file's path and the row's number in that file. A stage works on places and a few
numbers a row; what it decides comes back as one bit for each row of a page of ``PAGE`` rows, and is applied by a broadcast
join of pages in the scan of the same files. So only places are shuffled, whatever the texts hold, and every row is told from others, also those
that share an id or have none.

Bound: a page is 4 KB for 32,768 rows. At most ``SENT`` bytes of pages, counted before, are sent at once; a table with more is read
in as many groups of whole files, each with its own pages, and every file is read in one of them only.

A table that is not read from Parquet files directly (or comes out of a join, a generator or a union) is written to the shared folder first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged

PAGE, SENT = 1 << 15, 64 << 20
_DIRECT = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of ``taken`` equals, in any case."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def _direct(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file, untouched by joins, generators or unions."""
    plan = getattr(docs, "_jdf", None)
    if plan is None:
        return False
    open_ = [plan.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() not in _DIRECT:
            return False
        children = node.children()
        open_ += [children.apply(k) for k in range(children.size())]
    return "parquet" in plan.queryExecution().optimizedPlan().toString().lower() and bool(docs.inputFiles())


def _bits(names: dict[str, str], at: Column, k: int) -> Column:
    """The bit of the row numbered ``at`` in plane k of its page."""
    byte = F.conv(F.hex(F.substring(F.col(names[f"plane_{k}"]), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("long") % 2


def numbered(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """The rows of a written table whose ``number`` (long, dense by runs) is among those of ``wanted``, by broadcast pages as below.

    Beyond the bound the table is read by ranges of numbers, which its row groups' statistics tell apart.
    """
    page = F.floor(F.col(number) / PAGE)
    pages = wanted.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.col(number) % PAGE).alias("plane_0"))
    pages = staged(pages, "pages")
    groups = max(1, math.ceil(pages.count() * PAGE // 8 / SENT))
    cuts = pages.approxQuantile("page", [g / groups for g in range(1, groups)], 0.001) if groups > 1 else []
    names = {c: fresh(rows.columns, f"{c}_") for c in pages.columns}
    sent = pages.select(*[F.col(c).alias(n) for c, n in names.items()])
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        some, few = rows, sent
        if low is not None:
            some, few = some.where(F.col(number) >= int(low) * PAGE), few.where(F.col(names["page"]) >= int(low))
        if high is not None:
            some, few = some.where(F.col(number) < int(high) * PAGE), few.where(F.col(names["page"]) < int(high))
        met = some.join(F.broadcast(few), page == F.col(names["page"])).where(_bits(names, F.col(number) % PAGE, 0) > 0)
        met = met.select(*rows.columns)
        out = met if out is None else out.unionAll(met)
    return out


class Places:
    """``rows``: the columns of ``docs`` and, under names that clash with none, each row's place."""

    def __init__(self, docs: DataFrame):
        if not _direct(docs):
            docs = staged(docs, "placed")
        self.docs, self.columns = docs, docs.columns
        self.file, self.at = fresh(docs.columns, "place_file"), fresh(docs.columns, "place_at")
        self.seed = self._seed()
        self.rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], self._hashed().alias(self.file), F.col("_metadata.row_index").alias(self.at))

    def _hashed(self) -> Column:
        return F.xxhash64(F.lit(self.seed), F.col("_metadata.file_path"))

    def _seed(self) -> int:
        """A seed under which no two of the files have one hash."""
        files = self.docs.select(F.col("_metadata.file_path").alias("path")).distinct()
        for seed in range(16):
            many, kinds = files.agg(F.count(F.lit(1)), F.count_distinct(F.xxhash64(F.lit(seed), F.col("path")))).first()
            if many == kinds:
                return seed
        raise ValueError("no seed tells all files apart")

    def bare(self, *columns: str | Column) -> DataFrame:
        """Some columns (expressions) with each row's place as (file, at)."""
        return self.rows.select(*columns, F.col(self.file).alias("file"), F.col(self.at).alias("at"))

    def repeated(self, wanted: DataFrame, places: bool = False, others: bool = False) -> DataFrame:
        """The rows at the places of ``wanted`` (file, at, copies long), each as often as its copies say.

        ``places``: with their places. ``others``: all other rows instead, once.
        """
        most = wanted.agg(F.max("copies")).first()[0] or 0
        planes = max(1, int(most).bit_length())
        bits = [F.bitmap_construct_agg(F.when(F.col("copies").bitwiseAND(1 << k) > 0, F.col("at") % PAGE)).alias(f"plane_{k}") for k in range(planes)]
        pages = staged(wanted.where("copies > 0").groupBy("file", F.floor(F.col("at") / PAGE).alias("page")).agg(*bits), "pages")
        groups = max(1, math.ceil(pages.count() * planes * PAGE // 8 / SENT))
        out = None
        for g in range(groups):
            some = self._chosen(pages, planes, None if groups == 1 else (g, groups), places, others)
            out = some if out is None else out.unionAll(some)
        if planes == 1 or others:
            return out
        n = fresh(self.columns, "place_copies")
        each = out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
        return each.select(*[F.col(f"`{c}`") for c in self.columns])

    def _chosen(self, pages: DataFrame, planes: int, group: tuple[int, int] | None, places: bool, others: bool) -> DataFrame:
        rows = self.rows
        if group is not None:  # a filter on the path alone: other files aren't opened
            rows = rows.where(F.pmod(F.col(self.file), F.lit(group[1])) == group[0])
            pages = pages.where(F.pmod(F.col("file"), F.lit(group[1])) == group[0])
        names = {c: fresh(self.rows.columns, f"place_{c}_") for c in pages.columns}
        sent = pages.select(*[F.col(c).alias(n) for c, n in names.items()])
        met = rows.join(F.broadcast(sent), (F.col(self.file) == F.col(names["file"])) & (F.floor(F.col(self.at) / PAGE) == F.col(names["page"])), "left" if others else "inner")
        at = F.col(self.at) % PAGE
        copies = sum((_bits(names, at, k) * (1 << k) for k in range(planes)), F.lit(0).cast("long"))
        n = fresh(self.columns, "place_copies")
        met = met.withColumn(n, F.coalesce(copies, F.lit(0)))
        kept = met.where(F.col(n) == 0 if others else F.col(n) > 0)
        own = [F.col(f"`{c}`") for c in (self.rows.columns if places else self.columns)]
        return kept.select(*own, F.col(n)) if planes > 1 and not others else kept.select(*own)

    def only(self, wanted: DataFrame, places: bool = False, others: bool = False) -> DataFrame:
        """The rows at the places of ``wanted`` (file, at); options as above."""
        return self.repeated(wanted.select("file", "at", F.lit(1).cast("long").alias("copies")), places, others)
