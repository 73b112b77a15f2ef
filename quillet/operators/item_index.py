"""The items' full-text index: title, metadata and text as columns of one index, kept up to date by batches.

An index is a folder. A batch adds items (in place of what was indexed under their ids) or removes them; it writes

- ``postings``: (token, item_id, field, positions, len) partitioned by a hash of the token, so a query reads its own tokens' partitions alone;
- ``items``: (item_id, len), what the batch holds;
- ``dead``: (item_id, was), the earlier batch of each item that this one replaces or removes: a tombstone, looked up by joins on the ids;
- a manifest row with the change in items and tokens, written last: a batch that failed before it doesn't exist, and is written over by the next.

Postings are never rewritten by a batch. A query leaves out dead ones by an anti-join on (item_id, batch); corpus figures are sums of the manifest,
so neither items nor tokens are counted again. ``merge`` writes the living rows as the next generation, in which
one batch holds all; the folders of earlier generations may be deleted then. One writer at a time.

Phrases are looked for inside a field; a term's frequency in an item is its sum over the fields asked for, its length that of all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillet.functions.text import tokens
from quillet.operators.relational import merged_text
from quillet.operators.search import nothing, phrases, ranked
from quillet.sources.shared import read_all

FIELDS = ("title", "metadata", "text")
#: Partitions of the tokens, and writers of a partition: a frequent token's postings are written by several tasks.
PARTS, WRITERS = 64, 8
_POSTINGS = "token string, item_id string, field int, len long, positions array<int>, batch int, part int"
_ITEMS = "item_id string, len long, batch int"
_DEAD = "item_id string, was int, batch int"
_MANIFEST = "generation int, batch int, kind string, items long, tokens long"


def canonical_items(items: DataFrame, texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(item_id, title, metadata, text) of the items, or of those in ``wanted`` (item_id): ids without an item give no row.

    texts: (item_id, source_order, sort_index, created_at, text), joined in that order.
    """
    rows = items.withColumnRenamed("id", "item_id")
    if wanted is not None:
        ids = wanted.select("item_id").distinct()
        rows, texts = rows.join(ids, "item_id", "left_semi"), texts.join(ids, "item_id", "left_semi")
    body = merged_text(texts, ["item_id"], ["source_order", "sort_index", "created_at"], "text")
    return rows.select("item_id", "title", F.coalesce("metadata", F.lit("")).alias("metadata")).join(body, "item_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


class ItemIndex:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    # state

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def _state(self) -> tuple[int, list]:
        """The generation, and the rows of its batches: one a batch since the last merge."""
        rows = self.manifest().collect()
        now = max((r["generation"] for r in rows), default=0)
        return now, sorted((r for r in rows if r["generation"] == now), key=lambda r: r["batch"])

    def figures(self) -> tuple[int, int]:
        """Items and tokens that live."""
        rows = self._state()[1]
        return sum(r["items"] for r in rows), sum(r["tokens"] for r in rows)

    def _read(self, what: str, schema: str, generation: int, rows: list) -> DataFrame:
        kinds = ("add", "remove") if what == "dead" else ("add", "merge")
        base = f"{self.path}/generation={generation}/{what}"
        return read_all(self.spark, schema, base, [f"{base}/batch={r['batch']}" for r in rows if r["kind"] in kinds])

    def _living(self, what: str, schema: str, generation: int, rows: list, narrow: Column | None = None) -> DataFrame:
        found = self._read(what, schema, generation, rows)
        found = found if narrow is None else found.where(narrow)
        dead = self._read("dead", _DEAD, generation, rows).select("item_id", F.col("was").alias("batch"))
        return found.join(dead, ["item_id", "batch"], "left_anti")

    def items(self) -> DataFrame:
        """(item_id, len) of the items that live."""
        return self._living("items", _ITEMS, *self._state()).select("item_id", "len")

    # batches

    def _commit(self, generation: int, batch: int, kind: str, items: int, count: int) -> None:
        self.spark.createDataFrame([(generation, batch, kind, items, count)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _bury(self, ids: DataFrame, generation: int, rows: list, batch: int) -> tuple[int, int]:
        """Tombstones for the living rows of ``ids``; how many items and tokens die."""
        path = f"{self.path}/generation={generation}/dead/batch={batch}"
        gone = self._living("items", _ITEMS, generation, rows).join(ids, "item_id", "left_semi")
        gone.select("item_id", F.col("batch").alias("was"), "len").write.mode("overwrite").parquet(path)
        lost = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return lost[0], lost[1]

    def _write(self, postings: DataFrame, path: str) -> None:
        postings.sortWithinPartitions("part", "token", "item_id").write.mode("overwrite").partitionBy("part").parquet(path)

    def add(self, items: DataFrame) -> int:
        """Indexes (item_id, title, metadata, text), in place of what was indexed of these items; gives the batch's number.

        An item_id that comes twice in a batch is an error, and the batch doesn't exist then.
        """
        generation, rows = self._state()
        batch = max((r["batch"] for r in rows), default=0) + 1
        at = lambda what: f"{self.path}/generation={generation}/{what}/batch={batch}"
        words = items.select(F.col("item_id").cast("string").alias("item_id"), *[tokens(F.col(c)).alias(c) for c in FIELDS])
        words = words.withColumn("len", sum((F.size(c) for c in FIELDS), F.lit(0)).cast("long"))
        words.select("item_id", "len").write.mode("overwrite").parquet(at("items"))
        held = self.spark.read.schema("item_id string, len long").parquet(at("items"))
        if held.groupBy("item_id").count().where("count > 1 or item_id is null").limit(1).count():
            raise ValueError("an item_id is null or comes twice in the batch")
        fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("words")) for i, c in enumerate(FIELDS)])
        spots = words.select("item_id", "len", F.explode(fields).alias("f")).select("item_id", "len", "f.field", F.posexplode("f.words").alias("position", "token"))
        spots = spots.withColumns({"part": F.pmod(F.xxhash64("token"), F.lit(self.parts)).cast("int"), "writer": F.pmod(F.xxhash64("item_id"), F.lit(WRITERS)).cast("int")})
        # dealt once: the grouping keys hold the dealing ones
        grouped = spots.repartition("part", "writer").groupBy("part", "writer", "token", "item_id", "field", "len").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        self._write(grouped.select("token", "item_id", "field", "len", "positions", "part"), at("postings"))
        lost = self._bury(held.select("item_id"), generation, rows, batch)
        came = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        self._commit(generation, batch, "add", came[0] - lost[0], came[1] - lost[1])
        return batch

    def remove(self, ids: DataFrame) -> int:
        """Takes items (item_id) out; ids that aren't indexed are none."""
        generation, rows = self._state()
        batch = max((r["batch"] for r in rows), default=0) + 1
        lost = self._bury(ids.select(F.col("item_id").cast("string").alias("item_id")).distinct(), generation, rows, batch)
        self._commit(generation, batch, "remove", -lost[0], -lost[1])
        return batch

    def merge(self) -> None:
        """The living rows as one batch of the next generation."""
        generation, rows = self._state()
        at = lambda what: f"{self.path}/generation={generation + 1}/{what}/batch=1"
        self._living("items", _ITEMS, generation, rows).select("item_id", "len").write.mode("overwrite").parquet(at("items"))
        living = self._living("postings", _POSTINGS, generation, rows).drop("batch")
        self._write(living.repartition("part", F.pmod(F.xxhash64("item_id"), F.lit(WRITERS))), at("postings"))
        self._commit(generation + 1, 1, "merge", *self.figures())

    # queries

    def postings(self, wanted: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """Living postings of some tokens; of the files, only those of the tokens' partitions are read."""
        parts = self.spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.parts)).cast("int").alias("p")).distinct().collect()  # a query's tokens
        narrow = F.col("part").isin(*[r["p"] for r in parts]) & F.col("token").isin(*wanted) & F.col("field").isin(*[FIELDS.index(f) for f in fields])
        return self._living("postings", _POSTINGS, *self._state(), narrow)

    def search(self, terms: list[str], limit: int | None = 20, relaxed: bool = True, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """(item_id, rank, strategy), best first: items with all phrases, or with any where none has all."""
        asked = phrases(self.spark, terms)
        items, count_ = self.figures()
        if not asked or not items or not count_:
            return nothing(self.spark.createDataFrame([], "item_id string"), "item_id")
        found = self.postings(list(dict.fromkeys(t for p in asked for t in p)), fields)
        entry = F.struct(F.concat_ws(" ", "field", "token").alias("k"), F.col("positions").alias("v"))
        by = found.groupBy("item_id", F.col("len").alias("__len")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
        at = lambda f, t: F.coalesce(F.col("m")[f"{f} {t}"], F.array().cast("array<int>"))

        def count(f: int, p: list[str]) -> Column:
            goes_on = lambda x: F.forall(F.array(F.lit(True), *[F.array_contains(at(f, t), x + k) for k, t in enumerate(p) if k]), lambda b: b)
            return F.size(F.filter(at(f, p[0]), goes_on)) if len(p) > 1 else F.size(at(f, p[0]))

        tf = F.array(*[sum((count(FIELDS.index(f), p) for f in fields), F.lit(0)) for p in asked])
        hits = by.select("item_id", "__len", tf.alias("__tf")).where(F.exists("__tf", lambda x: x > 0))
        df = [F.count_if(F.col("__tf")[i] > 0) for i in range(len(asked))]
        facts = hits.agg(F.array(*df).alias("__df"), F.count_if(F.forall("__tf", lambda x: x > 0)).alias("__full")).withColumns({"__n": F.lit(items), "__total": F.lit(count_)})
        return ranked(hits, facts, len(asked), "item_id", (), relaxed, None, limit)
