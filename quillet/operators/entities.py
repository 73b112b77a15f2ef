"""Rule-based entities with character offsets, merging of sources, BIO decoding, regular-expression triples.

Merging and deduplication are folds in order over the sorted entities of one document, as expressions: a group is a document's entities, and no
Python runs. The rules' matches are found by one vectorised scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillet.functions.arrays import let, running
from quillet.functions.text import normalize_value, sanitize_value, sanitized

# The patterns of the rules, in Java's notation with Unicode classes for blanks and word ends.
_CAP = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
_JOIN = rf"(?:\s+(?:de|del|la|las|los|y)\s+{_CAP}|\s+{_CAP})*"
RULES = {
    "person": rf"(?U)(?:Don|Doña|Dr\.?|Fray|Sor|Fr\.)\s+{_CAP}(?:\s+{_CAP})*",
    "place": rf"(?U)(?:(?:ciudad|villa|pueblo|provincia)\s+de\s+{_CAP}{_JOIN}|(?:río|sierra)\s+{_CAP}{_JOIN})",
    "date_written": r"(?U)\b\d{1,2}\s+de\s+[a-záéíóúñ]+\s+de\s+\d{4}\b",
    "date_numeric": r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b",
    "institution": rf"(?U)(?:Real|Cabildo|Iglesia|Convento|Universidad|Audiencia)(?:\s+{_CAP})*",
}
KEYWORDS = ("Real", "Cabildo", "Iglesia", "Convento", "Universidad", "Audiencia")
VERBS = ("es", "fue", "nació en", "vivió en", "fundó", "escribió", "pertenece a", "trabaja en", "dirigió", "murió en")
TRIPLE = rf"(?i)^\s*(.+?)\s+({'|'.join(VERBS)})\s+(.+?)\s*$"


def matches(text: Column, pattern: str) -> Column:
    """(value, start, end) of each match, offsets in characters, from running sums of the lengths of gaps and matches."""
    long = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))

    def spans(of: Column) -> Column:
        steps = F.transform(of["n"], lambda _, i: F.get(of["g"], i) + F.when(i > 0, F.get(of["n"], i - 1)).otherwise(F.lit(0).cast("long")))
        return let(running(steps), lambda at: F.transform(of["hits"], lambda h, i: F.struct(h.alias("value"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(h)).alias("end"))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.struct(hits.alias("hits"), long(F.split(text, pattern, -1)).alias("g")), lambda f: let(F.struct(f["hits"].alias("hits"), f["g"].alias("g"), long(f["hits"]).alias("n")), spans))
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


_FOUND = T.ArrayType(T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


_COMPILED = [(name.split("_")[0], re.compile(p.removeprefix("(?U)"))) for name, p in RULES.items()]


@F.arrow_udf(_FOUND)
def rule_matches(texts: pa.Array) -> pa.Array:
    """Matches of all rules in a text by start, then in the order of the rules; values sanitised, those that vanish left out."""
    ends, found = [0], []
    for text in texts.to_pylist():
        own = []
        for kind, p in _COMPILED if text else ():
            for m in p.finditer(text):
                value = m.group()
                if not (value.isascii() and value[0].isalnum() and value[-1].isalnum()):  # else there is nothing to take off or repair
                    value = sanitized(value)
                if value:
                    own.append((kind, value, *m.span()))
        own.sort(key=lambda m: m[2])
        found += own
        ends.append(len(found))
    columns = list(zip(*found, strict=True)) or [()] * 4
    kinds = {"entity_type": pa.string(), "value": pa.string(), "start": pa.int32(), "end": pa.int32()}
    fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


def extract(docs: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """(key, place, entity_type, value, start, end, confidence, source, carried columns) by all rules, in order of start; offsets are those of the whole match."""
    # an outer generator, as for an inner one the optimiser asks first whether there is anything, and the function runs twice
    rows = docs.select(key, *carried, F.posexplode_outer(rule_matches(F.col(text))).alias("place", "e")).where("place is not null").select(key, "place", "e.*", *carried)
    return rows.withColumns({"confidence": F.lit(1.0), "source": F.lit("rule_based")})


def family(entity_type: Column) -> Column:
    return F.when(entity_type == "institution", "organization").otherwise(entity_type)


def unprotected(candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """Candidates above the confidence gate that no manual entity of the item and family equals or overlaps.

    Both are shuffled once, together, by item. Of those that start before a candidate's end, the furthest end tells whether any overlaps it, so a
    running maximum in the order of ends and starts finds them all, however many an item has; equal values meet in a window of their own.
    """
    p = protected.where("item_id is not null and entity_type is not null").select("item_id", "entity_type", "value", F.col("start").alias("__ps"), F.col("end").alias("__pe"), F.lit(1).alias("__p"))
    rows = candidates.where("confidence > 0.89").unionByName(p, allowMissingColumns=True).repartition("item_id")
    rows = rows.withColumns({"__f": family(F.col("entity_type")), "__v": F.lower("value"), "__at": F.when(F.col("__p").isNull(), F.col("end")).otherwise(F.col("__ps"))})
    spans = W.partitionBy("item_id", "__f").orderBy("__at", F.asc_nulls_first("__p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(F.col("__at").isNotNull(), F.col("__pe"))).over(spans)
    equal = F.max(F.when(F.col("__v").isNotNull(), F.col("__p"))).over(W.partitionBy("item_id", "__f", "__v"))
    met = rows.withColumn("__reach", reach).where(F.coalesce(F.col("__reach") <= F.col("start"), F.lit(True)))  # protected rows have no start
    return met.withColumn("__equal", equal).where("__p is null and __equal is null").select(*candidates.columns)


# Ranks of sources and types.
_SOURCE = {"rule_based": 1, "onnx": 2, "spacy": 3, "llm": 4}
_TYPE = {"institution": 5, "date": 4, "person": 3, "place": 3, "organization": 2}


_CORE = ("person", "place", "organization", "institution")


def ranked_by(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def close(a: Column, b: Column, start: int, end: int | None = None) -> tuple[Column, Column]:
    """Whether two spans start, and end, within so many characters."""
    return F.abs(a["start"] - b["start"]) <= start, F.abs(a["end"] - b["end"]) <= (start if end is None else end)


def folded(entities: DataFrame, key: str, order: list[str], derived: dict[str, Column], related: Callable[[Column, Column], Column], better: Callable[[Column, Column], Column], last_only: bool = True) -> DataFrame:
    """A fold over the entities of each ``key`` in order of ``order``, then of the other columns: each meets the last kept one, or the first kept
    one that it is related to; of two related ones the earlier stays unless the later is better. ``derived`` columns are worked out once and are gone afterwards.
    """
    rest = [c for c in entities.columns if c != key]
    rows = entities.withColumns(derived)
    names = list(dict.fromkeys([*order, *rest, *derived]))
    arrays = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("e"))
    kind = arrays.schema["e"].dataType.simpleString()

    def step(kept: Column, e: Column) -> Column:
        meets = lambda k: F.coalesce(related(k, e), F.lit(False))
        if last_only:
            at = F.when(meets(F.get(kept, F.size(kept) - 1)), F.size(kept)).otherwise(0)
        else:
            at = F.array_position(F.transform(kept, meets), True).cast("int")
        instead = lambda i: F.concat(F.slice(kept, F.lit(1), i - 1), F.array(e), F.slice(kept, i + 1, F.size(kept)))
        return let(at, lambda i: F.when(i == 0, F.concat(kept, F.array(e))).when(better(F.get(kept, i - 1), e), instead(i)).otherwise(kept))

    out = F.aggregate(F.col("e").cast(kind), F.array().cast(kind), step)
    return arrays.select(key, F.inline(out)).select(*entities.columns)


def merge_sources(entities: DataFrame, key: str) -> DataFrame:
    """Each entity meets the last kept one in order of (start, end, source, value); overlapping or nearly equal ones leave the preferred."""
    derived = {"__r": ranked_by(F.col("source"), _SOURCE, 9), "__t": ranked_by(F.col("entity_type"), _TYPE, 1), "__g": family(F.col("entity_type")), "__n": normalize_value(F.col("value")), "__s": F.coalesce("source", F.lit(""))}

    def related(a: Column, b: Column) -> Column:
        near = close(a, b, 2)
        return overlap(a, b) | ((a["__n"] == b["__n"]) & ((near[0] & near[1]) | (a["entity_type"] == b["entity_type"])))

    def better(a: Column, b: Column) -> Column:
        dated = lambda x: (x["__s"] == "rule_based") & (x["entity_type"] == "date")
        sure = lambda x, y: (x["__s"] == "onnx") & x["entity_type"].isin(*_CORE) & ~y["__s"].isin("onnx", "spacy") & (x["__g"] == y["__g"]) & (x["confidence"] >= y["confidence"] + 0.05)
        founded = lambda x, y: (x["__s"] == "rule_based") & (x["entity_type"] == "institution") & (y["__g"] == "organization")
        long = lambda x: x["end"] - x["start"]
        fuller = lambda x, y: (long(x) > long(y)) & (x["confidence"] >= y["confidence"])
        return (
            F.when(dated(a), False).when(dated(b), True).when(sure(b, a), True).when(sure(a, b), False).when(founded(a, b), False).when(founded(b, a), True)
            .when(a["__t"] != b["__t"], b["__t"] > a["__t"]).when(fuller(b, a), True).when(fuller(a, b), False).when(a["confidence"] != b["confidence"], b["confidence"] > a["confidence"])
            .otherwise(b["__r"] > a["__r"])
        )

    return folded(entities, key, ["start", "end", "__r", "value"], derived, related, better)


def bio_spans(pieces: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Entities of B-/I- tagged pieces: (key, entity_type, start, end, confidence, n); other tags are dropped before.

    A B- opens an entity unless it goes on with the one before: of the same type, and starting at or before its end. ``decode`` is
    the full decoder, that sees pieces and text.
    """
    tagged = pieces.where(F.col("label").rlike("^[BI]-")).withColumn("entity_type", F.substring("label", 3, 20))
    keys = [key] if isinstance(key, str) else key
    by = W.partitionBy(*keys).orderBy(*order)
    other = (F.lag("entity_type").over(by) != F.col("entity_type")) | F.lag("entity_type").over(by).isNull()
    touches = F.col("start") <= F.lag("end").over(by)
    opens = other | (F.col("label").startswith("B-") & ~touches)
    grouped = tagged.withColumn("opens", opens.cast("int")).withColumn("g", F.sum("opens").over(by))
    return grouped.groupBy(*keys, "g").agg(F.first("entity_type").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("score"), 6).alias("confidence"), F.count(F.lit(1)).alias("n")).drop("g")


def triples(docs: DataFrame, key: str, text: str, placed: bool = False) -> DataFrame:
    """(key, subject, predicate, object) of sentences with one of the listed verbs; ``placed`` adds the sentence's place."""
    parts = docs.select(key, F.posexplode(F.split(text, r"[.;\n]")).alias("place", "s"))
    g = lambda i: F.trim(F.regexp_extract("s", TRIPLE, i))
    own = ["place"] if placed else []
    return parts.select(key, *own, g(1).alias("subject"), g(2).alias("predicate"), g(3).alias("object")).where("subject <> '' and predicate <> '' and object <> ''")


def distinct_triples(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first of each triple without regard to case."""
    by = W.partitionBy(key, F.lower("subject"), F.lower("predicate"), F.lower("object")).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def letters(value: Column) -> Column:
    """How many letters and digits a value has."""
    return F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def dedup_document(entities: DataFrame, key: str, near: int = 8) -> DataFrame:
    """Each entity, its value sanitised, meets all kept ones of its family in order of (start, end, value, source), not the last alone.

    The first kept one that overlaps, has an equal or prefix value within ``near`` at both ends, or the same value anywhere absorbs it;
    the fuller of the two stays, the earlier where both are alike.
    """
    rows = entities.withColumn("value", sanitize_value(F.col("value")))
    plain = F.trim(F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", " "))
    full = letters(F.col("value")) + F.col("end") - F.col("start") + F.when(F.col("confidence") >= 0.9, 10).otherwise(0) + F.when(F.contains("value", F.lit(" ")), 5).otherwise(0)

    def related(a: Column, b: Column) -> Column:
        at = close(a, b, near)
        same = (b["__n"] != "") & (a["__n"] == b["__n"])
        return (a["__g"] == b["__g"]) & (overlap(a, b) | same | (at[0] & at[1] & (a["__n"].startswith(b["__n"]) | b["__n"].startswith(a["__n"]))))

    derived = {"__g": family(F.col("entity_type")), "__n": plain, "__q": full}
    return folded(rows, key, ["start", "end", "value", "source"], derived, related, lambda a, b: b["__q"] > a["__q"], last_only=False)


def inside_windows(entities: DataFrame) -> DataFrame:
    """Those of (start, end, window_start, window_end, first, last) that touch no window edge within the text."""
    at_start = ~F.col("first") & (F.col("start") <= F.col("window_start"))
    at_end = ~F.col("last") & (F.col("end") >= F.col("window_end"))
    return entities.where(~at_start & ~at_end)
