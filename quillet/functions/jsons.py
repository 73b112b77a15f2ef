"""JSON in text columns: strict and lenient parsing of layouts, segments, metadata, progress and triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.arrays import let
from quillet.functions.text import fold, json_objects, jsonish, strip, unfenced

BOX = "struct<x:double,y:double,width:double,height:double>"
REGIONS = f"array<struct<page:int,image_width:int,image_height:int,group_id:int,category:string,bbox:{BOX},confidence:double>>"
BLOCKS = f"array<struct<page:int,image_width:int,image_height:int,label:string,content:string,bbox:{BOX},order:int,group_id:int>>"
SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def _array(raw: Column, schema: str, field: str) -> Column:
    """A JSON array by its schema; text that isn't one is an error of the query, as a broken layout must not pass for an empty one."""
    sound = F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("[")
    return F.when(sound, F.from_json(raw, schema)).otherwise(F.raise_error(F.concat(F.lit(f"not a JSON array in {field}: "), F.coalesce(F.substring(raw, 1, 80), F.lit("null")))).cast(schema))


def _box(b: Column) -> Column:
    return F.struct(*[F.coalesce(b[c], F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")])


def regions(raw: Column) -> Column:
    """Layout regions, typed, with defaults: category unknown, numbers 0; page, sizes and group stay null."""
    def one(r: Column) -> Column:
        return F.struct(r["page"].alias("page"), r["image_width"].alias("image_width"), r["image_height"].alias("image_height"), r["group_id"].alias("group_id"), F.coalesce(r["category"], F.lit("unknown")).alias("category"), _box(r["bbox"]).alias("bbox"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"))

    return F.transform(_array(raw, REGIONS, "regions"), one)


def blocks(raw: Column) -> Column:
    """Layout blocks, likewise: label unknown, content empty, order and group 0."""
    def one(b: Column) -> Column:
        return F.struct(b["page"].alias("page"), b["image_width"].alias("image_width"), b["image_height"].alias("image_height"), F.coalesce(b["label"], F.lit("unknown")).alias("label"), F.coalesce(b["content"], F.lit("")).alias("content"), _box(b["bbox"]).alias("bbox"), F.coalesce(b["order"], F.lit(0)).alias("order"), F.coalesce(b["group_id"], F.lit(0)).alias("group_id"))

    return F.transform(_array(raw, BLOCKS, "blocks"), one)


def segments(raw: Column) -> Column:
    """Transcript segments; null or broken text is an empty array."""
    return F.coalesce(F.from_json(raw, SEGMENTS), F.array().cast(SEGMENTS))


def metadata(raw: Column) -> Column:
    """An object's values as strings (a null as 'null'); broken text is an empty map."""
    found = F.from_json(raw, "map<string,string>")
    return F.coalesce(F.transform_values(found, lambda _, v: F.coalesce(v, F.lit("null"))), F.create_map().cast("map<string,string>"))


def signature(record: Column) -> Column:
    """A map's entries in the order of their keys, as JSON: equal for equal records."""
    return F.to_json(F.array_sort(F.map_entries(record)))


def progress(percent: Column) -> Column:
    return F.to_json(F.struct(percent.alias("progress")))


def progress_of(result: Column) -> Column:
    return F.get_json_object(result, "$.progress").cast("int")


def cell(value: Column, empty: str, most: int = 120) -> Column:
    """(raw_text, is_json, can_expand, has_value) of a table browser's text cell; objects and arrays are JSON."""
    is_json = F.coalesce(F.try_parse_json(value).isNotNull() & F.ltrim(value).rlike(r"^[\[{]"), F.lit(False))
    return F.struct(F.coalesce(value, F.lit(empty)).alias("raw_text"), is_json.alias("is_json"), (is_json | F.coalesce(F.length(value) > most, F.lit(False))).alias("can_expand"), value.isNotNull().alias("has_value"))


def technical(entries: list[tuple[str, Column, list[str]]], custom_keys: Column) -> Column:
    """(label, value) of derived metadata with a value whose label, and aliases, no custom key equals once both are normalised."""
    norm = lambda c: F.trim(F.regexp_replace(fold(F.trim(c)), "[^a-z0-9]+", " "))
    keys = F.transform(custom_keys, norm)
    rows = F.array(*[F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), F.array(*[F.lit(a) for a in (label, *aliases)]).alias("names")) for label, value, aliases in entries])
    kept = F.filter(rows, lambda r: r["value"].isNotNull() & (r["value"] != "") & ~F.arrays_overlap(F.transform(r["names"], norm), keys))
    return F.transform(kept, lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value")))


_TRIPLE = "struct<subject:string,predicate:string,object:string,sujeto:string,predicado:string,objeto:string>"


def triple(raw: Column) -> Column:
    """One object as (subject, predicate, object), under English or Spanish keys, trimmed; null unless all three are there."""
    return _cleaned(F.from_json(jsonish(raw), _TRIPLE))


def _cleaned(t: Column) -> Column:
    part = lambda a, b: F.coalesce(strip(F.coalesce(t[a], t[b])), F.lit(""))
    s, p, o = part("subject", "sujeto"), part("predicate", "predicado"), part("object", "objeto")
    return F.when((s != "") & (p != "") & (o != ""), F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object")))


def triples(raw: Column) -> Column:
    """Triples in a model's answer: unfenced, made JSON where nearly so, the outermost array or else object parsed as a whole, or object by object
    where that fails; incomplete ones go, and of those alike without regard to case the first stays."""
    text = jsonish(unfenced(raw))
    array, single = F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    candidate = F.when(array != "", array).when(single != "", F.concat(F.lit("["), single, F.lit("]"))).otherwise(text)
    whole = F.when(F.try_parse_json(candidate).isNotNull(), F.from_json(candidate, f"array<{_TRIPLE}>"))
    each = F.transform(F.coalesce(F.transform(whole, _cleaned), F.transform(json_objects(text), triple)), lambda t: t)
    kept = F.filter(each, lambda t: t.isNotNull())
    low = lambda t: F.lower(F.concat_ws("\u0001", t["subject"], t["predicate"], t["object"]))
    return let(kept, lambda a: let(F.transform(a, low), lambda keys: F.filter(a, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)))
