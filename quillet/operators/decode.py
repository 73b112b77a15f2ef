"""Token predictions to entities: labels and thresholds, BIO decoding with repair, surface forms, windows, routing between engines.

Labels, thresholds, windows and routing are column expressions; the decoder itself is a fold over one chunk's pieces and runs in a vectorised
function over rows that hold a chunk and its pieces, so a chunk, which a model's window bounds, is all that it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillet.functions.arrays import let
from quillet.functions.text import normalize_value, sanitized
from quillet.operators.entities import KEYWORDS, close, dedup_document, family, folded, letters, matches, merge_sources, overlap

# Labels where a model names none, label and alias names of entity types, thresholds.
LABELS = ["B-LOC", "B-MISC", "B-ORG", "B-PER", "I-LOC", "I-MISC", "I-ORG", "I-PER", "O"]
BIO_TYPES = {"PER": "person", "LOC": "place", "ORG": "organization", "MISC": "misc", "DATE": "date", "INST": "institution"}
SPACY_TYPES = {"PER": "person", "PERSON": "person", "LOC": "place", "GPE": "place", "ORG": "organization", "DATE": "date", "TIME": "date", "MISC": "misc"}
ALIASES = {
    "person": ("person", "persona"),
    "place": ("place", "location", "lugar"),
    "date": ("date", "fecha"),
    "institution": ("institution", "institucion", "institución"),
    "organization": ("organization", "organizacion", "organización"),
    "misc": ("misc", "other", "otro"),
}
CORE, CORE_LEAST, OTHER_LEAST = ("person", "place", "organization", "institution"), 0.30, 0.65
BEST_EFFORT = ("person", "organization", "place")
_JOINERS = "-.'’\""
_INSIDE = "./&'’-ºª"

PIECES = "array<struct<piece:string,start:int,end:int,label:string,score:double>>"
FOUND = T.ArrayType(T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))


def named(value: Column, names: dict[str, str]) -> Column:
    """``value`` by a map of names; others are null."""
    return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), names.items(), F.lit(None).cast("string"))


def aliased(value: Column) -> Column:
    """An entity type by any of its English or Spanish names."""
    low = F.lower(F.trim(value))
    return reduce(lambda out, kv: F.when(low.isin(*kv[1]), kv[0]).otherwise(out), ALIASES.items(), F.lit(None).cast("string"))


def labels_of(id2label: dict[str, str] | None) -> list[str]:
    """A model's labels in the order of their numbers."""
    return [v for _, v in sorted(((int(k), v) for k, v in (id2label or {}).items()))] or list(LABELS)


def best_label(logits: Column, labels: list[str]) -> Column:
    """(label, score): the first largest logit's label and its softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(logits, top).cast("int"))
    return F.when(F.size(logits) > 0, F.struct(name.alias("label"), (F.lit(1.0) / total).alias("score")))


def bio_type(label: Column) -> Column:
    """The entity type of a B- or I- label; null for O and unknown ones."""
    known = [f"{at}-{name}" for name in BIO_TYPES for at in "BI"]
    return F.when(label.isin(known), named(F.substring(label, 3, 2**31 - 1), BIO_TYPES))


def passes(label: Column, score: Column, threshold: float) -> Column:
    """Whether a prediction reaches its type's threshold: core types pass at 0.30 at most, others need 0.65 at least."""
    t = bio_type(label)
    return t.isNotNull() & (score >= F.when(t.isin(*CORE), min(threshold, CORE_LEAST)).otherwise(max(threshold, OTHER_LEAST)))


def is_institution(value: Column) -> Column:
    return value.rlike(rf"(?iU)^[^\p{{L}}\p{{N}}]*(?:{'|'.join(KEYWORDS)})")


def spans_of_paragraphs(text: Column) -> Column:
    """(start, end) of runs of lines that aren't blank, line ends included."""
    found = matches(F.concat(text, F.lit("\n")), r"(?:[^\n]*[^\s][^\n]*\n)+")
    inside = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.least(m["end"], F.length(text).cast("long")).alias("end")))
    return F.coalesce(inside, F.array().cast("array<struct<start:bigint,end:bigint>>"))


def windows(n: Column, size: int = 256, overlap: int = 32) -> Column:
    """(start, end) of token windows: each starts ``size - overlap`` on, the last one closes the text."""
    step = size - overlap
    last = F.when(n > size, F.ceil((n - size) / step) * step).otherwise(0).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")), lambda s: F.struct(s.alias("start"), F.least(s + size, n.cast("long")).alias("end")))


def packed_chunks(count: Callable[[str], int], most: int):
    """A function of text columns: (start, end) of paragraphs of at most ``most`` tokens; longer ones are cut between words. A text without paragraphs is one chunk."""
    import re

    word = re.compile(r"\S+\s*")

    def cut(text: str) -> list[dict]:
        out, at, lines = [], None, 0
        spans = []
        for line in text.splitlines(keepends=True) if text else []:
            if line.strip():
                at = lines if at is None else at
            elif at is not None:
                spans.append((at, lines))
                at = None
            lines += len(line)
        if at is not None:
            spans.append((at, len(text)))
        for a, b in spans:
            if count(text[a:b]) <= most:
                out.append((a, b))
                continue
            first, held, end = None, 0, a
            for m in word.finditer(text, a, b):
                n = count(m.group())
                if first is not None and held + n > most:
                    out.append((first, end))
                    first, held = None, 0
                first = m.start() if first is None else first
                held, end = held + n, m.end()
            if first is not None:
                out.append((first, end))
        if not out and text.strip():
            out = [(0, len(text))]
        return [{"start": a, "end": b} for a, b in out]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return run


def bare_piece(piece: str) -> str:
    return piece.lstrip("#") if piece.startswith("##") else piece.lstrip("▁").lstrip("Ġ") if piece[:1] in ("▁", "Ġ") else piece


def joined_pieces(pieces: list[str]) -> str:
    """The words that word pieces spell: continuations and marks without a space before them, unknown pieces left out."""
    out = ""
    for piece in pieces:
        bare = bare_piece(piece)
        if piece == "[UNK]" or not bare:
            continue
        glued = not out or piece.startswith("##") or not any(c.isalnum() for c in bare)
        out += bare if glued else " " + bare
    return out


def surface_score(value: str) -> int:
    """How good a written form is: none with marks of broken decoding; letters and digits count, known pieces, a space, an alphanumeric end."""
    if not value or any(m in value for m in ("�", "Ã", "Â", "â€")):
        return 0
    return sum(c.isalnum() for c in value) + 50 * ("[UNK]" not in value) + 10 * (" " in value) + 5 * value[-1].isalnum()


def aligned(chunk: str, start: int, end: int) -> tuple[int, int]:
    """A span grown to the ends of the words that it touches."""
    end = min(end, len(chunk))
    if start >= end:
        return min(start, len(chunk)), end
    inside = lambda c: c.isalnum() or c in _INSIDE
    while start and inside(chunk[start - 1]):
        start -= 1
    while end < len(chunk) and inside(chunk[end]):
        end += 1
    return start, end


def _goes_on(chunk: str, open_: dict, p: dict) -> bool:
    """Whether a piece tagged as a beginning belongs to the open entity after all."""
    if p["piece"].startswith("##") or p["start"] <= open_["end"]:
        return True
    gap = chunk[open_["end"] : p["start"]]
    bare = bare_piece(p["piece"])
    return all(c.isspace() or c in _JOINERS for c in gap) and bool(bare) and (bare[0].islower() or len(bare) == 1)


def _closed(chunk: str, e: dict) -> dict | None:
    start, end = aligned(chunk, e["start"], e["end"])
    spelled = joined_pieces(e["pieces"]).strip()
    written = (chunk[start:end] or spelled).strip()
    value = sanitized(spelled if surface_score(spelled) > surface_score(written) else written)
    if "[UNK]" in value or sum(c.isalnum() for c in value) <= 1:
        return None
    kind = e["type"]
    low = value.lstrip("".join(c for c in value if not c.isalnum())).lower()
    if kind == "organization" and low.startswith(tuple(k.lower() for k in KEYWORDS)):
        kind = "institution"
    return {"entity_type": kind, "value": value, "start": start, "end": end, "confidence": sum(e["scores"]) / len(e["scores"])}


def decoded(chunk: str, pieces: list[dict]) -> list[dict]:
    """Entities of one chunk's tagged pieces in order; pieces of other tags are gone already."""
    out: list[dict | None] = []
    open_: dict | None = None
    for p in pieces:
        kind = BIO_TYPES.get(p["label"][2:])
        if kind is None or p["label"][:2] not in ("B-", "I-"):
            continue
        same = open_ is not None and open_["type"] == kind
        if same and (p["label"].startswith("I-") or _goes_on(chunk, open_, p)):
            open_["end"] = max(open_["end"], p["end"])
            open_["scores"].append(p["score"])
            open_["pieces"].append(p["piece"])
            continue
        if open_ is not None:
            out.append(_closed(chunk, open_))
        open_ = {"type": kind, "start": p["start"], "end": p["end"], "scores": [p["score"]], "pieces": [p["piece"]]}
    if open_ is not None:
        out.append(_closed(chunk, open_))
    return [e for e in out if e is not None]


@F.pandas_udf(FOUND)
def decode(chunks: pd.Series, pieces: pd.Series) -> pd.Series:
    """Entities of chunks (text) and their pieces (``PIECES``), offsets inside the chunk."""
    return pd.Series([decoded(c or "", list(p) if p is not None else []) for c, p in zip(chunks, pieces, strict=True)])


def surface(value: Column) -> Column:
    """``surface_score`` as an expression."""
    score = letters(value) + F.when(F.contains(value, F.lit("[UNK]")), 0).otherwise(50) + F.when(F.contains(value, F.lit(" ")), 10).otherwise(0) + F.when(value.rlike(r"[\p{L}\p{N}]\z"), 5).otherwise(0)
    return F.when((F.coalesce(value, F.lit("")) == "") | value.rlike("�|Ã|Â|â€"), 0).otherwise(score)


def consolidated(entities: DataFrame, key: str) -> DataFrame:
    """A fold in order of (start, end, value) inside one document: of neighbours of one family that overlap, or of which one value holds the other within 24 characters, the fuller one stays."""
    full = surface(F.col("value")) + F.col("end") - F.col("start") + F.when(F.col("confidence") >= 0.9, 5).otherwise(0)

    def related(a: Column, b: Column) -> Column:
        at = close(a, b, 24)
        return (a["__g"] == b["__g"]) & (overlap(a, b) | ((at[0] | at[1]) & (F.contains(a["__n"], b["__n"]) | F.contains(b["__n"], a["__n"]))))

    derived = {"__g": family(F.col("entity_type")), "__n": normalize_value(F.col("value")), "__q": full}
    return folded(entities, key, ["start", "end", "value"], derived, related, lambda a, b: b["__q"] > a["__q"])


def routed(entities: DataFrame, key: str) -> DataFrame:
    """Entities of several engines (source rule_based, onnx, spacy) that a document takes: persons, places and organisations of the
    first engine of onnx, spacy, rules that has any; dates of rules only; institutions of rules and onnx; others of onnx, else spacy."""
    by = W.partitionBy(key)
    kind, source = F.col("entity_type"), F.col("source")
    core = kind.isin(*BEST_EFFORT)
    has = lambda cond: F.max(cond.cast("int")).over(by) == 1
    flags = entities.withColumns({"__oc": has(core & (source == "onnx")), "__sc": has(core & (source == "spacy")), "__om": has((kind == "misc") & (source == "onnx"))})
    first = F.when(F.col("__oc"), "onnx").when(F.col("__sc"), "spacy").otherwise("rule_based")
    takes = (core & (source == first)) | ((kind == "date") & (source == "rule_based")) | ((kind == "institution") & source.isin("rule_based", "onnx")) | ((kind == "misc") & (source == F.when(F.col("__om"), "onnx").otherwise("spacy")))
    return flags.where(takes).select(*entities.columns)


def hybrid(entities: DataFrame, key: str) -> DataFrame:
    """``routed`` after onnx entities are consolidated, with institutions merged and the document deduplicated."""
    onnx = consolidated(entities.where("source = 'onnx'"), key)
    chosen = routed(onnx.unionByName(entities.where("source <> 'onnx'")), key)
    merged = merge_sources(chosen.where("entity_type = 'institution'"), key)
    return dedup_document(chosen.where("entity_type <> 'institution'").unionByName(merged), key)


ENGINES = ("rule", "onnx", "spacy", "hybrid")


def engine(entities: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """What an engine gives, by name (hybrid where none is named); where one has nothing for a document, the rules' entities."""
    kind = kind if kind in ENGINES else "hybrid"
    if kind == "hybrid":
        return hybrid(entities, key)
    if kind == "rule":
        return entities.where("source = 'rule_based'")
    own = F.max((F.col("source") == kind).cast("int")).over(W.partitionBy(key)) == 1
    return entities.withColumn("__own", own).where(F.col("source") == F.when(F.col("__own"), kind).otherwise("rule_based")).drop("__own")


def span_of(text: Column, value: Column) -> Column:
    """(start, end) of the first place of a value without regard to case, or null."""
    needle = F.trim(value)
    at = F.position(F.lower(needle), F.lower(text))
    return F.when((needle != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(needle)).alias("end")))


REVIEWED = "array<struct<value:string,type:string,entity_type:string,confidence:double>>"


def reviewed(answers: DataFrame, candidates: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Entities of a model's review: (key, entity_type, value, start, end, confidence), source llm.

    answers: (key, text, answer as JSON); candidates: (key, entity_type, value, start, end, confidence); protected likewise. Types go by any alias, unknown ones are
    dropped, confidences lie between 0 and 1 (0.95 where none is given). A candidate of the family with the same value lends its span and, if higher,
    confidence; else the first place in the text does. What a protected entity equals or overlaps is dropped, and of equal ones the first stays.
    """
    from quillet.functions.text import normalize_value, sanitize_value, unfenced

    group = lambda t: F.when(t == "institution", "organization").otherwise(t)
    raw = unfenced(F.col("answer"))
    array, single = F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    rows = answers.select(key, "text", F.posexplode(F.from_json(F.when(array != "", array).otherwise(F.concat(F.lit("["), single, F.lit("]"))), REVIEWED)).alias("n", "r"))
    rows = rows.select(key, "text", "n", aliased(F.coalesce("r.entity_type", "r.type")).alias("entity_type"), sanitize_value(F.col("r.value")).alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.95)))).alias("own"))
    rows = rows.where("value <> '' and entity_type is not null").withColumns({"__f": group(F.col("entity_type")), "__v": normalize_value(F.col("value"))})
    c = candidates.select(key, group(F.col("entity_type")).alias("__f"), normalize_value(F.col("value")).alias("__v"), F.struct("start", "end", "confidence").alias("c")).groupBy(key, "__f", "__v").agg(F.min("c").alias("c"))
    met = rows.join(c, [key, "__f", "__v"], "left").withColumn("s", span_of(F.col("text"), F.col("value")))
    out = met.select(key, "n", "entity_type", "value", "__f", "__v", F.coalesce("c.start", "s.start", F.lit(0)).alias("start"), F.coalesce("c.end", "s.end", F.lit(0)).alias("end"), F.greatest("own", F.coalesce("c.confidence", F.lit(0.0))).alias("confidence"))
    p = protected.select(F.col(key).alias("__k"), group(F.col("entity_type")).alias("__pf"), normalize_value(F.col("value")).alias("__pv"), F.col("start").alias("__ps"), F.col("end").alias("__pe"))
    near = (F.col("__v") == F.col("__pv")) | ((F.col("start") < F.col("__pe")) & (F.col("__ps") < F.col("end")))
    out = out.join(p, (F.col(key) == F.col("__k")) & (F.col("__f") == F.col("__pf")) & near, "left_anti")
    one = F.row_number().over(W.partitionBy(key, "__v", "__f").orderBy("n"))
    return out.withColumn("__n", one).where("__n = 1").select(key, "entity_type", "value", "start", "end", "confidence", F.lit("llm").alias("source"))


def review_request(entities: DataFrame, key: str) -> DataFrame:
    """(key, candidates): a document's entities as JSON of value, type and confidence, in the order of their places."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", F.struct("value", F.col("entity_type").alias("type"), "confidence").alias("e"))))
    return entities.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["e"])).alias("candidates"))


def spacy_entities(found: DataFrame) -> DataFrame:
    """Entities of a spaCy run (label, value, start, end, ...): types by their labels, values sanitised, unknown and empty ones gone."""
    from quillet.functions.text import sanitize_value

    rows = found.withColumns({"entity_type": named(F.col("label"), SPACY_TYPES), "value": sanitize_value(F.col("value")), "confidence": F.lit(1.0), "source": F.lit("spacy")})
    return rows.where("entity_type is not null and value <> ''").drop("label")


def clauses(tokens: Column) -> Column:
    """Subject, verb, object of a parsed sentence: array of (i, text, pos, dep, head) -> array of triples.

    A verb counts with a subject and an object among its children; of several the last stands; each is written with its own modifiers, in order.
    """
    # Relations of the parser.
    spread = ("amod", "det", "compound", "flat")

    def phrase(t: Column) -> Column:
        own = F.filter(tokens, lambda c: ((c["head"] == t["i"]) & c["dep"].isin(*spread) & (c["i"] != t["i"])) | (c["i"] == t["i"]))
        return F.trim(F.array_join(F.transform(F.array_sort(F.transform(own, lambda c: F.struct(c["i"], c["text"]))), lambda c: c["text"]), " "))

    def child(v: Column, deps: tuple[str, ...]) -> Column:
        found = F.filter(tokens, lambda c: (c["head"] == v["i"]) & (c["i"] != v["i"]) & c["dep"].isin(*deps))
        return F.when(F.size(found) > 0, phrase(F.element_at(found, -1)))

    verbs = F.filter(tokens, lambda t: t["pos"] == "VERB")
    rows = F.transform(verbs, lambda v: F.struct(child(v, ("nsubj", "nsubj:pass")).alias("subject"), F.trim(v["text"]).alias("predicate"), child(v, ("obj", "iobj")).alias("object")))
    return let(rows, lambda a: F.filter(a, lambda r: (r["subject"] != "") & (r["object"] != "")))


def best_triples(parsed: Column, by_rule: Column) -> Column:
    """A parser's triples, or the rules' where it has none."""
    return F.when(F.size(F.coalesce(parsed, F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))) > 0, parsed).otherwise(by_rule)
