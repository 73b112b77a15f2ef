"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong findings stand alone: assignments of a secret-like name, cloud access keys, long hexadecimal runs. Weak
candidates - account names, bare mixed-case keys, endpoints - are common in clean text, so one is reported
only where a complementary part (an identifier and a secret, a secret and an endpoint) starts within
``SCOPE`` code points of it in the same document. That is an interval join: parts are dealt into cells of
one scope's width, each cell is reduced to its first and last start by role, and a candidate meets its own cell and the two
beside it. Pre-reduction keeps the join at three rows a candidate however many parts a cell holds.

Regular expressions run once over each text, and only where a cheap test has found their anchor. Start
positions come from the lengths of the gaps between matches, summed in two levels. The parts that reach a shuffle are
those of documents which hold complementary kinds at all.

Defined results: null text counts as empty and has no finding; offsets are code points, end exclusive;
repeated rows and equal doc_ids are each scanned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import let, staged

SCOPE = 400

# The base patterns of the scan, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak kinds, reported only when linked.
ACCOUNT = r"""\b(?i:user(?:_?name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+_.@-]{3,}"""
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?"""

#: kind, order among kinds that start together, role, weak, cheap test, pattern, least length of which group
KINDS = (
    ("assign", 1, "secret", False, r"[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss][Ww]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]", ASSIGN, 6, 2),
    ("access", 2, "identifier", False, "AKIA", ACCESS, 20, 0),
    ("hex", 3, "secret", False, HEX, HEX, 24, 0),
    ("account", 4, "identifier", True, r"[:=]", ACCOUNT, 3, 0),
    ("bare", 5, "secret", True, r"[A-Za-z0-9+/_-]{20}", BARE, 20, 0),
    ("endpoint", 6, "endpoint", True, "://", ENDPOINT, 8, 0),
)
_FOUND = "array<struct<start:bigint,k:int,kind:string,role:string,weak:boolean,end:bigint>>"


def _running(steps: Column) -> Column:
    """Running sums of an array of longs: sums inside blocks of 256 over the sums of blocks."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / 256).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(a, b * 256 + 1, F.lit(256)))).otherwise(F.array().cast("array<array<bigint>>"))

    def summed(parts: Column) -> Column:
        sums = F.transform(parts, total)
        return let(sums, lambda t: F.flatten(F.transform(parts, lambda p, i: let(total(F.slice(t, F.lit(1), i)), lambda base: F.transform(p, lambda _, j: base + total(F.slice(p, F.lit(1), j + 1)))))))

    return let(steps, lambda a: let(blocks(a), summed))


def _found(text: Column, kind: str, k: int, role: str, weak: bool, test: str, pattern: str, least: int, group: int) -> Column:
    """All findings of one kind in one text, by start."""
    re = F.lit(pattern)
    matched = F.regexp_extract_all(text, re, F.lit(0))
    long_enough = F.transform(F.regexp_extract_all(text, re, F.lit(group)), lambda v: F.length(v) >= least) if group else F.transform(matched, lambda v: F.length(v) >= least)
    lengths = F.transform(matched, lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def spans(of: Column) -> Column:
        steps = F.transform(of["n"], lambda n, i: of["g"][i] + F.when(i > 0, of["n"][F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(0)).cast("long"))
        zipped = F.arrays_zip(_running(steps).alias("s"), of["n"].alias("n"), of["ok"].alias("ok"))
        kept = F.filter(zipped, lambda z: z["ok"])
        return F.transform(kept, lambda z: F.struct(z["s"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(weak).alias("weak"), (z["s"] + z["n"]).alias("end")))

    some = let(F.struct(lengths.alias("n"), gaps.alias("g"), long_enough.alias("ok")), spans)
    return F.when(F.regexp_like(text, F.lit(test)), some.cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, parts): every strong finding and weak candidate of each row, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*[_found(text, *kind) for kind in KINDS])
    return staged(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", parts.alias("parts")), "findings")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part in scope: (row_id, span)."""
    roles = F.array_distinct(F.transform("parts", lambda p: p["role"]))
    able = found.where(F.exists("parts", lambda p: p["weak"]) & (F.size(roles) > 1) & F.array_contains(roles, "secret"))
    parts = able.select("row_id", F.explode("parts").alias("span"))
    parts = parts.withColumn("cell", F.floor(F.col("span.start") / scope)).withColumn("role", F.col("span.role"))
    cells = parts.groupBy("row_id", "cell", F.col("role").alias("other")).agg(F.min("span.start").alias("first"), F.max("span.start").alias("last"))
    weak = parts.where("span.weak").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    near = (F.col("last") >= F.col("span.start") - scope) & (F.col("first") <= F.col("span.start") + scope)
    # a secret is completed by an identifier or an endpoint, each of these by a secret
    fits = F.when(F.col("role") == "secret", F.col("other") != "secret").otherwise(F.col("other") == "secret")
    return weak.join(cells, ["row_id", "cell"]).where(near & fits).select("row_id", "span").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, base (strong findings), linked (reported weak ones), both arrays of spans."""
    found = findings(docs)
    more = linked(found, scope).groupBy("row_id").agg(F.collect_list("span").alias("linked"))
    base = F.filter("parts", lambda p: ~p["weak"])
    rows = found.select("row_id", "doc_id", F.array_sort(base).alias("base"))
    return rows.join(more, "row_id", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(_FOUND)).alias("linked"))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and digests of ``scan``'s rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
