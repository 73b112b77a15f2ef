"""Text functions on columns; all but two are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and what is left of each without its marks, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x180)]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_map()
# Marks stripped from the edges of entity values.
EDGE = r"\"'“”‘’\-–—«»()\[\]{}:;,.!?/\\|"
# Operators of the full-text query language.
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def sanitize_value(text: Column) -> Column:
    """Entity value, mojibake repaired where its telltale marks are, without blanks and listed punctuation at its edges."""
    cleaned = F.regexp_replace(repair_mojibake(text), rf"(?U)^[{EDGE}\s]+|[{EDGE}\s]+$", "")
    return F.when(text.rlike(r"\A[A-Za-z0-9](?:[ -~]*[A-Za-z0-9])?\z"), text).otherwise(cleaned)  # first those that have nothing to take off or repair


def sanitized(text: str) -> str:
    """``sanitize_value`` of one Python string."""
    return _repaired(text).strip().strip("\"'“”‘’-–—«»()[]{}:;,.!?/\\| \t\n\r\v\f\u00a0").strip()


def normalize_value(text: Column) -> Column:
    return F.lower(collapse(sanitize_value(text)))


def metadata_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.trim(text)), "[^a-z0-9]+", " "))


def topic(text: Column) -> Column:
    return F.upper(F.trim(text))


def topics(text: Column) -> Column:
    """Comma-separated topics: trimmed, upper case, distinct in order, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), topic), lambda t: t != ""))


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda w: w != "")


def match_terms(query: Column) -> Column:
    """Terms of a query: separators break words, operators of any case and consecutive repeats go."""
    words = _terms(F.regexp_replace(F.regexp_replace(query, r'["()*^]', ""), r"[-:,.]", " "))
    words = F.filter(words, lambda w: ~F.upper(w).isin(*OPERATORS))
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def store_terms(query: Column) -> Column:
    """The stores' variant: upper-case operators go wherever they stand as words, punctuation vanishes inside words."""
    words = _terms(F.regexp_replace(query, rf"\b(?:{'|'.join(OPERATORS)})\b", " "))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r'[()"\-*^:,./\\]', "")), lambda w: w != "")


def view_terms(query: Column) -> Column:
    """The view's variant for highlighting: lower case, distinct."""
    words = F.filter(_terms(query), lambda w: ~F.upper(w).isin(*OPERATORS))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r'[()"\-*^:,./\\]', ""))), lambda w: w != ""))


def quoted(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def highlight(text: Column, pattern: str) -> Column:
    """Array of (part, hit): the text cut at every match of a case-insensitive pattern."""
    re = f"(?i){pattern}"
    gaps, hits = F.split(text, re, -1), F.regexp_extract_all(text, F.lit(re), F.lit(0))
    parts = F.transform(gaps, lambda g, i: F.array(F.struct(g.alias("part"), F.lit(False).alias("hit")), F.struct(F.coalesce(F.get(hits, i), F.lit("")).alias("part"), F.lit(True).alias("hit"))))
    return F.filter(F.flatten(parts), lambda p: p["part"] != "")


def preview(text: Column, most: int = 120) -> Column:
    flat = F.trim(collapse(text))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def to_sentence(text: Column) -> Column:
    """Up to the last sentence end; whole without one."""
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?。！])", 1)
    return F.when(cut == "", text).otherwise(cut)


def for_context(text: Column, n_ctx: int, max_tokens: int) -> Column:
    """Text cut to the characters a prompt has room for, at the last sentence or line end inside."""
    room = (n_ctx - max_tokens - 128) * 3
    if room <= 0:
        return F.substring(text, 1, 500)
    head = F.substring(text, 1, room)
    cut = F.regexp_extract(head, r"(?s)^(.*[.\n！。])", 1)
    return F.when(F.length(text) <= room, text).when(cut == "", head).otherwise(cut)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./\\]\.([^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    # Media types by extension.
    return F.when(ext.isin("png", "jpg", "jpeg", "webp", "tiff", "tif"), "image").when(ext == "pdf", "pdf").when(ext.isin("wav", "mp3", "flac", "m4a", "aac", "ogg"), "audio")


def note_text(html: Column) -> Column:
    """Plain text of an HTML note: line breaks and bullets kept as such, tags and runs of blanks gone."""
    t = F.regexp_replace(html, r"(?i)<br[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "• ")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6])>", "\n")
    return F.trim(collapse(F.regexp_replace(t, r"<[^>]+>", "")))


def legacy_note_html(text: Column) -> Column:
    """Paragraphs of a plain-text note."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.split(F.replace(safe, F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n")
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def unfenced(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\n?|\n?```$", ""))


def jsonish(text: Column) -> Column:
    """Near-JSON made JSON: straight quotes, no trailing comma, comma between objects."""
    t = F.translate(strip(text), "“”„‟‘’‚‛", "\"\"\"\"''''")
    return F.regexp_replace(F.regexp_replace(t, r",\s*([\]}])", "$1"), r"\}\s*\{", "},{")


def format_bytes(n: Column) -> Column:
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), unit + 1)
    shown = F.when((unit > 0) & (value < 10), F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))
    return F.concat(shown, F.lit(" "), name)


def to_millis(t: Column) -> Column:
    """Seconds promoted to milliseconds; what is large enough already stays."""
    return F.when((t > 0) & (t < 10**12), t * 1000).otherwise(t)


_MARKS = ("Ã", "Â", "â€")


def _repaired(v: str) -> str:
    """``repair_mojibake`` of one Python string."""
    score = lambda t: sum(t.count(m) for m in (*_MARKS, "�"))
    v = v.strip()
    try:
        again = v.encode("latin-1").decode("utf-8") if any(m in v for m in _MARKS) else v
    except (UnicodeEncodeError, UnicodeDecodeError):
        return v
    return again if score(again) < score(v) else v


def repair_mojibake(text: Column) -> Column:
    """Text that was decoded once too often as Latin-1, decoded again where it can be and where that lowers the number of its telltale marks.

    A second decoding as Windows-1252 gives its own input again and so never lowers it; there is none.
    """
    score = lambda t: F.size(F.regexp_extract_all(t, F.lit("Ã|Â|â€|�"), F.lit(0)))
    again = F.encode(text, "ISO-8859-1").cast("string")
    better = F.when(F.is_valid_utf8(again) & (score(again) < score(text)), again).otherwise(text)
    return F.when(text.rlike("Ã|Â|â€") & text.rlike(r"^[\x00-\xFF]*$"), better).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(values: pd.Series) -> pd.Series:
    """Top-level {...} objects of a text, strings and escapes respected."""

    def one(v):
        out, depth, start, inside, skip = [], 0, 0, False, False
        for i, c in enumerate(v or ""):
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = depth > 0
            elif c == "{":
                start, depth = (i, 1) if not depth else (start, depth + 1)
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    out.append(v[start : i + 1])
        return out

    return values.map(one)


def manual_value(text: Column) -> Column:
    """A value typed by hand without quotation marks, dashes and blanks at its edges."""
    edge = "[\"'“”‘’«»\\-–—\\s]+"
    return F.regexp_replace(text, rf"(?U)^{edge}|{edge}$", "")


def log_preview(text: Column, most: int) -> Column:
    """On one line, line ends shown as escapes, cut with an ellipsis."""
    flat = F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def asset_path(path: Column) -> Column:
    """From the last assets folder on; a path without one is its file name."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?s)^.*/(assets/.*)$", 1)
    return F.when(found == "", file_name(path)).otherwise(found)


def moved_path(path: Column, old: str, new: str) -> Column:
    """Paths under ``old`` with every ``old`` exchanged for ``new``."""
    return F.when(path.startswith(old), F.replace(path, F.lit(old), F.lit(new))).otherwise(path)


def next_version(path: Column) -> Column:
    """a.png, a_v2.png, a_v3.png and so on."""
    stem, ext = F.regexp_extract(path, r"(?s)^(.*?)(\.[^./\\]*)?$", 1), F.regexp_extract(path, r"(?s)^(.*?)(\.[^./\\]*)?$", 2)
    number, base = F.regexp_extract(stem, r"_v([0-9]+)$", 1), F.regexp_replace(stem, r"_v[0-9]+$", "")
    return F.concat(base, F.lit("_v"), F.when(number == "", F.lit(2)).otherwise(number.try_cast("int") + 1).cast("string"), ext)


def page_file(prefix: Column, page: Column) -> Column:
    return F.format_string("%s_page_%d.png", prefix, page)


def model_text(raw: Column) -> Column:
    """A model's answer: cut at turn markers, unfenced, without known lead-ins, unquoted where long or of several lines."""
    # Turn markers and lead-ins.
    cut = strip(F.regexp_extract(F.concat(strip(raw), F.lit("<eos>")), r"(?s)^(.*?)<(?:end_of_turn|start_of_turn|eos)>", 1))
    fenced = F.regexp_replace(F.regexp_replace(cut, r"^```(?:text)*(?:txt)*(?:markdown)*(?:json)*(?:JSON)*\s*", ""), r"\s*```$", "")
    body = F.when(cut.startswith("```"), strip(fenced)).otherwise(cut)
    body = strip(F.regexp_replace(body, r"(?iu)^(?:texto corregido:|texto corregido y unificado:|corrección ocr:|correccion ocr:|resultado corregido:)", ""))
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    quoted_ = body.rlike(r"(?s)^([\"']).*\1$") & (F.length(body) >= 2) & (F.contains(inner, F.lit("\n")) | (F.octet_length(inner) > 80))
    return F.when(quoted_, strip(inner)).otherwise(body)


def model_array(raw: Column) -> Column:
    """The outermost JSON array of a model's answer, or else all of it."""
    text = model_text(raw)
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(found == "", text).otherwise(strip(found))


def framed(output: Column, name: str) -> Column:
    """What a helper process printed between its markers, or else all of it, trimmed."""
    found = F.regexp_extract(output, rf"(?s)==={name}_BEGIN===(.*?)==={name}_END===", 1)
    return strip(F.when(found == "", output).otherwise(found))


# Start and prime of the 64-bit hash.
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(T.LongType())
def cache_key(texts: pd.Series) -> pd.Series:
    """FNV-1a over a text's bytes in UTF-8, as a signed 64-bit number, to look results up by."""

    def one(text: str | None) -> int | None:
        if text is None:
            return None
        h = _FNV_START
        for b in text.encode():
            h = ((h ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return texts.map(one, na_action=None).astype("Int64")


def sound_text(text: Column) -> Column:
    """Text whose lone surrogates are a question mark each, so that offsets stay; other broken bytes become replacement characters."""
    seen = F.decode(text.cast("binary"), "ISO-8859-1")  # a character a byte
    marked = F.regexp_replace(seen, r"\xED[\xA0-\xBF][\x80-\xBF]", "?")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.make_valid_utf8(F.encode(marked, "ISO-8859-1").cast("string")))


def age_label(then: Column, now: Column) -> Column:
    """How long ago a time in milliseconds was: days, else hours, else minutes, else a moment."""
    minutes = F.floor((now - then) / 60000)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(days > 0, label(days, "d")).when(hours > 0, label(hours, "h")).when(minutes > 0, label(minutes, "min")).otherwise("a moment ago")


def layout_page(page: Column, fallback: int = 1) -> Column:
    """A whole page number from 1 on."""
    n = F.when(F.isnan(page.cast("double")) | (F.abs(page.cast("double")) == float("inf")), None).otherwise(page.cast("double"))
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("int")
    return F.when(whole >= 1, whole).otherwise(fallback)


def dictation_extension(mime: Column) -> Column:
    # Recording formats by what their media type contains.
    m = F.lower(mime)
    has = lambda *w: F.coalesce(m.rlike("|".join(w)), F.lit(False))
    return F.when(has("ogg"), "ogg").when(has("mp4", "m4a"), "m4a").when(has("mpeg", "mp3"), "mp3").when(has("wav"), "wav").otherwise("webm")


def split_statements(sql: str) -> list[str]:
    """Statements of a script, cut at semicolons, blank ones dropped."""
    return [part.strip() for part in sql.split(";") if part.strip()]


def search_text(title: Column, metadata: Column) -> Column:
    """What is searched of an item: title and metadata, blanks between JSON tokens gone; metadata that is no JSON counts as it stands."""
    outside = r'[ \t\r\n]+(?=(?:[^"\\]*(?:\\.[^"\\]*)*"(?:[^"\\]|\\.)*")*[^"]*$)'
    small = F.when(F.try_parse_json(metadata).isNotNull(), F.regexp_replace(metadata, outside, "")).otherwise(metadata)
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(small, F.lit("")))
