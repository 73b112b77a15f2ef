"""Language-model jobs as rows: names, targets, budgets and prompts. Generation itself is a plug-in (``quillet.plugins``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import for_context

#: Tokens that an answer may take.
BUDGET = {"correct_ocr": 2048, "extract_entities": 1024, "consolidate_entities": 1024, "extract_triples": 1024, "summarize": 512, "classify": 256, "ask": 512}
TASKS = {
    "correct_ocr": "Below is text read from a scanned page. Correct what was misread and change nothing else. Answer with the text alone.",
    "extract_entities": 'List the persons, places, dates, institutions and organisations named below, as a JSON array of objects with "value", "type" and "confidence". Answer with the array alone.',
    "consolidate_entities": 'Entities found in a text and the text are below. Drop wrong ones, mend spellings, add what is missing, and answer with a JSON array of objects with "value", "type" and "confidence" alone.',
    "extract_triples": 'State the relations told below as a JSON array of objects with "subject", "predicate" and "object". Answer with the array alone.',
    "summarize": "Sum the text below up in a few sentences, in its own language.",
    "classify": "Choose the one category below that fits the text best. Answer with the category alone.",
    "ask": "Answer the question from the documents below alone, and say so if they don't answer it.",
}


def job_name(kind: Column) -> Column:
    """What a job is called: those on an asset as those on an item."""
    return F.regexp_replace(kind, "_asset$", "")


def target_type(kind: Column) -> Column:
    return F.when(kind == "ask", "collection").when(kind.endswith("_asset"), "asset").otherwise("item")


def target_id(kind: Column, item: Column, asset: Column, collection: Column) -> Column:
    by = target_type(kind)
    return F.when(by == "asset", asset).when(by == "collection", collection).otherwise(item)


def max_tokens(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BUDGET.items() for x in kv])[job_name(kind)]


def requests(jobs: DataFrame, n_ctx: int = 8192) -> DataFrame:
    """(job_id, job, target_type, target_id, max_tokens, prompt, error) from (job_id, kind, item_id, asset_id, collection_id, text, extra).

    The text is cut to what the context has room for. ``extra`` is what a task takes besides: candidate entities, categories, the question. A job without text has no prompt and an error.
    """
    job = job_name(F.col("kind"))
    body = F.lit(None).cast("string")
    for name, most in BUDGET.items():
        extra = F.when(F.coalesce(F.col("extra"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("extra"))).otherwise("")
        body = F.when(job == name, F.concat(F.lit(TASKS[name]), extra, F.lit("\n\n"), for_context(F.col("text"), n_ctx, most))).otherwise(body)
    has = F.trim(F.coalesce(F.col("text"), F.lit(""))) != ""
    return jobs.select(
        "job_id", job.alias("job"), target_type(F.col("kind")).alias("target_type"), target_id(F.col("kind"), F.col("item_id"), F.col("asset_id"), F.col("collection_id")).alias("target_id"),
        max_tokens(F.col("kind")).alias("max_tokens"), F.when(has, body).alias("prompt"), F.when(~has, "no text").alias("error"),
    )
