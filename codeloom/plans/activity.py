"""Queries that derive rows from code text, batches for enrichment, contexts and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, validate
from ..operators import queue, tables
from ..session import table
from ..streaming.watch import quiet_sessions

# Words that are followed by a bracket without being a call.
NOT_CALLED = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "async", "super", "import", "constructor"]
_CALL = r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\("


def called_names(body: Column) -> Column:
    """The distinct names that a body calls, in order; `this.` is left off, and a name at the start is the definition's own."""
    names = F.transform(F.regexp_extract_all(body, F.lit(_CALL), F.lit(1)), lambda n: F.regexp_replace(n, r"^this\.", ""))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(NOT_CALLED)))


def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges read from the bodies; a function's own name is left out."""
    functions = table(spark, sf_dir, "functions").select("id", "name", "body").dropDuplicates(["id"])
    own = F.substring_index("name", ".", -1)
    return functions.select("id", own.alias("own"), F.posexplode(called_names(F.col("body"))).alias("pos", "callee_name")).where("callee_name <> own").select("id", "callee_name")


def body_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, characters and tokens of the code of each file."""
    functions = table(spark, sf_dir, "functions").select("id", "file_id", "body").dropDuplicates(["id"])
    lines = F.size(F.split("body", "\n"))
    return functions.groupBy("file_id").agg(F.count("*").alias("functions"), F.sum(lines).alias("lines"), F.sum(F.length("body").cast("long")).alias("chars"), F.max(lines).cast("long").alias("longest"))


# What the notes on cut contexts say, and the bulky parts that go first.
CUT_NOTE, OMITTED_NOTE = "[Context truncated to fit ~{} tokens.]", "[Context truncated to fit ~{} tokens; large handler bodies and type definitions were omitted.]"
HANDLER_BODY, DEFINITION = r"\n[ \t]+Handler body: .*(?=\n|\z)", r"(?s)\n[ \t]+Definition:\n.*?(?=\n\n\d+\.|\n\n[A-Z][A-Za-z]+:|\z)"


def fitted(context: Column, max_tokens: int) -> Column:
    """A context within a token budget: bulky parts go first, then the end, at a line."""
    budget = max(500, max_tokens * 4)
    without = F.regexp_replace(F.regexp_replace(context, HANDLER_BODY, ""), DEFINITION, "")
    cut = F.regexp_replace(F.substring(without, 1, budget), r"\n[^\n]*\z", "")
    return (
        F.when(text.estimated_tokens(context) <= max_tokens, context).when(text.estimated_tokens(without) <= max_tokens, F.concat(without, F.lit("\n\n" + OMITTED_NOTE.format(max_tokens))))
        .otherwise(F.concat(cut, F.lit("\n\n" + CUT_NOTE.format(max_tokens))))
    )


def batch_prompts(functions: DataFrame, waiting: DataFrame, size: int = 8) -> DataFrame:
    """(batch, prompt): T12; the functions that wait, in queue order, a batch per prompt."""
    placed = queue.pending_batches(waiting, size).select("function_id", "rank", "batch")
    lines = placed.join(functions.select(F.col("id").alias("function_id"), "name", "signature"), "function_id").select("batch", "rank", F.concat_ws(" | ", "name", "signature").alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"])
    return lines.groupBy("batch").agg(F.array_join(listed, "\n").alias("prompt"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "functions").select("id", "name", "signature").dropDuplicates(["id"])
    return batch_prompts(functions, table(spark, sf_dir, "analysis_queue")).select(F.col("batch").cast("long").alias("batch"), "prompt")


def own_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, reply): for every batch of waiting functions, in queue order, their stored semantic fields as the JSON text of a reply."""
    now = tables.latest(table(spark, sf_dir, "functions").select("id", "name", "purpose", "side_effects_json", "behavior_summary", "domain", "complexity", "updated_at"))
    fields = now.select(
        F.col("id").alias("function_id"),
        F.struct(F.col("name").alias("function_name"), "purpose", F.from_json("side_effects_json", "array<string>").alias("side_effects"), F.col("behavior_summary").alias("behavior"), "domain", "complexity").alias("item"),
    )
    placed = queue.pending_batches(table(spark, sf_dir, "analysis_queue")).select("function_id", "rank", "batch").join(fields, "function_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.to_json("item").alias("item")))), lambda s: s["item"])
    return placed.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.concat(F.lit("```json\n["), F.array_join(listed, ", "), F.lit("]\n```")).alias("reply"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the replies validated item by item; per batch and name the first item counts."""
    items = validate.validated_items(own_replies(spark, sf_dir), "batch", "reply").where("error IS NULL")
    first = tables.one_per_key(items, ["id", "name"], [F.col("pos")])
    return first.select(F.col("id").alias("batch"), "name", "purpose", "domain", "complexity")


def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the items that lack a field, with what is wrong."""
    return validate.validated_items(own_replies(spark, sf_dir), "batch", "reply").where("error IS NOT NULL").select(F.col("id").alias("batch"), F.col("pos").cast("long").alias("pos"), "error")


def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of each user without a gap of more than ten minutes."""
    return quiet_sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "10 minutes")


QUERIES = {f.__name__: f for f in (extracted_calls, body_measures, prompts, enriched, rejected_items, quiet_runs)}

_QUEUE = "qu AS (SELECT * REPLACE (lower(trim(status)) AS status) FROM analysis_queue QUALIFY row_number() OVER (PARTITION BY id ORDER BY processed_at DESC NULLS LAST, status) = 1)"
_BATCHES = f"""{_QUEUE}, one AS (SELECT DISTINCT id, name, signature FROM functions),
ra AS (SELECT function_id, row_number() OVER (ORDER BY priority DESC NULLS LAST, created_at NULLS LAST, id) AS rank FROM qu WHERE status = 'pending'),
li AS (SELECT (rank - 1) // 8 AS batch, rank, name, name || ' | ' || signature AS line FROM ra JOIN one ON one.id = function_id)"""
_DOMAIN = f"CASE WHEN lower(trim(domain)) IN ({', '.join(repr(d) for d in validate.DOMAINS)}) THEN lower(trim(domain)) ELSE 'other' END"
_REPLIES = f"""{_BATCHES}, fn AS (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
it AS (SELECT (rank - 1) // 8 AS batch, row_number() OVER (PARTITION BY (rank - 1) // 8 ORDER BY rank) - 1 AS pos, fn.*, concat_ws(', ', CASE WHEN purpose IS NULL THEN 'purpose' END,
 CASE WHEN coalesce(CASE WHEN json_valid(side_effects_json) THEN json_type(side_effects_json) END, '') <> 'ARRAY' THEN 'side_effects' END, CASE WHEN behavior_summary IS NULL THEN 'behavior' END, CASE WHEN domain IS NULL THEN 'domain' END, CASE WHEN complexity IS NULL THEN 'complexity' END) AS missing
 FROM ra JOIN fn ON fn.id = function_id)"""

ORACLE = {
    "extracted_calls": f"""WITH one AS (SELECT DISTINCT id, name, body FROM functions), c AS (SELECT DISTINCT id, string_split(name, '.')[-1] AS own,
 unnest(list_transform(regexp_extract_all(body, '{_CALL}', 1), lambda n: regexp_replace(n, '^this\\.', ''))) AS callee_name FROM one)
SELECT id, callee_name FROM c WHERE callee_name <> own AND callee_name NOT IN ({', '.join(repr(n) for n in NOT_CALLED)})""",
    "body_measures": """WITH one AS (SELECT DISTINCT id, file_id, body FROM functions)
SELECT file_id, count(*) AS functions, sum(len(string_split(body, chr(10))))::BIGINT AS lines, sum(length(body))::BIGINT AS chars, max(len(string_split(body, chr(10))))::BIGINT AS longest FROM one GROUP BY file_id""",
    "prompts": f"WITH {_BATCHES} SELECT batch, string_agg(line, chr(10) ORDER BY rank) AS prompt FROM li GROUP BY batch",
    "enriched": f"""WITH {_REPLIES} SELECT batch, trim(name) AS name, trim(regexp_replace(purpose, '\\s+', ' ', 'g')) AS purpose, {_DOMAIN} AS domain,
 CASE WHEN lower(trim(complexity)) IN ('low', 'medium', 'high') THEN lower(trim(complexity)) ELSE 'medium' END AS complexity FROM it WHERE missing = '' QUALIFY row_number() OVER (PARTITION BY batch, trim(name) ORDER BY pos) = 1""",
    "rejected_items": f"WITH {_REPLIES} SELECT batch, pos, 'missing fields: ' || missing AS error FROM it WHERE missing <> ''",
    "quiet_runs": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM g GROUP BY user_id, run""",
}
