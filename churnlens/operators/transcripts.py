"""Session transcripts: lines of JSON to one entry per response, token buckets, tallies by model; as batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators import usage
from churnlens.streaming import responses

# The five buckets of tokens, where a response's usage names each, and the model of rows that no model wrote.
BUCKETS = ["input", "cache_write_5m", "cache_write_1h", "cache_read", "output"]
PLAIN = {"input": "input_tokens", "cache_read": "cache_read_input_tokens", "output": "output_tokens"}
SYNTHETIC = "<synthetic>"
#: A model's name with a date behind it is the model.
DATED = r"-[0-9]{8}\z"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _of(v: Column, path: str, kind: str, to: str) -> Column:
    """What lies at a path, if it is of that kind: a number in quotes is no number, true is none either."""
    there = F.try_variant_get(v, path, "variant")
    return F.when(_kind(there) == kind, F.try_variant_get(v, path, to))


def moment(text: Column) -> Column:
    """A time of ISO 8601; without an offset it is UTC; null where it is none."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), full.try_cast("timestamp"))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines that hold something, with bad (no JSON), and of responses message, model, at and the token buckets (operator 9).

    Rows that are no response of a model (another type, no usage, no model or a synthetic one) have a null model. A message is named by
    its id or else its request.
    """
    v = F.col("_v")
    # as the output of a generator a line's value is made once: no filter on what is read from it is pushed below
    held = lines.where(F.trim(F.col(line)) != "").withColumn("_v", F.explode(F.array(F.try_parse_json(line))))
    has_usage = _kind(F.try_variant_get(v, "$.message.usage", "variant")) == "OBJECT"
    known = held.withColumns({"_model": _of(v, "$.message.model", "STRING", "string"), "_type": _of(v, "$.type", "STRING", "string"), "_used": has_usage})
    real = known.withColumn("_real", F.coalesce((F.col("_type") == "assistant") & F.col("_used") & (F.col("_model") != SYNTHETIC), F.lit(False)))
    # what is not a response is not looked into; each step's columns are made once
    own = real.withColumn("_u", F.when(F.col("_real"), F.try_variant_get(v, "$.message.usage", "variant")))
    count = lambda path: F.coalesce(_of(F.col("_u"), f"$.{path}", "BIGINT", "bigint"), F.lit(0).cast("long"))
    detail = "cache_creation.ephemeral_{}_input_tokens"
    there = F.greatest(*(F.try_variant_get("_u", f"$.{detail.format(x)}", "variant").isNotNull() for x in ("5m", "1h")))
    name = lambda path: F.nullif(_of(v, path, "STRING", "string"), F.lit(""))
    sums = own.withColumns({b: count(p) for b, p in PLAIN.items()} | {"_split": there, "_5m": count(detail.format("5m")), "_1h": count(detail.format("1h")), "_plain": count("cache_creation_input_tokens"), "_id": name("$.message.id"), "_request": name("$.requestId"), "_time": _of(v, "$.timestamp", "STRING", "string")})
    only = lambda c: F.when(F.col("_real"), c)
    wrote = {"cache_write_5m": F.when(F.col("_split"), F.col("_5m")).otherwise(F.col("_plain")), "cache_write_1h": F.when(F.col("_split"), F.col("_1h")).otherwise(F.lit(0).cast("long"))}
    return sums.select(*lines.columns, v.isNull().alias("bad"), only(F.coalesce("_id", "_request")).alias("message"), only(F.col("_model")).alias("model"), moment(F.col("_time")).alias("at"), *(only(wrote.get(b, F.col(b))).alias(b) for b in BUCKETS))


def _in_window(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    for bound, test in ((since, F.col("at") >= moment(F.lit(since))), (until, F.col("at") <= moment(F.lit(until)))):
        if bound:
            rows = rows.where(test)
    return rows


def entries(lines: DataFrame, session: str = "session", pos: str = "pos", line: str = "line", since: str | None = None, until: str | None = None) -> DataFrame:
    """session, message, model, at and buckets of each response once, by its last block in the window (bounds included); without a bound all
    rows count, with one those whose time can be read. A response without a name is one of its own."""
    rows = _in_window(parsed(lines, line).where(F.col("model").isNotNull()), since, until)
    keyed = rows.select(session, pos, F.when(F.col("message").isNotNull(), F.struct(session, "message")).alias("key"), "message", "model", "at", *BUCKETS)
    return usage.last_response(keyed, "key", pos).select(session, "message", "model", "at", *BUCKETS)


def skipped(lines: DataFrame, session: str = "session", line: str = "line") -> DataFrame:
    """session, lines, skipped: lines that hold something, and those of them that are no JSON."""
    return parsed(lines, line).groupBy(session).agg(F.count("*").alias("lines"), F.count_if("bad").alias("skipped"))


def weighted(weights: dict[str, dict[str, float]]) -> Column:
    """The weighted sum of a model's buckets, rounded half to even, or null where neither the model nor its undated name has weights."""

    def of(name: Column) -> Column:
        return F.coalesce(*(F.when(name == m, sum((F.col(b) * w[b] for b in BUCKETS), F.lit(0.0))) for m, w in weights.items()))

    return F.bround(F.coalesce(of(F.col("model")), of(F.regexp_replace("model", DATED, "")))).cast("long")


def tallies(rows: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """model, calls, the buckets and their weighted sum, of each model; a model without weights has a null one, and is to be named as missing."""
    return rows.groupBy("model").agg(F.count("*").alias("calls"), *(F.sum(b).alias(b) for b in BUCKETS)).withColumn("weighted", weighted(weights))


def streamed(lines: DataFrame, late: str = "10 minutes", line: str = "line") -> DataFrame:
    """As entries of a stream of lines: each named response once within the watermark, by the first block that comes, as later ones cannot be
    waited for. Rows without a readable time cannot be ordered and are left out, as are responses without a name."""
    rows = parsed(lines, line).where(F.col("model").isNotNull() & F.col("message").isNotNull() & F.col("at").isNotNull())
    return responses.first_response(responses.timed(rows, "at", late), "message")


def streamed_tallies(lines: DataFrame, width: str = "1 hour", late: str = "10 minutes", line: str = "line") -> DataFrame:
    """start, model, calls and buckets of each window of a stream, given out once the watermark has passed it."""
    each = streamed(lines, late, line).groupBy(F.window("at", width), "model").agg(F.count("*").alias("calls"), *(F.sum(b).alias(b) for b in BUCKETS))
    return each.select(F.col("window.start").alias("start"), "model", "calls", *BUCKETS)
