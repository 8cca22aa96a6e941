"""Logs of requests and choices (STM-1 to STM-5, SNK-2, SNK-5 to SNK-9, SNK-11, API-4, API-5, FLT-11).

The batch form and the stream form share ``folded``: a request is inserted once and never overwritten, each choice
counts once by its event id, the last corrected text wins, and a choice that comes before its request leaves a row for
it. Everything is a grouped aggregation by log id with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from textloom.functions.text import sanitized

#: The longest text that a field of the log takes.
CAPS = {"input": 50_000, "initial_output": 50_000, "notes": 20_000, "final_output": 50_000, "token": 500, "chosen": 500}
LOG_COLUMNS = ("log_id", "logged_at", "input", "initial_output", "notes", "final_output")


def capped(df: DataFrame) -> DataFrame:
    """Texts cut to what their field takes and safe for spreadsheets (SNK-2, SNK-8)."""
    return df.withColumns({c: sanitized(F.substring(F.col(c), 1, n)) for c, n in CAPS.items() if c in df.columns})


def once(events: DataFrame) -> DataFrame:
    """Each event of a log once, the first that came (STM-2)."""
    w = Window.partitionBy("log_id", "event_id").orderBy("received_at", "row_id")
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_requests(logs: DataFrame) -> DataFrame:
    """Each request once: a later delivery doesn't overwrite it (SNK-5)."""
    w = Window.partitionBy("log_id").orderBy("received_at", "row_id")
    return logs.where("log_id is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def folded(logs: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, input, final_output, chosen_notes, n_events, placeholder) after all events (SNK-6, STM-3, STM-4).

    The last event is the one received last, ties by row id; a null text doesn't replace one.
    """
    order = F.struct("received_at", "row_id")
    kept = once(events.where("log_id is not null"))
    line = F.concat(F.coalesce("token", F.lit("")), F.lit(" -> "), F.coalesce("chosen", F.lit("")))
    # Of each token the line of its last choice, in the order in which tokens were first chosen.
    lines = kept.groupBy("log_id", "token").agg(F.min(order).alias("first"), F.max_by(line, order).alias("line"), F.count("*").alias("n"), F.max_by("final_output", F.when(F.col("final_output").isNotNull(), order)).alias("out"), F.max(F.when(F.col("final_output").isNotNull(), order)).alias("at"))
    chosen = lines.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "\n").alias("chosen_notes"), F.sum("n").alias("n_events"), F.max_by("out", "at").alias("last_output"))
    own = first_requests(logs).select("log_id", "input", "final_output", F.lit(False).alias("known"))
    joined = own.join(chosen, "log_id", "full_outer")
    return joined.select("log_id", "input", F.coalesce("last_output", "final_output").alias("final_output"), F.coalesce("chosen_notes", F.lit("")).alias("chosen_notes"), F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("known").isNull().alias("placeholder"))


def created(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New requests whose log id isn't there yet (SNK-5)."""
    return first_requests(new).join(existing.select("log_id"), "log_id", "left_anti")


def upserted(existing: DataFrame, new: DataFrame, by: str = "log_id") -> DataFrame:
    """Rows of both, the new one where both have the key (SNK-11)."""
    columns = existing.columns
    return existing.join(new.select(by), by, "left_anti").select(columns).unionByName(new.select(columns))


def stream_events(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """A stream of choices without repeated deliveries within ``delay`` (STM-2)."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["log_id", "event_id"])


def stream_to(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Choices appended to a table, one batch at a time (STM-5); a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        capped(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream_events(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def sentences(lines: DataFrame, block_lines: int = 50_000) -> DataFrame:
    """(file, line_no, sentence): running number of the sentence in its file (STM-1).

    Blocks of lines are numbered for themselves; each adds what the blocks before it hold.
    """
    text = F.btrim(F.coalesce(F.col("line"), F.lit("")))
    end = ((text == "") | text.startswith("<") | text.startswith("#")).cast("bigint")
    rows = lines.select("file", "line_no", "row_id", end.alias("end")).withColumn("block", F.floor(F.col("line_no") / block_lines))
    own = Window.partitionBy("file", "block").orderBy("line_no", "row_id")
    blocks = rows.groupBy("file", "block").agg(F.sum("end").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.withColumn("own", F.sum("end").over(own)).join(before, ["file", "block"]).select("file", "line_no", "row_id", (F.col("own") + F.col("before")).alias("sentence"))


def _error(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules])


def checked_requests(df: DataFrame, text: str = "text", most: int = 100_000) -> DataFrame:
    """Requests with an error code, or null where they may pass (FLT-11, API-1)."""
    c = F.col(text)
    return df.withColumn("error", _error([("missing", c.isNull()), ("blank", F.btrim(c) == ""), ("too_long", F.char_length(c) > most)]))


def checked_feedback(df: DataFrame) -> DataFrame:
    """Feedback with an error code (API-5): e-mail, subject, message and screenshot within their limits."""
    picture = F.coalesce(F.col("screenshot_data_url"), F.lit(""))
    data = F.regexp_extract(picture, r"^data:image/(?:png|jpe?g|webp|gif);base64,([A-Za-z0-9+/]*={0,2})$", 1)
    octets = F.length(data) * 3 / 4
    rules = [
        ("email", ~(F.char_length("email") <= 254) | ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
        ("subject", ~F.char_length(F.btrim("subject")).between(1, 200)),
        ("message", ~F.char_length(F.btrim("message")).between(1, 10_000)),
        ("screenshot", (picture != "") & (data == "")),
        ("screenshot_too_large", octets > 2 * 1024 * 1024),
    ]
    return df.withColumn("error", _error(rules))
