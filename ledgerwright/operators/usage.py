"""The usage ledger: totals, running totals, daily sums, thresholds, sessions, and intervals of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def tidy(ledger: DataFrame) -> DataFrame:
    """The ledger with one spelling of callers and models, missing totals made of their parts, and lines collected twice once.

    Lines are the same if all they state is the same but when they were read; the first read counts.
    """
    said = ["ts", "date", "pid", "model", "caller", "prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "prompt_chars"]
    once = ledger.groupBy(*said).agg(F.min("ledger_id").alias("ledger_id"), F.min("read_at").alias("read_at"))
    parts = F.when(F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull(), F.col("prompt_tokens") + F.col("completion_tokens"))
    return once.select(
        "ledger_id", "pid", "read_at", F.lower("model").alias("model"), F.when(F.lower("caller") != "?", F.lower("caller")).alias("caller"),
        "prompt_tokens", "completion_tokens", F.coalesce("total_tokens", parts).alias("tokens"),
    )


def totals(ledger: DataFrame) -> DataFrame:
    """caller, model, calls, unknown, tokens: per caller, per model and over all, in one pass of grouping sets (absent keys read `*`)."""
    d = tidy(ledger).na.fill("unknown", ["caller", "model"])
    g = d.groupingSets([[F.col("caller")], [F.col("model")], []], "caller", "model").agg(F.count("*").alias("calls"), F.sum(F.col("tokens").isNull().cast("int")).alias("unknown"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return g.na.fill("*", ["caller", "model"])


def by_read_day(ledger: DataFrame) -> DataFrame:
    """day, calls, tokens, running_tokens: sums per day of collection and what they add up to. The window runs over days, not lines."""
    days = tidy(ledger).groupBy(F.to_date("read_at").alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return days.withColumn("running_tokens", F.sum("tokens").over(W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


def over_budget(ledger: DataFrame, budget: int) -> DataFrame:
    """pid, day, tokens, share: writers' days above a budget of tokens."""
    d = tidy(ledger).groupBy("pid", F.to_date("read_at").alias("day")).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return d.where(F.col("tokens") > budget).withColumn("share", F.round(F.col("tokens") / budget, 4))


def notices(ledger: DataFrame, cap: int, steps: tuple[float, ...] = (0.5, 0.8, 1.0), size: int = 4096) -> DataFrame:
    """day, step, ledger_id, tokens: the line by which a day of collection reaches a share of the cap, in the order of lines; once per day and step.

    Sums of blocks of lines are added up first, so a day with many lines is no single window; only the blocks in which a
    step is reached are looked at line by line.
    """
    d = tidy(ledger).where("tokens IS NOT NULL AND read_at IS NOT NULL").select(F.to_date("read_at").alias("day"), F.floor(F.col("ledger_id") / size).alias("block"), "ledger_id", "tokens")
    block = d.groupBy("day", "block").agg(F.sum("tokens").alias("total"))
    block = block.withColumn("before", F.coalesce(F.sum("total").over(W.partitionBy("day").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    reached = block.select("*", F.explode(F.array(*map(F.lit, steps))).alias("step")).where((F.col("before") < F.col("step") * cap) & (F.col("before") + F.col("total") >= F.col("step") * cap))
    run = F.col("before") + F.sum("tokens").over(W.partitionBy("day", "block", "step").orderBy("ledger_id").rowsBetween(W.unboundedPreceding, 0))
    line = d.join(reached.select("day", "block", "before", "step"), ["day", "block"]).withColumn("run", run).where(F.col("run") >= F.col("step") * cap)
    return line.groupBy("day", "step").agg(F.min("ledger_id").alias("ledger_id"), F.min_by("run", "ledger_id").alias("tokens"))


def top_writers(ledger: DataFrame, n: int = 12) -> DataFrame:
    d = tidy(ledger).groupBy("pid").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return d.orderBy(F.desc("tokens"), "pid").limit(n)


def sessions(stamped: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """pid, session, started, ended, calls of lines (pid, at): a session ends with a pause longer than the gap.

    A writer's lines are cut into days first, so that a hot writer isn't one task; sessions that meet at midnight are
    joined by a second window over the few that touch.
    """
    gap = f"INTERVAL {gap_minutes} MINUTES"
    d = stamped.where("at IS NOT NULL").withColumn("day", F.to_date("at"))
    by = W.partitionBy("pid", "day").orderBy("at")
    d = d.withColumn("new", F.coalesce((F.col("at") > F.lag("at").over(by) + F.expr(gap)).cast("int"), F.lit(1))).withColumn("s", F.sum("new").over(by))
    part = d.groupBy("pid", "day", "s").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("calls"))
    over = W.partitionBy("pid").orderBy("started")
    part = part.withColumn("new", F.coalesce((F.col("started") > F.lag("ended").over(over) + F.expr(gap)).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(over))
    return part.groupBy("pid", "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("calls").alias("calls"))


def within_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """run, calls, tokens: what was read between the start and end of each run; runs without lines have none.

    Ledger and runs meet on the days they touch, so the join has a key and neither side must be broadcast.
    """
    d = tidy(ledger).where("read_at IS NOT NULL").select("read_at", "tokens", F.to_date("read_at").alias("day"))
    first, last = F.to_date("starts"), F.to_date("ends")
    days = runs.where("starts < ends").select("run", "starts", "ends", F.explode(F.sequence(first, last)).alias("day"))
    hit = days.join(d, "day").where("read_at >= starts AND read_at < ends").groupBy("run").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return runs.select("run").distinct().join(hit, "run", "left").select("run", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
