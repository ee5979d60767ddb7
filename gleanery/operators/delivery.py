"""The policy of notifications: which digest goes out on which channel, and what the log keeps of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.telemetry import is_quiet

#: The channels there are. The console speaks at night too.
CHANNELS = ("console", "telegram", "email", "webhook", "file")
ALWAYS_ON = "console"


@dataclass(frozen=True)
class Policy:
    """Channels in order, most rows of a digest, quiet hours (from, to; equal: none), hours within which a digest isn't sent twice.
    `dry_run` sends nothing; `force` sends in spite of quiet hours, repeats and a dry run."""

    channels: tuple[str, ...] = ("console",)
    daily_cap: int = 25
    quiet: tuple[int, int] = (0, 7)
    window_hours: int = 20
    dry_run: bool = False
    force: bool = False


def deliveries(digests: DataFrame, log: DataFrame, policy: Policy) -> DataFrame:
    """Adds channel, outcome, logged to the rows of `digests` (digest_key, at, rows and others), one row a channel, and cuts rows to the cap.

    outcome is nothing (no rows; null counts as 0), duplicate (the key was sent within the window, up to and with `at`), unknown (no such channel), quiet,
    dry-run or send; nothing and duplicate hold for all channels and are one row of channel `all`. logged: dry-run and send. `log` has digest_key,
    created_at, status; a null key is never a duplicate. One shuffle by key: repeats are found by one window over digests and sent rows.
    """
    sent = log.where("status = 'sent' AND digest_key IS NOT NULL").select("digest_key", F.col("created_at").alias("at"), F.lit(True).alias("_sent"))
    both = digests.withColumn("_sent", F.lit(False)).unionByName(sent, allowMissingColumns=True)
    before = F.expr(f"max(IF(_sent, at, NULL)) OVER (PARTITION BY digest_key ORDER BY at RANGE BETWEEN INTERVAL '0 {policy.window_hours}:00:00' DAY TO SECOND PRECEDING AND CURRENT ROW)")
    none = F.coalesce(F.col("rows"), F.lit(0)) == 0
    twice = F.col("_before").isNotNull() & F.lit(not policy.force)
    out = both.withColumn("_before", before).where("NOT _sent").withColumn("channel", F.explode(F.when(none | twice, F.array(F.lit("all"))).otherwise(F.array(*map(F.lit, policy.channels)))))
    outcome = (F.when(none, "nothing").when(twice, "duplicate").when(~F.col("channel").isin(*CHANNELS), "unknown")
               .when(is_quiet(F.col("at"), *policy.quiet) & (F.col("channel") != ALWAYS_ON) & F.lit(not policy.force), "quiet")
               .when(F.lit(policy.dry_run and not policy.force), "dry-run").otherwise("send"))
    return (out.withColumn("outcome", outcome).withColumn("logged", F.col("outcome").isin("dry-run", "send"))
            .withColumn("rows", F.least(F.coalesce("rows", F.lit(0)), F.lit(policy.daily_cap))).drop("_sent", "_before"))


def log_rows(delivered: DataFrame, recipient: str | None = None) -> DataFrame:
    """The rows of the notification log that `deliveries` asks for; what was to be sent counts as sent."""
    return delivered.where("logged").select(F.col("at").alias("created_at"), "channel", F.lit(recipient).cast("string").alias("recipient"), "digest_key", F.col("rows").cast("int").alias("count"),
                                            F.when(F.col("outcome") == "send", "sent").otherwise(F.col("outcome")).alias("status"))
