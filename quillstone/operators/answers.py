"""Answers: from polled observations to the text that has settled.

Observations have a key, an order (any columns), a text, and maybe a flag for polls
that showed a placeholder.  Placeholders and empty texts are skipped without breaking
a run of equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import strip

ONE_SHOT, SESSION = 4, 3  # equal observations in a row that make an answer
DEADLINE = 120
SUFFIX = "Is that all you need to know?"


def usable(obs: DataFrame, previous: Column | None = None) -> DataFrame:
    """Stripped texts without placeholders, blanks, and (session form) the previous answer."""
    out = obs.filter(~F.coalesce("thinking", F.lit(False))) if "thinking" in obs.columns else obs
    out = out.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    return out if previous is None else out.filter(~F.col("text").eqNullSafe(strip(previous)))


def stable(obs: DataFrame, k: int, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Per key, the first observation that completes ``k`` equal ones in a row, with its length so far.

    Three window passes share one sort per key.  A key is one stream of polls, which
    its deadline bounds.
    """
    by = Window.partitionBy(key).orderBy(*order)
    runs = obs.withColumn("changed", F.when(F.lag("text").over(by).eqNullSafe(F.col("text")), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("changed").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy(*order)))
    done = runs.filter(F.col("n") == k).withColumn("rank", F.row_number().over(by)).filter("rank = 1")
    return done.drop("changed", "run", "n", "rank")


def before_deadline(obs: DataFrame, started: Column, seconds: int = DEADLINE) -> DataFrame:
    """Observations less than ``seconds`` after the question."""
    return obs.filter(F.col("ts") < started + F.expr(f"interval {seconds} seconds"))


def latest(obs: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The newest usable text per key; combines before the shuffle."""
    return usable(obs).groupBy(key).agg(F.max_by("text", F.struct(*order)).alias("text"))


def unseen(obs: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Observations whose text differs from the one before."""
    by = Window.partitionBy(key).orderBy(*order)
    before = obs.withColumn("before", F.lag("text").over(by))
    return before.filter("before is null or before <> text").drop("before")


def pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each user turn with the next turn if that is the assistant's; else an error row."""
    by = Window.partitionBy(conv).orderBy(turn)
    both = turns.withColumns({"next_role": F.lead("role").over(by), "next_text": F.lead("text").over(by)}).filter("role = 'user'")
    answered = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    return both.select(conv, turn, F.col("text").alias("question"), F.when(answered, F.col("next_text")).alias("answer"), F.when(answered, "success").otherwise("error").alias("status"))


def with_suffix(answers: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """The follow-up reminder in a column of its own; the answer stays as it is."""
    return answers.withColumn("reminder", F.when(F.col("answer").isNotNull(), F.lit(suffix)))


def gated(questions: DataFrame, has_state: Column) -> DataFrame:
    """Without saved state a question has no answer."""
    return questions.withColumns({"answer": F.when(has_state, F.col("answer")), "status": F.when(has_state, F.col("status")).otherwise("error")})


def resolve_targets(requests: DataFrame, catalog: DataFrame, state: DataFrame) -> DataFrame:
    """Target URL: the one given, else that of the id given (unknown: an error, with no fallback), else the active notebook's."""
    by_id = catalog.select(F.col("id").alias("notebook_id"), F.col("url").alias("id_url"), F.lit(True).alias("known"))
    now = state.join(catalog, F.col("active_id") == F.col("id"), "left").select(F.col("url").alias("active_url"))  # one row
    both = requests.join(by_id, "notebook_id", "left").crossJoin(F.broadcast(now))
    given, named = F.nullif("url", F.lit("")), F.nullif("notebook_id", F.lit(""))
    target = F.coalesce(given, F.when(named.isNotNull(), F.col("id_url")).otherwise(F.col("active_url")))
    status = F.when(given.isNotNull(), "url").when(named.isNotNull(), F.when(F.col("known"), "id").otherwise("unknown id")).otherwise(F.when(F.col("active_url").isNotNull(), "active").otherwise("none"))
    return both.select("request_id", target.alias("target"), status.alias("status"))
