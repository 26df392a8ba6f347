"""Drafting a search in a dialogue: one turn of many conversations at once, and the drafts that come of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.contracts import parse_turn
from tessera.functions.prompts import builder_prompt
from tessera.operators.schedule import saveable
from tessera.ports.models import LanguageModel
from tessera.store.tables import Store, staged
from tessera.vocabulary import call_of


def next_turns(messages: DataFrame, make: Callable[[], LanguageModel], conv: str = "conv_id") -> DataFrame:
    """(conv, message, text, city, schedule_cron, schedule_text, max_results_shown): the builder's next turn of each conversation.

    ``messages``: conv, turn, role, text.  A model is made once a task and asked once per
    conversation; a reply that can't be read is an apology and no draft.  The result is
    written, so reading it again asks nobody.
    """
    call = call_of("builder")
    turns = messages.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    asked = turns.select(F.col(conv).alias("conv"), builder_prompt(F.col("turns")).alias("prompt"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield pd.DataFrame({"conv": f["conv"], "reply": [model.submit([{"role": "user", "content": p}], call) for p in f["prompt"]]})

    kind = messages.schema[conv].dataType.simpleString()
    replies = staged(asked.mapInPandas(ask, f"conv {kind}, reply string"), "builder-replies")
    return replies.select(F.col("conv").alias(conv), parse_turn(F.col("reply")).alias("t")).select(conv, "t.*")


def save_drafts(store: Store, turns: DataFrame, user: str, version: int, conv: str = "conv_id") -> DataFrame:
    """Keep ready drafts with a readable schedule (or none) as the user's saved queries; returns the others, to be asked about."""
    drafts = saveable(turns.filter("text IS NOT NULL"))
    good = drafts.filter("valid").select(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(user), F.col(conv).cast("string"), F.lit(str(version))), 256), 1, 22).alias("id"), F.lit(user).alias("user_id"), "text", "city", "schedule_cron", "schedule_text", "max_results_shown", F.lit(True).alias("enabled"))
    store.append_as("saved_queries", good, version, once=f"drafts-{version}")
    return drafts.filter("NOT valid")
