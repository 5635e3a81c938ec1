"""The continuation of a work whose table of contents is rendered chunk by chunk: what each chunk does, and when the loop ends.

A chunk with a place in the table is merged (a later one of the same place takes its turn) and spends one of the work's
budget; one without is skipped. Two merges in a row that render nothing new end the loop for want of progress; a chunk
that comes when the budget is spent ends it too. What comes after the end is ignored. Every transition is a row of the progress log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: A work of which less is rendered carries a caveat; merges in a row without progress that end the loop.
EXTENT, STALLED = 0.3, 2
LOG = ["work", "seq", "event", "left", "budget"]


def progress(chunks: DataFrame, order: list[str], budget: int) -> DataFrame:
    """work, seq, event, left, budget of every chunk(work, toc_index, toc: array<int>) that counts: merged, repeated, skipped, stalled or spent.

    `order` orders a work's chunks without ties. `left` are the places not rendered yet, `budget` what is left of it. A work has some
    hundred chunks, so a work is one window; works are dealt out by hash.
    """
    by_work = Window.partitionBy("work").orderBy("__seq")
    so_far, before = by_work.rowsBetween(Window.unboundedPreceding, 0), by_work.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("__seq", F.row_number().over(Window.partitionBy("work").orderBy(*order)))
    merged = F.col("toc_index").isNotNull()
    first = merged & F.array_contains("toc", F.col("toc_index")) & (F.row_number().over(Window.partitionBy("work", "toc_index").orderBy("__seq")) == 1)
    rows = rows.withColumn("__fresh", F.coalesce(first, F.lit(False))).withColumn("__merges", F.count_if(merged).over(so_far))
    # merges since the last fresh one
    rows = rows.withColumn("__idle", F.col("__merges") - F.coalesce(F.max(F.when(F.col("__fresh"), F.col("__merges"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("__spent", F.coalesce(F.count_if(merged).over(before), F.lit(0)) >= budget)
    spent = F.col("__spent")
    stalled = merged & (F.col("__idle") >= STALLED)
    rows = rows.withColumn("event", F.when(spent, "spent").when(stalled, "stalled").when(~merged, "skipped").when(F.col("__fresh"), "merged").otherwise("repeated"))
    ended = F.coalesce(F.count_if(F.col("event").isin("spent", "stalled")).over(before), F.lit(0))
    left = F.size("toc") - F.count_if(F.col("__fresh") & ~spent).over(so_far)
    rows = rows.withColumns({"__ended": ended, "left": left.cast("long"), "budget": F.greatest(F.lit(0), F.lit(budget) - F.col("__merges")).cast("long")})
    return rows.filter("__ended = 0").select("work", F.col("__seq").cast("long").alias("seq"), "event", "left", "budget")


def outcomes(log: DataFrame, extents: DataFrame) -> DataFrame:
    """work, state, left, review, caveat: how each work stands after its log. extents: work, rendered, total (pages)."""
    last = log.groupBy("work").agg(F.max_by("event", "seq").alias("event"), F.min("left").alias("left"))
    state = F.when(F.col("event") == "spent", "dispatch_budget_exceeded").when(F.col("event") == "stalled", "no_progress").when(F.col("left") == 0, "complete").otherwise("open")
    thin = (F.col("total") > 0) & (F.col("rendered") > 0) & (F.col("rendered") / F.col("total") < EXTENT)
    return last.join(extents, "work", "left").select("work", state.alias("state"), "left", F.col("event").isin("spent", "stalled").alias("review"), F.coalesce(thin, F.lit(False)).alias("caveat"))


class Continuation(StatefulProcessor):
    """For transformWithStateInPandas: the places of each work that were rendered, its merges and idle merges, and whether it has ended. Emits the log."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rendered = handle.getListState("rendered", "place int")
        self.counts = handle.getValueState("counts", "seq long, merges long, idle long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rendered = {r[0] for r in self.rendered.get()}
        seq, merges, idle, ended = self.counts.get() if self.counts.exists() else (0, 0, 0, False)
        out = []
        chunks = sorted((o, i, list(t)) for df in rows for o, i, t in zip(df["at"], df["toc_index"].astype("object").where(df["toc_index"].notna(), -1), df["toc"], strict=True))
        for _, place, toc in chunks:
            if ended:
                break
            seq, place = seq + 1, int(place)
            if merges >= self.budget:
                event, ended = "spent", True
            elif place < 0:
                event = "skipped"
            else:
                merges += 1
                fresh = place in toc and place not in rendered
                idle = 0 if fresh else idle + 1
                if fresh:
                    rendered.add(place)
                ended = idle >= STALLED
                event = "stalled" if ended else "merged" if fresh else "repeated"
            out.append((key[0], seq, event, len(toc) - len(rendered), max(0, self.budget - merges)))
        self.rendered.put([(p,) for p in sorted(rendered)]) if rendered else self.rendered.clear()
        self.counts.update((seq, merges, idle, ended))
        yield pd.DataFrame(out, columns=LOG)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(chunks: DataFrame, budget: int) -> DataFrame:
    """The log of a stream of chunks(work, at, toc_index, toc). Needs the RocksDB state store."""
    return chunks.groupBy("work").transformWithStateInPandas(Continuation(budget), "work long, seq long, event string, left long, budget long", "Append", "None")
