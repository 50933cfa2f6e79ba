"""Live sections of reports that are still being written, and progress of their stages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id string, position int, heading string, body string, status string"


def split_sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of the second-level sections."""
    parts = re.split(r"(?m)^(?=##[ \t])", text)
    return [(p.partition("\n")[0][2:].strip(), p.partition("\n")[2].strip()) for p in parts if p.startswith("##")]


def flushed(state: dict, at: float, text: str, final: bool, every: float) -> list[tuple[int, str, str, str]]:
    """What to send for a longer text: each section that another follows once, the last one from time to
    time as partial; at the end all as complete."""
    sections = split_sections(text)
    out = []
    if final:
        return [(i, h, b, "complete") for i, (h, b) in enumerate(sections, 1)]
    for i, (h, b) in enumerate(sections[:-1], 1):
        if i not in state["done"]:
            state["done"].append(i)
            out.append((i, h, b, "complete"))
    if sections and at - state["last"] >= every:
        state["last"] = at
        out.append((len(sections), *sections[-1], "partial"))
    return out


def streamed(chunks: DataFrame, every: float = 4.0) -> DataFrame:
    """Section events of a stream of text chunks (job_id, seq, at, chunk, final)."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"text": "", "done": [], "last": -1e18}
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            s["text"] += r.chunk or ""
            out += [(key[0], *x) for x in flushed(s, float(r.at), s["text"], bool(r.final), every)]
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["job_id", "position", "heading", "body", "status"])

    return chunks.groupBy("job_id").applyInPandasWithState(step, EVENTS, "s string", "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, stages: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """A running percentage of the stages seen by job, over batch or stream."""
    e = events.withWatermark("at", late) if events.isStreaming else events
    seen = F.size(F.collect_set(F.when(F.col("stage").isin(*stages), F.col("stage"))))
    return e.groupBy("job_id").agg(F.least(F.lit(95), F.floor(seen * 100 / (len(stages) + 3))).cast("int").alias("percent"), F.max("at").alias("at"))


def windowed(events: DataFrame, at: str, kind: str, size: str, late: str) -> DataFrame:
    """Counts by kind in tumbling windows, late rows within the watermark included."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
