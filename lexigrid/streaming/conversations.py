"""Conversation memory over a stream of turns; the batch result of operators.memory on the same turns."""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexigrid.operators.memory import MAX_SUMMARY_CHARS, RECENT_TURNS, Memory

OUTPUT = "conv_id long, turn long, summary string, recent array<struct<role:string,text:string>>"


class MemoryProcessor(StatefulProcessor):
    """Keeps summary and recent turns of each conversation. Turns of one micro-batch are taken in the order of `turn`."""

    def __init__(self, recent_turns: int, summarize: Callable | None, compress: Callable | None, max_summary_chars: int) -> None:
        self.knobs = {"recent_turns": recent_turns, "summarize": summarize, "compress": compress, "max_summary_chars": max_summary_chars}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "summary string, recent string, turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory, last = Memory(**self.knobs), -1
        if self.state.exists():
            summary, recent, last = self.state.get()
            memory.summary, memory.recent = summary, [tuple(x) for x in json.loads(recent)]
        turns = pd.concat(list(rows)).sort_values("turn")
        for row in turns.itertuples():
            memory.add(row.role, row.text)
            last = max(last, row.turn)
        self.state.update((memory.summary, json.dumps(memory.recent), int(last)))
        recent = [{"role": r, "text": t} for r, t in memory.recent]
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [last], "summary": [memory.summary], "recent": [recent]})

    def close(self) -> None:
        pass


def stream_memory(
    turns: DataFrame, recent_turns: int = RECENT_TURNS, summarize: Callable | None = None, compress: Callable | None = None, max_summary_chars: int = MAX_SUMMARY_CHARS
) -> DataFrame:
    """turns: a stream of (conv_id, turn, role, text) -> each conversation's memory whenever turns of it arrive.

    The session needs the RocksDB state store provider."""
    return (
        turns.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id")
        .transformWithStateInPandas(statefulProcessor=MemoryProcessor(recent_turns, summarize, compress, max_summary_chars), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
    )
