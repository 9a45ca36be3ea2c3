"""Rolling conversation memory: the last pairs of turns word for word, older ones folded into a summary."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import strip
from lexigrid.operators.prompts import ASSISTANT, NO_HISTORY, USER

RECENT_TURNS, MAX_SUMMARY_CHARS = 2, 800
# The wordings that results must have.
ASKED, SUMMARY_NOTE, SUMMARY_HEAD, RECENT_HEAD = "- SV hỏi: ", "Tóm tắt hội thoại trước đó:\n", "[Tóm tắt các lượt trước]\n", "[Các lượt gần đây]\n"
ASKED_CHARS = 120
TURN = "struct<role:string,text:string>"


@dataclass
class Memory:
    """The state of one conversation, a turn at a time. summarize(summary, user text, assistant text or None) and compress(summary)
    are a model's; where they are missing or fail, a short note of the question is added, and a long summary stays."""

    recent_turns: int = RECENT_TURNS
    max_summary_chars: int = MAX_SUMMARY_CHARS
    summarize: Callable[[str, str, str | None], str] | None = None
    compress: Callable[[str], str] | None = None
    summary: str = ""
    recent: list[tuple[str, str]] = field(default_factory=list)

    def add(self, role: str, text: str | None) -> None:
        if role not in ("user", "assistant"):
            return
        self.recent.append((role, text or ""))
        if role == "assistant":
            self.roll()

    def roll(self) -> None:
        while len(self.recent) > 2 * self.recent_turns:
            _, asked = self.recent.pop(0)
            reply = self.recent.pop(0)[1] if self.recent and self.recent[0][0] == "assistant" else None
            note = (self.summary.strip() + "\n" + ASKED + asked.strip()[:ASKED_CHARS]).strip()
            self.summary = self._asked(note, self.summarize, self.summary.strip(), asked.strip(), reply.strip() if reply is not None else None)
        if len(self.summary) > self.max_summary_chars:
            self.summary = self._asked(self.summary, self.compress, self.summary)

    @staticmethod
    def _asked(otherwise: str, model: Callable | None, *args) -> str:
        try:
            return model(*args).strip() if model else otherwise
        except Exception:  # a model that fails costs its summary, not the conversation
            return otherwise

    def clear(self) -> None:
        self.summary, self.recent = "", []


def fold(turns: Column, recent_turns: int = RECENT_TURNS) -> Column:
    """struct(recent, summary) of an array of turns (role, text) in order, without a model: the same fold in higher-order functions."""
    state = F.struct(F.array().cast(f"array<{TURN}>").alias("recent"), F.lit("").alias("summary"))

    def pop(s: Column, _: Column) -> Column:
        asked = F.get(s["recent"], F.lit(0))["text"]
        pair = F.coalesce(F.get(s["recent"], F.lit(1))["role"] == "assistant", F.lit(False))
        note = strip(F.concat(strip(s["summary"]), F.lit("\n" + ASKED), F.substring(strip(asked), 1, ASKED_CHARS)))
        rest = F.slice(s["recent"], F.when(pair, F.lit(3)).otherwise(F.lit(2)), F.size(s["recent"]))
        return F.when(F.size(s["recent"]) > 2 * recent_turns, F.struct(rest.alias("recent"), note.alias("summary"))).otherwise(s)

    def step(s: Column, t: Column) -> Column:
        more = F.struct(F.array_append(s["recent"], t).alias("recent"), s["summary"].alias("summary"))
        rolled = F.aggregate(F.sequence(F.lit(0), F.size(s["recent"])), more, pop)
        return F.when(t["role"] == "assistant", rolled).otherwise(more)

    return F.aggregate(turns, state, step)


def conversation_memory(turns: DataFrame, recent_turns: int = RECENT_TURNS) -> DataFrame:
    """conv_id, summary, recent of turns (conv_id, turn, role, text); only user and assistant turns are remembered."""
    turn = F.when(F.col("role").isin("user", "assistant"), F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    memory = fold(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), recent_turns)
    return ordered.select("conv_id", memory.alias("m")).select("conv_id", "m.summary", "m.recent")


def prompt_history(memory: DataFrame) -> DataFrame:
    """conv_id, pos, role, text of the messages for the next prompt: a note with the summary, if there is one, then the recent turns."""
    note = F.struct(F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_NOTE), F.col("summary")).alias("text"))
    rows = F.when(F.col("summary") != "", F.concat(F.array(note), F.col("recent"))).otherwise(F.col("recent"))
    return memory.select("conv_id", F.posexplode(rows).alias("pos", "m")).select("conv_id", "pos", "m.role", "m.text")


def recent_text(recent: Column) -> Column:
    label = lambda t: F.when(t["role"] == "user", F.lit(USER)).otherwise(F.lit(ASSISTANT))
    lines = F.transform(F.filter(recent, lambda t: strip(t["text"]) != ""), lambda t: F.concat(label(t), strip(t["text"])))
    return F.when(F.size(lines) == 0, F.lit(NO_HISTORY)).otherwise(F.array_join(lines, "\n"))


def history_block(memory: DataFrame) -> DataFrame:
    """conv_id, history: summary and recent turns as one block."""
    recent = recent_text(F.col("recent"))
    old = F.when(strip(F.col("summary")) != "", F.concat(F.lit(SUMMARY_HEAD), strip(F.col("summary"))))
    new = F.when(recent != NO_HISTORY, F.concat(F.lit(RECENT_HEAD), recent))
    block = F.concat_ws("\n\n", old, new)
    return memory.select("conv_id", F.when(block == "", F.lit(NO_HISTORY)).otherwise(block).alias("history"))
