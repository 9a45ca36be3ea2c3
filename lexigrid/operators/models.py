"""Models that are passed in: loaded when they are first needed, on the device at hand, and done without where they can't be had."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lexigrid.operators.prompts import system_prompt


class Lazy:
    """load() is called once, when the model is first asked for; that it failed is remembered too."""

    def __init__(self, load: Callable[[], Callable]) -> None:
        self._load = load
        self._model: Callable | None = None
        self._available: bool | None = None

    @property
    def available(self) -> bool:
        if self._available is None:
            try:
                self._model = self._load()
            except Exception:  # whatever a library raises where it or its model is missing
                self._model = None
            self._available = self._model is not None
        return self._available

    def __call__(self, *args):
        """What the model says; None where there is none, or where it fails."""
        if not self.available:
            return None
        try:
            return self._model(*args)
        except Exception:
            return None


def first_of(*loads: Callable[[], Callable]) -> Callable[[], Callable]:
    """load() of the first of several libraries that can be had, in their order; fails with the last one's error if none can."""

    def load() -> Callable:
        for k, one in enumerate(loads, 1):
            try:
                return one()
            except Exception:
                if k == len(loads):
                    raise
        raise ImportError("no library is named")

    return load


def has_cuda() -> bool:
    try:
        import torch

        return bool(torch.cuda.is_available())
    except Exception:
        return False


def pick_device(asked: str = "auto", cuda: Callable[[], bool] = has_cuda) -> str:
    """The first CUDA device for "cuda", and for "auto" where there is one, else the CPU; any other name is taken as it is."""
    if asked == "cuda" or asked == "auto" and cuda():
        return "cuda:0"
    return "cpu" if asked == "auto" else asked


def reranker(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """For hybrid.rerank: scores by a model of questions and texts, loaded once a task. Without the model, or where it fails, scores are
    null, and the fused order holds."""

    @F.pandas_udf(DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = Lazy(load)
        for questions, texts in batches:
            found = model(questions.tolist(), [t or "" for t in texts])
            yield pd.Series([None] * len(texts) if found is None else [float(x) for x in found], dtype="float64")

    return lambda question, text: scores(question, text)


@dataclass(frozen=True)
class Sampling:
    """How a chat model draws its answer; it does not draw at temperature 0."""

    max_new_tokens: int = 512
    temperature: float = 0.2
    top_p: float = 0.85
    repetition_penalty: float = 1.05


def chat_model(load: Callable[[], Callable[[str, str, Sampling], str]], system: str | None = None, sampling: Sampling = Sampling()) -> Callable[[Column], Column]:
    """For flows.answer: a column function of the prompt; the model gets the system prompt, the prompt and the sampling. It is loaded once
    a task, and a null prompt isn't asked. Without the model answers are null."""
    rules = system_prompt() if system is None else system

    @F.pandas_udf(StringType())
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Lazy(load)
        for prompts in batches:
            yield pd.Series([None if p is None else model(rules, p, sampling) for p in prompts], dtype=object)

    return lambda prompt: said(prompt)
