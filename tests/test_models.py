from lexigrid.operators import models, prompts
from lexigrid.operators.models import Lazy
from pyspark.sql import functions as F


def test_lazy_loads_once():
    calls = []

    def load():
        calls.append(1)
        return lambda x: 1 / x

    model = Lazy(load)
    assert not calls and model(2) == 0.5 and model(4) == 0.25 and model(0) is None and model.available and len(calls) == 1

    def fails():
        calls.append(2)
        raise ImportError

    missing = Lazy(fails)
    assert missing(1) is None and missing(2) is None and not missing.available and calls == [1, 2]


def test_first_of():
    def missing():
        raise ImportError("this one")

    assert models.first_of(missing, lambda: len, lambda: max)()("ab") == 2
    for loads in ((missing,), ()):
        assert not Lazy(models.first_of(*loads)).available


def test_pick_device():
    assert models.pick_device("auto", lambda: True) == "cuda:0" and models.pick_device("auto", lambda: False) == "cpu"
    assert models.pick_device("cuda", lambda: False) == "cuda:0" and models.pick_device("mps") == "mps" and models.has_cuda() in (True, False)


def test_reranker(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", None)], "q string, t string")

    def broken():
        raise OSError

    score = models.reranker(lambda: lambda qs, ts: [len(t) for t in ts])
    assert [r.s for r in rows.select(score(F.col("q"), F.col("t")).alias("s")).collect()] == [2.0, 0.0]
    assert [r.s for r in rows.select(models.reranker(broken)(F.col("q"), F.col("t")).alias("s")).collect()] == [None, None]


def test_chat_model(spark):
    rows = spark.createDataFrame([("p1",), (None,)], "prompt string")
    say = models.chat_model(lambda: lambda system, prompt, sampling: f"{system}|{prompt}|{sampling.temperature}", "rules")
    assert [r.a for r in rows.select(say(F.col("prompt")).alias("a")).collect()] == ["rules|p1|0.2", None]
    assert prompts.REFUSAL in prompts.system_prompt() and "sổ tay" in prompts.system_prompt("sổ tay")
