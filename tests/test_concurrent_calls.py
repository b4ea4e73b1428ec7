"""Model calls in flight: overlap, order, retries and conservation."""

import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import annotate as ann


class Slow:
    """Answers after a while; refuses prompts with "bad", and prompts with "once" the first two times."""

    def __init__(self):
        self.now, self.most, self.seen, self.lock = 0, 0, {}, threading.Lock()

    def begin(self, batch):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)

    def end(self, batch):
        with self.lock:
            self.now -= 1
            for p in batch:
                self.seen[p] = self.seen.get(p, 0) + 1
        if any("bad" in p or "once" in p and self.seen[p] < 3 for p in batch):
            raise RuntimeError("refused")
        return [p.upper() for p in batch]

    def ask(self, batch):
        self.begin(batch)
        time.sleep(0.03)
        return self.end(batch)


class SlowAsync(Slow):
    ask = None

    async def ask_async(self, batch):
        self.begin(batch)
        await asyncio.sleep(0.03)
        return self.end(batch)


PROMPTS = [None if i == 7 else f"bad {i}" if i % 11 == 3 else f"once {i}" if i % 13 == 5 else f"p {i}" for i in range(64)]


@pytest.mark.parametrize("kind", [Slow, SlowAsync])
def test_calls_overlap_within_the_bound_and_equal_the_serial_ones(kind):
    want = ann._ask_all(Slow(), PROMPTS, 4, 3)
    model = kind()
    assert ann._ask_all_concurrent(model, PROMPTS, 4, 3, 5, 0.01) == want
    assert 1 < model.most <= 5
    assert sum(a is not None for a in want[0]) + sum(e is not None for e in want[1]) == len(PROMPTS)


def test_waiting_is_shared():
    began = time.time()
    ann._ask_all_concurrent(SlowAsync(), [f"p {i}" for i in range(40)], 1, 1, 20, 0.0)
    assert time.time() - began < 40 * 0.03 / 2


def test_annotate_concurrently_conserves_rows(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PROMPTS)], "doc_id long, input string").repartition(3)
    rows = {n: ann.materialize(ann.annotate(df, "{input}", "answer", Slow, batch_size=4, in_flight=n)) for n in (1, 6)}
    good, bad = ann.split_rejects(rows[6], "answer")
    assert good.count() + bad.count() == len(PROMPTS)
    kept = lambda d: sorted((r["doc_id"], r["answer"]) for r in d.where(F.col("answer").isNotNull()).collect())
    assert kept(rows[1]) == kept(rows[6])
    with pytest.raises(ValueError):
        ann.annotate(df, "{input}", "answer", Slow, in_flight=0)
