"""Retry rounds, requests in flight, and the seconds that requests take."""

import os
import threading
import time
from functools import partial

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators.annotate import Backend, TransientError, annotate, answer_batch
from kappaloom.operators.retry import annotate_in_rounds


class Busy:
    """Fails ``n`` times for a passing reason, where a prompt is n:text; logs each call."""

    attempt = 1

    def __init__(self, folder):
        self.folder = folder

    def predict(self, prompt, run_idx):
        with open(os.path.join(self.folder, "log"), "a") as f:
            f.write(f"{prompt}\n")
        n = int(prompt.split(":")[0])
        if n < 0:
            raise KeyError("never")
        if self.attempt <= n:
            raise TransientError("busy")
        return prompt.split(":")[1]


def prompts(spark, texts, models=("m",)):
    return spark.createDataFrame(
        [(i, m, t, 0) for i, t in enumerate(texts) for m in models], "item_id long, model string, prompt string, run_idx int")


def test_rounds_ask_only_what_failed(spark, tmp_path):
    waits = []
    df = prompts(spark, ["0:a", "1:b", "2:c", "9:d", "-1:e", "0:a"], models=("m", "n"))
    backends = {m: Backend(partial(Busy, str(tmp_path)), max_attempts=k, backoff_base=2.0) for m, k in (("m", 4), ("n", 2))}
    got = annotate_in_rounds(df, backends, ["item_id"], str(tmp_path / "rounds"), wait=waits.append)
    assert rows(got.select("model", "item_id", "raw", "attempts", "error")) == [
        ("m", 0, "a", 1, None), ("m", 1, "b", 2, None), ("m", 2, "c", 3, None), ("m", 3, None, 4, "TransientError: busy"),
        ("m", 4, None, 1, "KeyError: 'never'"), ("m", 5, "a", 1, None),
        ("n", 0, "a", 1, None), ("n", 1, "b", 2, None), ("n", 2, None, 2, "TransientError: busy"),
        ("n", 3, None, 2, "TransientError: busy"), ("n", 4, None, 1, "KeyError: 'never'"), ("n", 5, "a", 1, None)]
    assert waits == [1.0, 2.0, 4.0]
    assert len((tmp_path / "log").read_text().split()) == 12 + 6 + 2 + 1
    assert got.where("seconds is null or seconds < 0").count() == 0


def test_whole_rounds_are_not_asked_again(spark, tmp_path):
    df = prompts(spark, ["0:a", "1:b", "2:c"])
    backend = {"m": Backend(partial(Busy, str(tmp_path)), max_attempts=3)}

    def dies(seconds):
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        annotate_in_rounds(df, backend, ["item_id"], str(tmp_path / "rounds"), wait=dies)
    assert len((tmp_path / "log").read_text().split()) == 3
    got = annotate_in_rounds(df, backend, ["item_id"], str(tmp_path / "rounds"), wait=lambda s: None)
    assert rows(got.select("item_id", "raw", "attempts")) == [(0, "a", 1), (1, "b", 2), (2, "c", 3)]
    assert len((tmp_path / "log").read_text().split()) == 3 + 2 + 1


def test_nothing_to_ask(spark, tmp_path):
    got = annotate_in_rounds(prompts(spark, []), {"m": Backend(partial(Busy, str(tmp_path)))}, ["item_id"], str(tmp_path / "r"))
    assert got.count() == 0 and set(got.columns) >= {"item_id", "model", "raw", "attempts", "error", "seconds"}


class Slow:
    def __init__(self):
        self.now = self.most = 0
        self.lock = threading.Lock()

    def predict(self, prompt, run_idx):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.02)
        with self.lock:
            self.now -= 1
        return prompt.upper()

    def predict_batch(self, prompts, run_idxs):
        return [self.predict(p, r) for p, r in zip(prompts, run_idxs)]


@pytest.mark.parametrize("batch_size", [1, 3])
def test_requests_in_flight_are_bounded_and_answers_in_order(batch_size):
    texts = [f"t{i}" for i in range(30)]
    slow = Slow()
    answers = answer_batch(slow, Backend(Slow, batch_size=batch_size, in_flight=5), texts, [0] * 30)
    assert [a[0] for a in answers] == [t.upper() for t in texts]
    assert 2 <= slow.most <= 5
    alone = Slow()
    assert answer_batch(alone, Backend(Slow), texts[:4], [0] * 4)[3][0] == "T3" and alone.most == 1


def test_details(spark, tmp_path):
    df = prompts(spark, ["0:a", "9:b", "-1:c"])
    backend = {"m": Backend(partial(Busy, str(tmp_path)), max_attempts=1)}
    got = annotate(df, backend, ["item_id"], details=True)
    assert rows(got.select("item_id", "transient", F.col("seconds") >= 0)) == [(0, False, True), (1, True, True), (2, False, True)]
    assert annotate(df, backend, ["item_id"]).columns == ["item_id", "raw", "attempts", "error"]
