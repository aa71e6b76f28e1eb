"""Texts travel once, whatever is asked about them; what fans out is neither read again nor shuffled."""

from functools import partial

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators import joins
from kappaloom.operators.annotate import Backend, TransientError, Wording, annotate
from kappaloom.operators.dedup import annotate_distinct
from kappaloom.operators.prompts import distinct_templates
from kappaloom.plans import queries
from kappaloom.session import materialize
from kappaloom.streaming.incremental import annotate_stream_once, answer_table, remembering, stream_items

KEYS = ["text_key", "template_id", "run_idx"]


class Shout:
    def predict(self, prompt, run_idx):
        return f" {prompt.upper()}/{run_idx} "


class PickyBatch:
    def predict_batch(self, prompts, run_idxs):
        if any("bad" in p for p in prompts):
            raise TransientError("busy")
        return [p if "none" not in p else None for p in prompts]


BACKENDS = {
    "m": Backend(Shout, wrapper=("<", "[/INST]>"), in_flight=3),
    "n": Backend.batched(PickyBatch, 3, max_attempts=2, backoff_base=0.0),
}


def items_of(spark, n=40, twice=()):
    data = [("d" if i % 4 else "e", i, f" text {i % 9} " if i % 5 else None, f"g{i}") for i in [*range(n), *twice]]
    return spark.createDataFrame(data, "dataset string, item_id long, text string, gold string").repartition(3)


def templates_of(spark):
    data = [(d, m, c, r, f"{m}{c % 2}:", ":S") for d in "de" for m in "mnx" for c in range(3) for r in (0, 1)]
    return materialize(distinct_templates(spark.createDataFrame(
        data, "dataset string, model string, cond_id int, run_idx int, prefix string, suffix string")), "t")


def ask(prompts, wording=None, details=False):
    return annotate(prompts, BACKENDS, KEYS, details, wording=wording)


def test_texts_give_the_answers_that_prompts_give(spark, monkeypatch):
    """A wording too large for a broadcast is asked prompt by prompt; rows that come twice stay as they were."""
    from kappaloom.operators import dedup

    items, templates = items_of(spark, twice=(3, 8, 16)).where("text is not null"), templates_of(spark)
    want = rows(annotate_distinct(items, templates, ask))
    assert rows(annotate_distinct(items, templates, ask, by_text=True)) == want
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    assert rows(annotate_distinct(items, templates, ask, by_text=True)) == want


def test_a_text_without_value_fails_its_requests(spark):
    one = items_of(spark).where("item_id = 5")
    got = annotate_distinct(one, templates_of(spark), ask, by_text=True)
    assert got.count() == 12 and got.where("raw is null and error is not null and attempts = 1").count() == 12


def test_answers_of_texts_carry_details(spark):
    wording = Wording(templates_of(spark).schema, templates_of(spark).where("dataset = 'd' and model <> 'x'").collect())
    texts = spark.createDataFrame(
        [("a", "ok", [0, 1, 2]), ("b", "bad", list(range(12))), ("c", "x", []), ("d", "x", None)],
        "text_key string, text string, asks array<int>")
    got = ask(texts, wording, details=True)
    assert got.columns == ["text_key", "answers"] and got.count() == 4
    flat = got.select("text_key", F.inline("answers"))
    assert flat.columns == [*KEYS, "raw", "attempts", "error", "transient", "seconds"]
    assert flat.where("text_key = 'b' and transient and attempts = 2").count() == 6
    assert flat.where("text_key = 'a'").count() == 3 and flat.where("seconds < 0 or seconds is null").count() == 0


@pytest.mark.parametrize("name", ["annotate_batch", "prompt_dedup", "stream_requests"])
def test_queries_send_each_text_once(spark, sf_dir, monkeypatch, name):
    from kappaloom.streaming import incremental

    sent = []

    def watched(prompts, *args, real=annotate, **options):
        sent.append(prompts.count())
        return real(prompts, *args, **options)

    monkeypatch.setattr(queries, "annotate", watched)
    monkeypatch.setattr(incremental, "annotate", watched)
    queries.QUERIES[name](spark, sf_dir).collect()
    docs = queries.documents(spark, sf_dir)
    assert 0 < sum(sent) <= docs.count()


def test_stream_reads_distinct_answers_only(spark, sf_dir, monkeypatch):
    from kappaloom.operators import extract

    read = []

    def watched(df, *args, real=extract.extract_labels, **options):
        read.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(extract, "extract_labels", watched)
    monkeypatch.setattr(queries, "extract_labels", watched)
    queries.q_stream_annotate(spark, sf_dir)
    assert read and max(read) <= 2 * 5  # datasets, labels and no answer


def test_rows_of_a_stream_are_not_shuffled(spark, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    plans = []

    def read(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    items_of(spark, twice=(3, 8)).where("text is not null").write.parquet(inbox)
    templates = templates_of(spark).where("model <> 'x'").withColumn("exp_id", F.col("cond_id").cast("string"))
    annotate_stream_once(stream_items(spark, inbox), templates, BACKENDS, read, out, check)
    above, fan_out, _ = plans[0].partition("Generate inline")
    assert fan_out and "Exchange hashpartitioning" not in above
    # Two rows of an item meet each other: as a join with the items after the fan-out would have it.
    got = spark.read.parquet(f"{out}/rows")
    assert got.where("item_id = 3 and gold = 'g3'").count() == 8 * 12
    assert got.where("item_id = 2 and gold = 'g2'").count() == 12


def test_memory_of_a_stream_by_text(spark, tmp_path):
    """Known questions are taken off before texts are moved; failed ones are asked again; a batch that runs again asks nothing."""
    rows_of = templates_of(spark).where("dataset = 'd' and model = 'm' and cond_id < 2").collect()
    wording = Wording(templates_of(spark).schema, rows_of)
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "text_key string, text string")
    asked = []

    def answers(fail, prompts, wording):
        asked.append(rows(prompts.select("text_key", F.array_sort("asks"))))
        bad = F.col("text_key") == "b" if fail else F.lit(False)
        found = lambda at: F.struct(
            *[F.get(F.array(*[F.lit(r[k]) for r in rows_of]), at).alias(k) for k in ("template_id", "run_idx")],
            F.when(~bad, "yes").alias("raw"), F.lit(1).alias("attempts"), F.when(bad, "down").alias("error"))
        return prompts.select("text_key", F.transform("asks", found).alias("answers"))

    def batch(number, fail):
        memory = remembering(partial(answers, fail), str(tmp_path / "answers"), number)
        left = memory.unanswered(texts, wording)
        everything = F.array(*[F.lit(i) for i in range(4)])
        asks = everything if "answered" not in left.columns else F.array_except(
            everything, F.coalesce("answered", F.array().cast("array<int>")))
        return rows(memory(left.withColumn("asks", asks), wording).select("text_key", F.size("answers")))

    assert batch(0, True) == [("a", 4), ("b", 4)]
    again = batch(1, False)
    assert sum(n for k, n in again if k == "a") == sum(n for k, n in again if k == "b") == 4
    assert batch(1, False) == again
    assert asked == [[("a", [0, 1, 2, 3]), ("b", [0, 1, 2, 3])], [("a", []), ("b", [0, 1, 2, 3])]]
    assert answer_table(spark, str(tmp_path / "answers")).count() == 12


def test_skew_join_with_sizes_keeps_all_rows_of_a_key(spark):
    facts = spark.createDataFrame([(i, f"k{i % 3}") for i in range(30)], "item_id long, key string")
    sizes = spark.createDataFrame([(f"k{i}", 10) for i in range(3)], "key string, copies long")
    answers = spark.createDataFrame([(f"k{i % 3}", i) for i in range(6)], "key string, answer long")
    got = joins.skew_join(facts, answers, "key", "copies", 30, "item_id", sizes=sizes)
    assert rows(got) == rows(facts.join(answers, "key"))
