"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.fixed_values import INSTRUCTION_FORMATS, NA_TOKENS
from kappaloom.functions.ids import CONDITION, experiment_id, parse_experiment_ids
from kappaloom.functions.text import ECHO_END, instruction, model_answer
from kappaloom.operators import consistency, reports, resume, rules, sampling, scoring
from kappaloom.operators.annotate import Backend, annotate
from kappaloom.operators.cleaning import clean_items, label_vocabulary
from kappaloom.operators.conditions import Grid, expand, with_runs
from kappaloom.operators.dedup import annotate_distinct, distinct_texts
from kappaloom.operators.extract import STAGES, extract_distinct, extract_labels, stage_audit
from kappaloom.operators.label_tables import extract_with_table
from kappaloom.operators.prompts import (
    ITEM_CLOSE, ITEM_OPEN, build_prompts, distinct_templates, example_blocks, prompt_templates, prompts_by_condition,
    systems_table,
)
from kappaloom.operators.retry import annotate_in_rounds
from kappaloom.operators.rules import Rule
from kappaloom.plans.experiment import Experiment, codebooks, run_experiment
from kappaloom.plans.predictors import BusyPredictor, LexiconPredictor
from kappaloom.session import materialize, scratch_path
from kappaloom.sources import results
from kappaloom.sources.items import read_items_csv, read_table_items
from kappaloom.streaming.incremental import annotate_stream_once, answer_table, stream_items

LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
DOC_DATASETS = ("north", "south")
DATASETS = (*DOC_DATASETS, "chat")
SEED = 42
N_RUNS = 5
BASIC = Rule(0, 4)

SYSTEMS = {
    "north": (
        "North Archive",
        "The archive keeps short and long prose in four European languages.",
        "The archive sorts its prose by language:\n"
        "  • English – texts of the English desk\n  • French – texts of the French desk\n"
        "  • German – texts of the German desk\n  • Spanish – texts of the Spanish desk",
    ),
    "south": (
        "South Archive",
        "The archive keeps prose of mixed origin in four European languages.",
        "The archive sorts its prose by language and has one desk for each of English, "
        "French, German and Spanish.",
    ),
    "chat": (
        "Help Desk",
        "The help desk keeps the turns of conversations between people and an assistant.",
        "A turn is written by one of these:\n  • User – asks\n  • Assistant – answers\n"
        "  • System – sets the rules",
    ),
}


# ---------------------------------------------------------------- inputs


def mapped(c, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(c == key, name).otherwise(out)
    return out


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items: gold = language, dataset by the number of the source."""
    number = F.substring("source", 4, 10).cast("int")
    return read_table_items(
        spark, f"{sf}/documents.parquet",
        dataset=F.when(number % 2 == 0, "north").otherwise("south"),
        item_id=F.col("doc_id"), text=F.col("text"), gold=mapped(F.col("lang"), LANGUAGES),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as items: gold = role."""
    return read_table_items(
        spark, f"{sf}/conversations.parquet", dataset=F.lit("chat"),
        item_id=F.col("conv_id") * (1 << 20) + F.col("turn"),
        text=F.col("text"), gold=mapped(F.col("role"), ROLES),
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).unionByName(turns(spark, sf))


def untidy(items: DataFrame) -> DataFrame:
    """The items as a careless export would hold them: padded, blank and NA cells."""
    t, g = F.pmod("item_id", F.lit(11)), F.pmod("item_id", F.lit(7))
    return items.select(
        "dataset", "item_id",
        F.when(t == 0, "").when(t == 1, "NA").when(t == 2, "  ")
        .otherwise(F.concat(F.lit("  "), "text", F.lit("\t  "))).alias("text"),
        F.when(g == 0, "null").when(g == 1, "  ")
        .otherwise(F.concat(F.lit(" "), "gold", F.lit("\n"))).alias("gold"),
    )


def grid(n_runs: int = 1, datasets=DOC_DATASETS, models=rules.RULE_MODELS) -> Grid:
    return Grid(datasets=tuple(datasets), models=tuple(models), n_runs=n_runs)


def with_exp_id(df: DataFrame, g: Grid) -> DataFrame:
    """Attach the experiment id late, by the small condition number."""
    ids = g.table(df.sparkSession).select("cond_id", experiment_id().alias("exp_id"))
    return df.join(ids, "cond_id").drop("cond_id")


def basic_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rules.predict_one(documents(spark, sf), BASIC, ["dataset", "item_id", "gold"])


# ---------------------------------------------------------------- items and sampling


def q_clean_items(spark, sf):
    kept = clean_items(untidy(corpus(spark, sf)), NA_TOKENS)
    return kept.select(
        "dataset", "item_id", "gold", F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("chars"),
    )


def q_label_vocabulary(spark, sf):
    return label_vocabulary(corpus(spark, sf)).withColumn("label_ord", F.col("label_ord").cast("long"))


def pool_of(items: DataFrame) -> DataFrame:
    return materialize(sampling.stratified_pool(items, 2, SEED), "pool")


def q_stratified_pool(spark, sf):
    return pool_of(corpus(spark, sf)).withColumn(
        "rank_in_label", F.col("rank_in_label").cast("long"))


def q_stratified_pool_large(spark, sf):
    """A pool of more rows than any planner limit: the same plan as a small one."""
    pool = sampling.stratified_pool(corpus(spark, sf), 5000, SEED)
    return pool.withColumn("rank_in_label", F.col("rank_in_label").cast("long"))


def q_test_split(spark, sf):
    items = corpus(spark, sf).select("dataset", "item_id", "gold")
    return sampling.test_split(items, pool_of(items))


def q_uniform_sample(spark, sf):
    items = corpus(spark, sf).select("dataset", "item_id", "gold")
    return sampling.uniform_sample(items, 100, SEED)


def q_round_robin_examples(spark, sf):
    pool = pool_of(corpus(spark, sf))
    return (
        sampling.round_robin_examples(pool, 3).withColumn("wanted", F.lit(3))
        .unionByName(sampling.round_robin_examples(pool, 50).withColumn("wanted", F.lit(50)))
        .withColumn("pos", F.col("pos").cast("long"))
    )


# ---------------------------------------------------------------- grid and ids


def q_condition_grid(spark, sf):
    g = grid(datasets=DATASETS)
    return with_exp_id(expand(
        corpus(spark, sf).select("dataset", "item_id"),
        g.table(spark).select("dataset", "cond_id"),
    ), g)


def q_condition_filter(spark, sf):
    g = grid(datasets=DATASETS).restrict(
        datasets=["chat", "south"], models=["rare"], shot_types=["few_shot", "zero_shot"],
        lengths=["long"], context_levels=["no_context", "full_context"],
    )
    return with_exp_id(expand(
        corpus(spark, sf).select("dataset", "item_id"),
        g.table(spark).select("dataset", "cond_id"),
    ), g)


def q_experiment_ids(spark, sf):
    """Run ids and how many items each run covers; counted before the grid is laid over them."""
    sizes = corpus(spark, sf).groupBy("dataset").agg(F.count("*").alias("items"))
    runs = with_runs(grid(datasets=DATASETS).table(spark), 3)
    return expand(sizes, runs).select("exp_id", "run_id", "items")


def q_parse_experiment_ids(spark, sf):
    """Ids built from documents and their ratings; unrated documents give short ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang")
    rated = spark.read.parquet(f"{sf}/labels.parquet")
    ids = docs.join(rated, "doc_id", "left").select(
        F.concat_ws(
            "__", "source", "lang", F.concat(F.lit("q"), F.col("quality").cast("string")),
            F.concat(F.lit("t"), F.col("toxic").cast("string")), F.lit("whole"),
            F.when(F.col("toxic") == 1, F.lit("run0")),
        ).alias("exp_id")
    )
    return parse_experiment_ids(ids).groupBy(*CONDITION).agg(F.count("*").alias("ids"))


# ---------------------------------------------------------------- prompts


def templates_of(spark, items: DataFrame, g: Grid) -> DataFrame:
    pool = pool_of(items)
    blocks = materialize(example_blocks(items, pool), "blocks")
    conditions = with_runs(g.table(spark), g.n_runs)
    table = prompt_templates(
        conditions, systems_table(spark, SYSTEMS), label_vocabulary(items), blocks
    )
    return materialize(table, "templates")


def q_example_blocks(spark, sf):
    items = corpus(spark, sf)
    return example_blocks(items, pool_of(items)).select(
        "dataset", "shot_type", F.md5("compact_block").alias("compact_md5"),
        F.md5("numbered_block").alias("numbered_md5"),
    )


def q_build_prompts(spark, sf):
    items = corpus(spark, sf)
    prompts = build_prompts(items, templates_of(spark, items, grid(1, DATASETS, ["common"])))
    return prompts.select(
        "item_id", "exp_id", F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("long").alias("chars"),
    )


def q_prompts_by_condition(spark, sf):
    items = corpus(spark, sf)
    templates = templates_of(spark, items, grid(1, DATASETS, ["common"]))
    return prompts_by_condition(items, templates).select(
        "dataset", "item_id", F.size("prompts").cast("long").alias("conditions"),
        F.md5(F.concat_ws("\n", F.map_keys("prompts"))).alias("keys_md5"),
        F.md5(F.col("prompts")["few_shot|long|full_context"]).alias("longest_md5"),
    )


def q_prompt_dedup_counts(spark, sf):
    """Prompts asked and distinct prompts, from distinct texts and distinct templates."""
    items = corpus(spark, sf)
    templates = distinct_templates(templates_of(spark, items, grid(1, DATASETS, ["common"])))
    per_dataset = templates.groupBy("dataset").agg(
        F.count("*").alias("conditions"), F.countDistinct("template_id").alias("distinct_templates")
    )
    texts = distinct_texts(items).groupBy("dataset").agg(
        F.sum("copies").alias("items"), F.count("*").alias("distinct_texts")
    )
    return texts.join(per_dataset, "dataset").select(
        "dataset", (F.col("items") * F.col("conditions")).alias("prompts"),
        (F.col("distinct_texts") * F.col("distinct_templates")).alias("distinct_prompts"),
    )


def q_prompt_dedup(spark, sf):
    """All 27 conditions answered for every document, each distinct prompt asked once."""
    g = grid(1, DOC_DATASETS, ["common"])
    items = documents(spark, sf)
    templates = distinct_templates(templates_of(spark, items, g))
    backend = Backend.batched(lambda: LexiconPredictor(BASIC), batch_size=64)

    def ask(texts, wording=None):
        return annotate(texts, {"common": backend}, ["text_key", "template_id", "run_idx"], wording=wording)

    answers = annotate_distinct(items, templates, ask, by_text=True)
    return with_exp_id(answers.select("cond_id", "item_id", "raw"), g)


# ---------------------------------------------------------------- annotation


def q_annotate_rules(spark, sf):
    g = grid()
    return with_exp_id(
        rules.predict_grid(documents(spark, sf), g).select("cond_id", "item_id", "gold", "pred"), g)


def q_annotate_runs(spark, sf):
    g = grid(N_RUNS)
    rows = rules.predict_grid(documents(spark, sf), g)
    return with_exp_id(rows.select("cond_id", "run_idx", "item_id", "pred"), g).withColumn(
        "run_idx", F.col("run_idx").cast("long"))


def q_annotate_batch(spark, sf):
    """All 27 conditions and both models over every document, a request for each distinct prompt."""
    items = documents(spark, sf)
    g = grid(1)
    templates = distinct_templates(templates_of(spark, items, g))
    backends = {
        "common": Backend.batched(lambda: LexiconPredictor(BASIC), batch_size=64, in_flight=4),
        "rare": Backend.batched(
            lambda: LexiconPredictor(Rule(4, 4, 1), "[INST] echo [/INST] {label}"), batch_size=64, in_flight=4,
            wrapper=INSTRUCTION_FORMATS["mistral"], echo_end=ECHO_END,
        ),
    }

    def ask(texts, wording=None):
        return annotate(texts, backends, ["text_key", "template_id", "run_idx"], wording=wording)

    answers = annotate_distinct(items, templates, ask, by_text=True)
    return with_exp_id(answers.select("cond_id", "item_id", "raw", F.col("attempts").cast("long").alias("attempts")), g)


def q_annotate_retry(spark, sf):
    """Requests that fail as often as the labels say: toxic documents for good, poor ones twice."""
    rated = ratings(spark, sf).groupBy(F.col("doc_id").alias("item_id")).agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    fails = F.when(F.col("toxic") == 1, 9).when(F.col("quality") == 0, 2).otherwise(0)
    docs = documents(spark, sf).join(rated, "item_id", "left").select(
        "item_id", F.lit(0).alias("run_idx"), F.explode(F.array(F.lit("common"), F.lit("rare"))).alias("model"),
        F.concat(fails.cast("string"), F.lit("|"), F.lit(ITEM_OPEN), "text", F.lit(ITEM_CLOSE)).alias("prompt"))
    busy = partial(BusyPredictor, BASIC)
    backends = {"common": Backend(busy, backoff_base=0.0), "rare": Backend(busy, max_attempts=2, backoff_base=0.0)}
    found = annotate_in_rounds(materialize(docs, "prompts"), backends, ["item_id"], scratch_path(spark, "rounds"))
    return found.select("model", "item_id", "raw", F.col("attempts").cast("long").alias("attempts"), "error")


def q_model_responses(spark, sf):
    """Wrapped instruction, echoed by the model, reduced to the answer again."""
    head, tail = INSTRUCTION_FORMATS["llama2"]
    wrapped = instruction(F.col("text"), (head.replace("{system}", "Answer briefly."), tail))
    blank = F.pmod("item_id", F.lit(5)) == 0
    answer = F.when(blank, F.lit("  \n")).otherwise(F.concat(F.lit("\n "), "gold", F.lit(" ")))
    return documents(spark, sf).select(
        "item_id", F.md5(wrapped).alias("wrapped_md5"),
        model_answer(F.concat(wrapped, answer), ECHO_END).alias("answer"),
    )


# ---------------------------------------------------------------- extraction


def raw_answers(spark, sf) -> DataFrame:
    """Basic predictions dressed up in eight styles of model answer."""
    docs = rules.predict_one(
        documents(spark, sf), BASIC, ["dataset", "item_id", "gold", "text"]
    )
    p = F.col("pred")
    style = F.pmod("item_id", F.lit(8))
    raw = (
        F.when(style == 0, p)
        .when(style == 1, F.concat(F.lit("  "), F.upper(p), F.lit("\n")))
        .when(style == 2, F.concat(F.lit('"'), p, F.lit('".')))
        .when(style == 3, F.concat(F.lit('The text "'), "text", F.lit('" is '), p, F.lit(" prose.")))
        .when(style == 4, F.concat(p, F.lit("_text")))
        .when(style == 5, F.concat(p, F.lit("s")))
        .when(style == 6, F.col("text"))
        .otherwise(F.lit("  \t "))
    )
    return docs.select("dataset", "item_id", "gold", raw.alias("raw"))


def extracted(spark, sf, stages) -> DataFrame:
    return extract_labels(raw_answers(spark, sf), rules.LABELS, stages=stages).drop("raw")


def q_extract(*stages):
    def query(spark, sf):
        return extracted(spark, sf, stages).select("item_id", "pred", "stage")
    return query


def q_extract_large_vocabulary(spark, sf):
    """Parts named in a sentence, read with a vocabulary of all kinds of part there are."""
    kind = F.concat_ws(" ", "p_type", "p_name")
    items = spark.read.parquet(f"{sf}/part.parquet").select(
        F.lit("parts").alias("dataset"), F.col("p_partkey").alias("item_id"), kind.alias("gold"))
    books = codebooks(materialize(label_vocabulary(items), "vocabulary"))
    raw = F.concat(F.lit("It must be the "), F.lower("gold"), F.lit(", I think."))
    return extract_labels(items.withColumn("raw", raw), books).select("item_id", "pred", "stage")


def kinds_of_part(spark, sf) -> DataFrame:
    """Every part with a name of its own as its label: as many labels as parts."""
    kind = F.concat_ws(" ", "p_name", F.lit("no"), "p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.lit("parts").alias("dataset"), F.col("p_partkey").alias("item_id"), kind.alias("gold"))


def part_answers(spark, sf) -> DataFrame:
    """Parts named in six ways: as they are, joined up, in a sentence, as one token, misspelt, not at all."""
    p = F.col("gold")
    style = F.pmod("item_id", F.lit(6))
    raw = (
        F.when(style == 0, F.upper(p))
        .when(style == 1, F.concat(F.lit("'"), F.replace(p, F.lit(" "), F.lit("-")), F.lit("'.")))
        .when(style == 2, F.concat(F.lit("It must be the "), p, F.lit(", I think.")))
        .when(style == 3, F.concat(F.lit("see_"), F.replace(p, F.lit(" "), F.lit("")), F.lit("_there")))
        .when(style == 4, F.concat(F.lit("t"), p))
        .otherwise(F.lit(" ")))
    return kinds_of_part(spark, sf).withColumn("raw", raw)


def q_extract_part(*stages):
    """A vocabulary as large as the table, read by joins and an index of signatures."""
    def query(spark, sf):
        vocabulary = materialize(label_vocabulary(kinds_of_part(spark, sf)), "vocabulary")
        return extract_with_table(part_answers(spark, sf), vocabulary, stages=stages).select("item_id", "pred", "stage")
    return query


def q_extract_by_table(spark, sf):
    """The answers of ``extract_label`` with the labels as a table."""
    vocabulary = documents(spark, sf).select("dataset").distinct().select(
        "dataset", F.posexplode(F.array(*map(F.lit, rules.LABELS))).alias("label_ord", "label"))
    answers = materialize(raw_answers(spark, sf), "raw_answers")
    return extract_with_table(answers, materialize(vocabulary, "vocabulary")).select("item_id", "pred", "stage")


def q_extract_stage_audit(spark, sf):
    return stage_audit(extracted(spark, sf, ("exact", "scan", "token", "fuzzy")), ["dataset"])


def q_extract_codebooks(spark, sf):
    """Turns and documents in one pass, each dataset read with its own labels."""
    items = corpus(spark, sf)
    raw = F.concat(F.lit("It is of kind: "), F.lower("gold"), F.lit("!"))
    books = {d: rules.LABELS for d in DOC_DATASETS} | {"chat": sorted(ROLES.values())}
    return extract_labels(items.withColumn("raw", raw), books).select(
        "dataset", "item_id", "pred", "stage")


# ---------------------------------------------------------------- scoring


def ratings(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def q_align_predictions(spark, sf):
    """Language predictions meet the quality ratings of the documents that have one."""
    rated = ratings(spark, sf).select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("gold"))
    preds = basic_predictions(spark, sf).select("item_id", "pred")
    return scoring.align(rated, preds, ["item_id"])


def q_alignment_audit(spark, sf):
    docs = documents(spark, sf).select("item_id", "gold")
    rated = ratings(spark, sf).select(F.col("doc_id").alias("item_id"), F.lit("x").alias("pred"))
    return scoring.alignment_audit(docs, rated, ["item_id"])


def rounded6(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def q_confusion_counts(spark, sf):
    g = grid()
    return with_exp_id(
        scoring.confusion_counts(rules.predict_grid(documents(spark, sf), g), ["cond_id"]), g)


def q_agreement_metrics(spark, sf):
    g = grid()
    metrics = scoring.agreement_metrics(rules.predict_grid(documents(spark, sf), g), ["cond_id"])
    return rounded6(with_exp_id(metrics, g), scoring.METRICS)


def q_agreement_basic(spark, sf):
    """Flagship: how well does the rule annotator agree with the gold labels?"""
    metrics = scoring.agreement_metrics(basic_predictions(spark, sf), ["dataset"])
    return rounded6(metrics, scoring.METRICS)


def q_per_label_accuracy(spark, sf):
    return rounded6(
        scoring.per_label_accuracy(basic_predictions(spark, sf), ["dataset"]), ["accuracy"])


def q_rater_agreement(spark, sf):
    raters = ratings(spark, sf).join(
        documents(spark, sf).select("dataset", F.col("item_id").alias("doc_id")), "doc_id"
    ).select(
        "dataset", F.col("quality").cast("string").alias("first"),
        (1 - F.col("toxic")).cast("string").alias("second"))
    return rounded6(
        scoring.rater_agreement(raters, "first", "second", ["dataset"]), ["accuracy", "kappa"])


def stored_patterns(spark, sf, g: Grid) -> DataFrame:
    """Patterns as they come from a table with one row per item and run."""
    preds = rules.predict_grid(documents(spark, sf), g)
    return materialize(consistency.rating_patterns(preds, ["cond_id"]), "patterns")


def full_patterns(spark, sf, g: Grid) -> DataFrame:
    return materialize(rules.predict_patterns(documents(spark, sf), g), "patterns")


def q_run_metrics(spark, sf):
    g = grid(N_RUNS)
    per_run = consistency.run_metrics(stored_patterns(spark, sf, g), ["cond_id"])
    return rounded6(with_exp_id(per_run, g), scoring.METRICS).withColumn(
        "run_idx", F.col("run_idx").cast("long"))


def q_run_consistency(spark, sf):
    g = grid(N_RUNS)
    per_run = consistency.run_metrics(full_patterns(spark, sf, g), ["cond_id"])
    rows = with_exp_id(consistency.kappa_consistency(per_run, ["cond_id"]), g)
    return rows.select(
        "exp_id", F.round("mean_kappa", 6).alias("mean_kappa"),
        F.round("std_kappa", 6).alias("std_kappa"),
        *[F.round(F.col("kappas_per_run")[r], 6).alias(f"kappa_run{r}") for r in range(N_RUNS)],
    )


def q_undefined_consistency(spark, sf):
    """Runs that agree wholly on one label have no kappa; then mean and SD have no value either."""
    g = grid(N_RUNS, models=["common"])
    preds = rules.predict_grid(documents(spark, sf), g)
    agreed = F.when(F.col("run_idx") > 2, F.col("gold")).otherwise(F.col("pred"))
    by_kind = preds.withColumn("pred", agreed).withColumn("kind", F.col("gold"))
    both = by_kind.unionByName(by_kind.withColumn("kind", F.lit("all")))
    per_run = scoring.agreement_metrics(both, ["kind", "run_idx"])
    return consistency.kappa_consistency(per_run, ["kind"]).select(
        "kind", F.round("mean_kappa", 6).alias("mean_kappa"), F.round("std_kappa", 6).alias("std_kappa"))


def q_label_codes(spark, sf):
    g = grid(N_RUNS)
    codes = consistency.label_codes(stored_patterns(spark, sf, g), ["cond_id"])
    return with_exp_id(codes, g).withColumn("code", F.col("code").cast("long"))


def q_icc_two_way(spark, sf):
    g = grid(N_RUNS)
    icc = consistency.icc_two_way(full_patterns(spark, sf, g), ["cond_id"])
    return with_exp_id(icc, g).select("exp_id", "runs", F.round("icc", 6).alias("icc"))


def q_best_run(spark, sf):
    g = grid(N_RUNS)
    best = consistency.best_run(
        consistency.run_metrics(full_patterns(spark, sf, g), ["cond_id"])
        .withColumn("kappa", F.round("kappa", 9)), ["cond_id"])
    return rounded6(with_exp_id(best, g), scoring.METRICS).withColumn(
        "best_run_idx", F.col("best_run_idx").cast("long"))


def summaries(spark, sf, g: Grid) -> DataFrame:
    """exp_id, the five condition columns and the nested summary."""
    rows = consistency.summary_from_patterns(full_patterns(spark, sf, g), ["cond_id"])
    conditions = g.table(spark).withColumn("exp_id", experiment_id())
    return conditions.join(rows, "cond_id").drop("cond_id")


def q_condition_summary(spark, sf):
    rows = consistency.metrics_table(summaries(spark, sf, grid(N_RUNS)))
    return rounded6(
        rows.select("exp_id", *SUMMARY_METRICS), SUMMARY_METRICS)


def q_merged_summary(spark, sf):
    """The summary from the pattern counts of three portions of the items, added up."""
    g = grid(N_RUNS)
    preds = materialize(rules.predict_grid(documents(spark, sf), g), "predictions")
    parts = [consistency.rating_patterns(preds.where(F.pmod("item_id", F.lit(3)) == k), ["cond_id"], marked=True)
             for k in range(3)]
    merged = consistency.merge_patterns(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["cond_id"])
    rows = consistency.summary_from_patterns(materialize(merged, "merged"), ["cond_id"])
    conditions = g.table(spark).withColumn("exp_id", experiment_id())
    flat = consistency.metrics_table(conditions.join(rows, "cond_id").drop("cond_id"))
    return rounded6(flat.select("exp_id", *SUMMARY_METRICS), SUMMARY_METRICS)


SUMMARY_METRICS = [*scoring.METRICS, "mean_kappa", "std_kappa", "icc"]

# ---------------------------------------------------------------- reports

# The third model is configured but never run: its cells must show up as missing.
LAYOUT = reports.Layout(
    datasets=DOC_DATASETS, models=(*rules.RULE_MODELS, "remote"),
    names={
        **reports.Layout().names, "north": "North Archive", "south": "South Archive",
        "common": "Common words", "rare": "Rare words", "remote": "Remote model",
    },
)


def metrics_rows(spark, sf) -> DataFrame:
    """The flat metrics of the full grid, written once like the files a report reads.

    Rounded so that a tie between conditions is a tie in every engine.
    """
    flat = consistency.metrics_table(summaries(spark, sf, grid(N_RUNS)))
    return materialize(
        flat.select(*CONDITION, *[F.round(c, 9).alias(c) for c in SUMMARY_METRICS]), "metrics")


def q_report(build):
    def query(spark, sf):
        return build(metrics_rows(spark, sf), LAYOUT)
    return query


def q_report_any_layout(spark, sf):
    """A layout that lists other datasets and models than were measured loses none of them."""
    return reports.full_metrics(metrics_rows(spark, sf), reports.PUBLISHED)


# ---------------------------------------------------------------- resume


def open_items(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Items with their open runs, and the runs, after an interruption.

    The first model is done, of the second the rated documents; toxic documents stand for
    failed requests.
    """
    g = grid(N_RUNS)
    runs = with_runs(g.table(spark), N_RUNS).withColumn("run_no", resume.run_number(N_RUNS))
    items = documents(spark, sf).select("dataset", "item_id")
    rated = ratings(spark, sf).select(F.col("doc_id").alias("item_id"), "toxic")
    rows = expand(items, runs.select("dataset", "model", "run_no")).join(rated, "item_id", "left")
    failed = (F.col("model") == "rare") & (F.col("toxic") == 1)
    saved = rows.where((F.col("model") == "common") | F.col("toxic").isNotNull()).select(
        "dataset", "item_id", "run_no", F.when(failed, "timeout").alias("error"))
    return resume.open_runs(items, runs, saved), runs.select("run_no", "run_id")


def q_skip_done(spark, sf):
    still, runs = open_items(spark, sf)
    return resume.unfinished_runs(still).join(runs, "run_no").select("run_id")


def q_resume_items(spark, sf):
    still, runs = open_items(spark, sf)
    return resume.open_rows(still).join(F.broadcast(runs), "run_no").select("run_id", "item_id")


def q_resumed_experiment(spark, sf):
    """The whole grid, both models: an experiment that ended after one of three portions, and went on."""
    items = documents(spark, sf)
    out = scratch_path(spark, "experiment")
    g = grid(1)
    backends = {m: Backend.batched(lambda: LexiconPredictor(BASIC), batch_size=64) for m in rules.RULE_MODELS}
    for portions in (1, None):
        run_experiment(items, Experiment(g, SYSTEMS, backends, steps=3, max_portions=portions), out)
    return results.read_predictions(spark, f"{out}/predictions").groupBy("dataset", "item_id").agg(
        F.count("*").alias("answers"), F.max("pred").alias("pred"))


# ---------------------------------------------------------------- round trips and streaming


def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "items_csv")
    untidy(documents(spark, sf)).select(
        F.col("text").alias("Requirement Statement"), F.col("gold").alias("Label")
    ).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return clean_items(read_items_csv(spark, path, "docs")).select(
        "dataset", "item_id", "gold", F.md5("text").alias("text_md5"))


def prediction_rows(spark, sf, n_runs=N_RUNS) -> DataFrame:
    """Extracted answers of the whole grid in the shape of the prediction table."""
    g = grid(n_runs)
    preds = rules.predict_grid(documents(spark, sf), g)
    raw = preds.withColumn("raw", F.concat(F.lit("Label: "), F.col("pred"))).drop("pred")
    return (
        extract_distinct(materialize(raw, "raw_answers"), rules.LABELS, stages=("exact", "scan", "token"))
        .join(F.broadcast(with_runs(g.table(spark), n_runs).drop("exp_id")), ["cond_id", "dataset", "run_idx"])
        .withColumn("attempts", F.lit(1))
        .withColumn("error", F.lit(None).cast("string"))
    )


def q_prediction_table(spark, sf):
    """Appends of different runs to one partitioned table, read back with a filter."""
    path = scratch_path(spark, "predictions")
    rows = prediction_rows(spark, sf)
    for first in (True, False):
        results.append_predictions(rows.where((F.col("run_idx") == 0) == F.lit(first)), path)
    return results.read_predictions(spark, path).where(F.col("shot_type") == "one_shot").select(
        "run_id", "item_id", "gold", "raw", "pred", "stage")


def q_compacted_predictions(spark, sf):
    """Three appends of portions of the items, merged into one generation, read back whole."""
    path = scratch_path(spark, "predictions")
    rows = prediction_rows(spark, sf, 1).withColumn("portion", F.pmod("item_id", F.lit(3)).cast("int"))
    dealt = scratch_path(spark, "portions")
    rows.write.partitionBy("portion").parquet(dealt)
    saved = spark.read.schema(rows.schema).parquet(dealt)
    for portion in range(3):
        results.append_predictions(saved.where(F.col("portion") == portion), path)
    results.compact_predictions(spark, path)
    return results.read_predictions(spark, path).select("run_id", "item_id", "gold", "raw", "pred")


def q_run_json_roundtrip(spark, sf):
    path = scratch_path(spark, "run_records")
    rows = prediction_rows(spark, sf)
    results.write_records(results.run_records(rows), path)
    return results.read_run_records(spark, path).select("run_id", "item_id", "gold", "raw", "pred")


def q_metrics_json_roundtrip(spark, sf):
    path = scratch_path(spark, "summaries")
    results.write_summaries(summaries(spark, sf, grid(N_RUNS)), path)
    return rounded6(results.read_metrics(spark, path), SUMMARY_METRICS)


def q_report_csv(spark, sf):
    path = scratch_path(spark, "report")
    report = reports.full_metrics(metrics_rows(spark, sf), LAYOUT)
    results.write_report_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def streamed(spark, sf) -> str:
    """Where the rows and answers of a stream lie: documents come in two portions, copies of texts in both."""
    inbox, out, checkpoint = (
        scratch_path(spark, n) for n in ("inbox", "annotated", "stream_checkpoint"))
    docs = documents(spark, sf)
    templates = materialize(distinct_templates(templates_of(spark, docs, grid(1))), "stream_templates")
    backends = {m: Backend.batched(lambda: LexiconPredictor(BASIC), batch_size=64) for m in rules.RULE_MODELS}
    for portion in (0, 1):
        docs.where(F.pmod("item_id", F.lit(2)) == portion).write.mode("append").parquet(inbox)
        annotate_stream_once(
            stream_items(spark, inbox), templates, backends,
            lambda rows: extract_distinct(materialize(rows, "stream_rows"), rules.LABELS), out, checkpoint)
    return out


def q_stream_annotate(spark, sf):
    """All 27 conditions and both models over documents that arrive as files."""
    return spark.read.parquet(f"{streamed(spark, sf)}/rows").select(
        "dataset", "item_id", "exp_id", "gold", "raw", "pred", "stage")


def q_stream_requests(spark, sf):
    """What such a stream asked: every distinct prompt once, also of texts that came again later."""
    answers = answer_table(spark, f"{streamed(spark, sf)}/answers")
    return answers.groupBy(F.substring_index("text_key", ":", 1).alias("dataset")).agg(F.count("*").alias("requests"))


def q_run_elapsed(spark, sf):
    """Seconds of each run, from the requests' seconds by way of run records."""
    path = scratch_path(spark, "run_records")
    rows = prediction_rows(spark, sf).withColumn("seconds", F.pmod("item_id", F.lit(7)) * 0.25)
    results.write_records(results.run_records(rows, 100), path)
    return results.run_seconds(spark, path)


QUERIES = {
    "clean_items": q_clean_items,
    "label_vocabulary": q_label_vocabulary,
    "stratified_pool": q_stratified_pool,
    "stratified_pool_large": q_stratified_pool_large,
    "test_split": q_test_split,
    "uniform_sample": q_uniform_sample,
    "round_robin_examples": q_round_robin_examples,
    "condition_grid": q_condition_grid,
    "condition_filter": q_condition_filter,
    "experiment_ids": q_experiment_ids,
    "parse_experiment_ids": q_parse_experiment_ids,
    "example_blocks": q_example_blocks,
    "build_prompts": q_build_prompts,
    "prompts_by_condition": q_prompts_by_condition,
    "prompt_dedup_counts": q_prompt_dedup_counts,
    "prompt_dedup": q_prompt_dedup,
    "annotate_rules": q_annotate_rules,
    "annotate_runs": q_annotate_runs,
    "annotate_batch": q_annotate_batch,
    "annotate_retry": q_annotate_retry,
    "model_responses": q_model_responses,
    "extract_exact": q_extract("exact"),
    "extract_scan": q_extract("scan"),
    "extract_token": q_extract("token"),
    "extract_fuzzy": q_extract("fuzzy"),
    "extract_label": q_extract("exact", "scan", "token", "fuzzy"),
    "extract_codebooks": q_extract_codebooks,
    "extract_large_vocabulary": q_extract_large_vocabulary,
    "extract_by_table": q_extract_by_table,
    "extract_part_table": q_extract_part("exact", "scan", "token"),
    "extract_part_fuzzy": q_extract_part(*STAGES),
    "extract_stage_audit": q_extract_stage_audit,
    "align_predictions": q_align_predictions,
    "alignment_audit": q_alignment_audit,
    "confusion_counts": q_confusion_counts,
    "agreement_basic": q_agreement_basic,
    "agreement_metrics": q_agreement_metrics,
    "per_label_accuracy": q_per_label_accuracy,
    "rater_agreement": q_rater_agreement,
    "run_metrics": q_run_metrics,
    "run_consistency": q_run_consistency,
    "undefined_consistency": q_undefined_consistency,
    "label_codes": q_label_codes,
    "icc_two_way": q_icc_two_way,
    "best_run": q_best_run,
    "condition_summary": q_condition_summary,
    "merged_summary": q_merged_summary,
    "report_by_shot": q_report(reports.kappa_by_shot),
    "report_by_length": q_report(reports.kappa_by_length),
    "report_consistency": q_report(reports.consistency_report),
    "report_by_context": q_report(reports.kappa_by_context),
    "report_full_metrics": q_report(reports.full_metrics),
    "report_full_metrics_best": q_report(reports.full_metrics_best_condition),
    "report_any_layout": q_report_any_layout,
    "report_best": q_report(reports.best_conditions),
    "report_shot_comparison": q_report(reports.shot_comparison),
    "report_shot_by_length": q_report(reports.shot_by_length),
    "skip_done": q_skip_done,
    "resume_items": q_resume_items,
    "resumed_experiment": q_resumed_experiment,
    "csv_roundtrip": q_csv_roundtrip,
    "prediction_table": q_prediction_table,
    "compacted_predictions": q_compacted_predictions,
    "run_json_roundtrip": q_run_json_roundtrip,
    "metrics_json_roundtrip": q_metrics_json_roundtrip,
    "report_csv": q_report_csv,
    "run_elapsed": q_run_elapsed,
    "stream_annotate": q_stream_annotate,
    "stream_requests": q_stream_requests,
}
