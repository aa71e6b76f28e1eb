"""Rule annotator: stop-word and accent evidence, a deterministic stand-in for a model.

Every text is scanned once, in place. The whole condition grid is then scored on a
short count vector; neither the tokens nor the texts are exploded or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kappaloom.functions.ids import CONDITION
from kappaloom.operators.conditions import Grid
from kappaloom.operators.scoring import known
from kappaloom.session import literal_table

# Stop words in rank order, and letters typical of a language.
LEXICON = {
    "English": "the of and in is to that with".split(),
    "French": "le de la et que qui des les".split(),
    "German": "der die und zu in ist nicht ein".split(),
    "Spanish": "de la que el en los y con".split(),
}
ACCENTS = {"English": "", "French": "èêçœà", "German": "äöüß", "Spanish": "ñ¿¡íóú"}
LABELS = sorted(LEXICON)
RANKS = 8

# How a grid condition steers the annotator: lexicon size, evidence, accent weight, end of
# the rank list the words are taken from.
LEXICON_SIZE = {"zero_shot": 2, "one_shot": 4, "few_shot": 8}
ACCENT_WEIGHT = {"no_context": 0, "some_context": 1, "full_context": 3}
FIRST_RANK = {"common": lambda k: 0, "rare": lambda k: RANKS - k}
RULE_MODELS = tuple(FIRST_RANK)


@dataclass(frozen=True)
class Rule:
    """One setting: a window of ranks, cyclic, and the weight of an accented letter."""

    first_rank: int
    size: int
    accent_weight: int = 0

    @property
    def ranks(self) -> tuple[int, ...]:
        return tuple((self.first_rank + i) % RANKS for i in range(self.size))


def rule_of(model: str, shot_type: str, context_level: str, run_idx: int = 0) -> Rule:
    """Run r shifts the ranks by r, so repeated runs disagree in a repeatable way."""
    size = LEXICON_SIZE[shot_type]
    first = (FIRST_RANK[model](size) + run_idx) % RANKS
    return Rule(first, size, ACCENT_WEIGHT[context_level])


WORDS = sorted({w for ws in LEXICON.values() for w in ws})


def one_of(words: list[str]) -> str:
    """Regex for a list of words, grouped by first letter so that most places fail at once."""
    ends: dict[str, list[str]] = {}
    for word in words:
        ends.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in ends.items())


def evidence(items: DataFrame, keep: list[str], accents: bool = True) -> DataFrame:
    """``keep`` columns plus ``hits[label][rank]`` and ``accents[label]``.

    Lexicon words are found as whole runs of a-z letters by one regex over the text. The
    hits are sorted together with one copy of every word; the places of the copies then
    give all counts without another pass per word.
    """
    found = f"regexp_extract_all(lower(text), '(?<![a-z])(?:{one_of(WORDS)})(?![a-z])', 0)"
    copies = "array(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
    slots = ", ".join(
        "array(" + ", ".join(str(WORDS.index(w)) for w in LEXICON[l]) + ")" for l in LABELS
    )
    letters = ", ".join(
        f"bigint(regexp_count(lower(text), '[{ACCENTS[l]}]'))"
        if accents and ACCENTS[l] else "bigint(0)"
        for l in LABELS
    )
    return (
        items.select(
            *keep, F.expr(f"sort_array(concat({found}, {copies}))").alias("_found"),
            F.expr(f"array({letters})").alias("accents"),
        )
        # Lambdas keep the generated code small enough for the JVM to compile it.
        .withColumn("_places", F.expr(
            f"concat(transform({copies}, w -> array_position(_found, w)), "
            "array(bigint(size(_found) + 1)))"))
        .select(*keep, F.expr(
            f"transform(array({slots}), ids -> "
            "transform(ids, i -> _places[i + 1] - _places[i] - 1))").alias("hits"), "accents")
    )


# Sums of the first 0, 1, ... 16 values with the ranks taken round twice. The sum over any
# cyclic window of ranks is then one difference.
# All labels' sums form one flat array.
RUNNING_SUMS = (
    "flatten(transform({hits}, v -> aggregate(concat(v, v), array(bigint(0)), "
    "(sums, x) -> concat(sums, array(element_at(sums, -1) + x)))))"
)
SUMS_PER_LABEL = 2 * RANKS + 1


def weighted(evidence_rows: DataFrame) -> DataFrame:
    """Each item under the three readings of its hits, keyed by ``length``.

    short: is the word there at all; medium: how often; long: how many letters it covers.
    """
    letters = ", ".join(
        "array(" + ", ".join(f"{len(w)}" for w in LEXICON[l]) + ")" for l in LABELS
    )
    readings = {
        "short": "transform(hits, v -> transform(v, h -> least(h, bigint(1))))",
        "medium": "hits",
        "long": f"zip_with(hits, array({letters}), (v, n) -> zip_with(v, n, (h, m) -> h * m))",
    }
    pairs = ", ".join(
        f"named_struct('length', '{name}', 'sums', {RUNNING_SUMS.format(hits=hits)})"
        for name, hits in readings.items()
    )
    keep = [c for c in evidence_rows.columns if c != "hits"]
    return evidence_rows.select(*keep, F.expr(f"inline(array({pairs}))"))


def packed_best(scores: list[str]) -> str:
    """Highest score with its label packed into the lowest digit; the first label wins ties.

    One flat expression: comparing scores label by label would compute each of them
    again for every comparison.
    """
    n = len(LABELS)
    return "greatest(" + ", ".join(
        f"({s}) * {n} + {n - 1 - i}" for i, s in enumerate(scores)) + ")"


def label_code(best: str) -> str:
    """Which label a packed score names; -1 when nothing scored."""
    return f"int(if({best} < {len(LABELS)}, -1, {best} % {len(LABELS)}))"


def label_of(code: Column) -> Column:
    return F.get(F.array(*[F.lit(l) for l in reversed(LABELS)]), code)


def with_best(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Add ``pred``: label of the highest score, null when nothing scored."""
    return rows.withColumn("_best", F.expr(packed_best(scores))).withColumn(
        "pred", label_of(F.expr(label_code("_best"))))


def predict_one(items: DataFrame, rule: Rule, keep: list[str]) -> DataFrame:
    """``keep`` plus ``pred`` under a single rule, counting every hit."""
    scores = [
        " + ".join(f"hits[{i}][{r}]" for r in rule.ranks)
        + f" + accents[{i}] * {rule.accent_weight}"
        for i in range(len(LABELS))
    ]
    rows = evidence(items, keep, accents=rule.accent_weight > 0)
    return with_best(rows, scores).select(*keep, "pred")


RULE_SCHEMA = pa.schema([
    ("cond_id", pa.int32()), ("dataset", pa.string()), ("length", pa.string()),
    ("first_rank", pa.list_(pa.int32())), ("accent_weight", pa.int64()), ("size", pa.int32()),
])


def rule_table(spark: SparkSession, grid: Grid) -> DataFrame:
    """One literal row per condition: size of the window, its start in every run, accents."""
    at = {name: i + 1 for i, name in enumerate(CONDITION)}
    rows = []
    for row in grid.rows():
        by_run = [
            rule_of(row[at["model"]], row[at["shot_type"]], row[at["context_level"]], run)
            for run in range(grid.n_runs)
        ]
        rows.append((row[0], row[at["dataset"]], row[at["length"]],
                     [r.first_rank for r in by_run], by_run[0].accent_weight, by_run[0].size))
    return literal_table(spark, RULE_SCHEMA, rows)


def _item_conditions(items: DataFrame, grid: Grid) -> DataFrame:
    """One narrow row per item and condition, ready to be scored for any run.

    The literal rule table is joined by broadcast after the texts are gone. An item becomes hundreds
    of rows here, so the short evidence is dealt to all tasks first, by item: a scan may be few
    tasks, and whoever groups the rows by item finds them together.
    """
    rules = rule_table(items.sparkSession, grid)
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = evidence(items, ["dataset", "item_id", "gold"]).repartition(tasks, "dataset", "item_id")
    return weighted(found).join(rules, ["dataset", "length"])


def _run_scores(first_rank: str) -> list[str]:
    return [
        f"sums[{at} + {first_rank} + size] - sums[{at} + {first_rank}]"
        f" + accents[{i}] * accent_weight"
        for i in range(len(LABELS)) for at in (i * SUMS_PER_LABEL,)
    ]


def predict_grid(items: DataFrame, grid: Grid) -> DataFrame:
    """(cond_id, run_idx, dataset, item_id, gold, pred): one row per item, condition and run."""
    rows = _item_conditions(items, grid)
    one_run = rows.select(
        "cond_id", "dataset", "item_id", "gold", "sums", "accents", "accent_weight", "size",
        F.posexplode("first_rank").alias("run_idx", "first"),
    )
    return with_best(one_run, _run_scores("first")).select(
        "cond_id", "run_idx", "dataset", "item_id", "gold", "pred")


def predict_patterns(items: DataFrame, grid: Grid) -> DataFrame:
    """(cond_id, gold, ratings, n): how often each pattern of answers over the runs occurs.

    The same as counting the patterns of ``predict_grid``, but all runs of an item are
    scored in its row, so the only shuffle is that of the pattern counts.
    """
    best = packed_best(_run_scores("first"))
    codes = f"transform(transform(first_rank, first -> {best}), best -> {label_code('best')})"
    counted = _item_conditions(items, grid).select(
        "cond_id", "gold", F.expr(codes).alias("_codes")
    ).groupBy("cond_id", "gold", "_codes").agg(F.count("*").alias("n"))
    ratings = F.transform(
        "_codes",
        lambda code, run: F.struct(run.alias("run_idx"), known(label_of(code)).alias("pred")),
    )
    return counted.select("cond_id", "gold", ratings.alias("ratings"), "n")
