"""The scoring job: items + responses -> per-answer details and per-cell summaries.

One lazy DataFrame for the whole run grid; the cell (model, split, shot) is a grouping key,
not a process.  Boundaries: the J1 join shuffle, the partial/final aggregates, the Arrow
boundary of the literal-tuple parser and of the LCS UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TASKS, task_catalog, with_task_type
from ..functions.metrics import exact_sum, precision_recall_f1, safe_div
from ..functions.text import py_strip
from ..operators.extract import extract_text, listed_names, with_parsed_tuples
from ..operators.pairing import pair, repeated_sides, token_count
from ..operators.score_exact import match_flag
from ..operators.score_text import with_text_scores
from ..operators.score_tuples import positional_counts, set_counts
from ..schemas import METRICS, TUPLES
from .report import split_sizes

CELL = ["model", "split", "shot"]


OPEN_TUPLE_TYPES = ("open_triple", "open_tuple")


def _by_type(parsed: Column, tt: Column) -> Column:
    """E7 by task type: triples keep 3-part tuples, tuples keep all; null for other types."""
    return _let(F.struct(parsed.alias("v"), tt.alias("t")), lambda x: F.when(
        x["t"] == "open_triple", F.filter(x["v"], lambda t: F.size(t) == 3)).when(x["t"] == "open_tuple", x["v"]))


TUPLE_SPLITS = [t[0] for t in TASKS if t[1] in OPEN_TUPLE_TYPES]
TEXT_SPLITS = [t[0] for t in TASKS if t[1] == "open_text"]


def _parse_gold(items: DataFrame, mode: str) -> DataFrame:
    """``items`` of tuple tasks, with ``task_type``, and their ``ref_tuples``; in corrected mode the names that questions list stay as ``_names``."""
    names = F.col("_names") if mode == "corrected" else None
    it = items.withColumn("_names", listed_names(F.col("question"))) if mode == "corrected" else items
    it = with_parsed_tuples(it, F.col("answer"), "_ref_parsed", mode, names)
    return it.withColumn("ref_tuples", _by_type(F.col("_ref_parsed"), F.col("task_type"))).drop("_ref_parsed")


def with_gold(spark: SparkSession, items: DataFrame, mode: str = "reference") -> DataFrame:
    """``items`` with ``ref_tuples``, which ``extract`` in the same ``mode`` then takes as they are: stored once, items that meet
    several runs or batches are parsed once for all of them."""
    is_tuple = F.col("split").isin(TUPLE_SPLITS)
    parsed = _parse_gold(with_task_type(items.where(is_tuple), task_catalog(spark)), mode).select(*items.columns, "ref_tuples")
    return parsed.unionByName(items.where(~is_tuple | F.col("split").isNull()).withColumn("ref_tuples", F.lit(None).cast(TUPLES)))


def extract(spark: SparkSession, items: DataFrame, responses: DataFrame, mode: str = "reference",
            families: tuple[bool, ...] = (False, True), repeated: set[tuple[str, str]] | None = None, by_cell: bool = False) -> DataFrame:
    """J1 + E1-E9 + M1 + P8: one row per paired response with typed prediction and gold.

    Two branches by task family, chosen by split before any join: only the open-tuple branch holds the
    Python step of the tuple parser, and its gold tuples are parsed once per item, not once per response (E9).
    ``families``: which branches to build, the one of open tuples (True) or of all other tasks (False).
    ``repeated``: see ``pairing.pair``; one look serves all branches.  ``by_cell``: pairs are dealt out by cell, for ``sinks.write_details``,
    before their texts are parsed: a parsed list of tuples takes several times the space of its text.
    """
    repeated = repeated_sides(items, responses) if repeated is None else repeated
    is_tuple = F.col("split").isin(TUPLE_SPLITS)
    branches = []
    for tuples in families:
        side = is_tuple if tuples else (~is_tuple | F.col("split").isNull())
        it = with_task_type(items.where(side), task_catalog(spark))
        if tuples:
            names = F.col("_names") if mode == "corrected" else None
            if "ref_tuples" not in items.columns:
                it = _parse_gold(it, mode)
            elif mode == "corrected":
                it = it.withColumn("_names", listed_names(F.col("question")))
        mine = {x for x in repeated if (x[1] in TUPLE_SPLITS) == tuples}
        df = pair(it, responses.where(side), mine)
        df = (df.hint("rebalance", *CELL) if by_cell else df).withColumn("response", py_strip(F.coalesce(F.col("text"), F.lit(""))))
        tt = F.col("task_type")
        none = F.lit(None).cast(TUPLES)
        if tuples:
            df = with_parsed_tuples(df, F.col("response"), "_pred_parsed", mode, names)
        branches.append(df.select(
            *CELL, "identifier", "ord", "task_type", "question", "options", "answer", "response",
            extract_text(F.col("response"), tt, mode, F.col("options")).alias("pred_text"),
            (_by_type(F.col("_pred_parsed"), tt) if tuples else none).alias("pred_tuples"),
            (F.col("ref_tuples") if tuples else none).alias("ref_tuples"),
            F.col("cumulative_logprob").alias("log_probability"),
            token_count().alias("token_count"),
        ).withColumn("match", match_flag(F.col("pred_text"), F.col("answer"), F.col("task_type"), mode)))
    return reduce(DataFrame.unionByName, branches)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a one-element ``transform``.

    Keeps the optimizer from copying an expensive producer (the regex tuple parser) into every
    consumer expression when projections are collapsed.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def score_rows(extracted: DataFrame, stem: bool = False, text: bool = True) -> DataFrame:
    """Per-row score parts for every task family of an extracted table, so that one aggregate produces the summary."""
    tt = F.col("task_type")

    def counts(x):
        p, r = x["p"], x["r"]
        by_set, by_place = set_counts(p, r), positional_counts(p, r)
        return F.struct(*[F.when(x["t"] == "open_triple", o).otherwise(s).alias(n)
                          for n, s, o in zip(("tp", "fp", "fn"), by_set, by_place)])

    is_text = F.col("split").isin(TEXT_SPLITS)
    c = _let(F.struct(F.col("pred_tuples").alias("p"), F.col("ref_tuples").alias("r"), tt.alias("t")), counts)
    counted = extracted.where(~is_text | F.col("split").isNull()).withColumn("_c", F.when(tt.isin(*OPEN_TUPLE_TYPES), c))
    counted = counted.select("*", *[F.col("_c." + k).alias(k) for k in ("tp", "fp", "fn")]).drop("_c")
    if not text:
        return counted
    scored = with_text_scores(extracted.where(is_text), F.col("pred_text"), F.col("answer"), stem=stem)
    return counted.unionByName(scored, allowMissingColumns=True)


def summarize(spark: SparkSession, extracted: DataFrame, items: DataFrame, dataset: str = "local",
              prompt_root: str = "./prompt", stem: bool = True) -> DataFrame:
    """One wide summary row per cell; metric columns are null unless they apply to the task type.

    ROUGE tokens are stemmed, as in the reference; ``stem=False`` gives the values that SQL can check.

    One partial+final aggregate over the scored rows (BIGINT sums and means), joined to the
    per-split item counts (a tiny aggregate) for accuracy's denominator.
    """
    return _summary(score_rows(extracted, stem=stem), items, dataset, prompt_root)


def score_run(spark: SparkSession, items: DataFrame, responses: DataFrame, mode: str = "reference", stem: bool = True,
              repeated: set[tuple[str, str]] | None = None) -> DataFrame:
    """Per-row score parts from items and responses: open text is a branch of its own from the start, chosen by split, so that
    only its rows reach the Python step of the text scores and each Python step is in the plan once."""
    is_text = F.col("split").isin(TEXT_SPLITS)
    repeated = repeated_sides(items, responses) if repeated is None else repeated
    texts = {x for x in repeated if x[1] in TEXT_SPLITS}
    rest = score_rows(extract(spark, items, responses.where(~is_text), mode, repeated=repeated - texts), text=False)
    open_text = extract(spark, items.where(is_text), responses.where(is_text), mode, (False,), texts)
    text = with_text_scores(open_text, F.col("pred_text"), F.col("answer"), stem=stem)
    return rest.unionByName(text, allowMissingColumns=True)


def summarize_run(spark: SparkSession, items: DataFrame, responses: DataFrame, mode: str = "reference", dataset: str = "local",
                  prompt_root: str = "./prompt", stem: bool = True) -> DataFrame:
    """M11 from items and responses."""
    return _summary(score_run(spark, items, responses, mode, stem), items, dataset, prompt_root)


_WHOLE, _TEXT = ["correct", "tp", "fp", "fn", "n_text"], ["bleu", "rouge1", "rouge2", "rougeL"]
COUNTS = ("model string, split string, shot string, task_type string, " + ", ".join(f"{c} long" for c in _WHOLE) + ", "
          + ", ".join(f"{c}_sum decimal(38,18)" for c in _TEXT))


def cell_counts(scored: DataFrame) -> DataFrame:
    """The sums of each cell (``COUNTS``), all exact: whole numbers, and text scores (0 to 1) as decimals of 18 places, so that
    no result depends on the order in which rows or partial sums meet."""
    # task_type depends on split only: grouping by it keeps the aggregate buffer fixed-width (hash aggregate)
    return scored.groupBy(*CELL, "task_type").agg(
        F.sum(F.col("match").cast("bigint")).alias("correct"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("bleu").alias("n_text"),
        *[exact_sum(c).cast("decimal(38,18)").alias(c + "_sum") for c in _TEXT])


def merge_counts(counts: DataFrame) -> DataFrame:
    """One row for each cell from any number of partial ones."""
    return counts.groupBy(*CELL, "task_type").agg(
        *[F.sum(c).alias(c) for c in _WHOLE], *[F.sum(c + "_sum").cast("decimal(38,18)").alias(c + "_sum") for c in _TEXT])


def _summary(scored: DataFrame, items: DataFrame, dataset: str, prompt_root: str) -> DataFrame:
    return summary_of_counts(cell_counts(scored), split_sizes(items), dataset, prompt_root)


def summary_of_counts(counts: DataFrame, sizes: DataFrame, dataset: str, prompt_root: str) -> DataFrame:
    j = counts.join(sizes, "split", "left")
    tt = F.col("task_type")
    closed, tuples, text = tt.isin("mc", "bool"), tt.isin(*OPEN_TUPLE_TYPES), tt == "open_text"
    prec, rec, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    metric = {
        "accuracy": F.when(closed, safe_div(F.col("correct"), F.coalesce(F.col("n_items"), F.lit(0)))),
        "precision": F.when(tuples, prec), "recall": F.when(tuples, rec), "f1": F.when(tuples, f1),
        **{c: F.when(text, safe_div(F.col(c + "_sum"), F.col("n_text"))) for c in _TEXT},
    }
    return j.select(
        F.lit(dataset).alias("dataset"), "split", "model",
        F.concat(F.lit(prompt_root + "/bench_"), F.col("split"), F.lit("/"), F.col("shot"), F.lit(".txt")).alias("prompt_path"),
        "shot", "task_type",
        *[metric[c].cast("double").alias(c) for c in METRICS],
    )
