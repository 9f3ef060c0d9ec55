"""Scoring predictions against truth; what is undefined stays null, never 0."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS

KEYS = ("package_id", "page_number")
#: Pages that a message names, and mistakes that an evaluation lists; counts are always complete.
NAMED, LISTED = 50, 10_000

# The messages, in the order of the checks, which callers may match.
PROBLEMS = (
    "Duplicate page_number(s) in ground truth",
    "Duplicate page_number(s) in predictions",
    "Page(s) present in ground truth but missing from predictions",
    "Page(s) present in predictions but missing from ground truth",
    "Ground truth page(s) with an invalid doc_type",
    "Prediction page(s) with an invalid doc_type",
)


def misaligned(truth: DataFrame, predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(nr, package_id, page_number)``: the distinct pages that break each check, by its number in ``PROBLEMS``."""
    twice = lambda rows: rows.groupBy(*KEYS).count().where("count > 1")
    unknown = lambda rows: rows.where(~F.coalesce(F.col("doc_type").isin(*labels), F.lit(False)))
    bad = (twice(truth), twice(predictions), truth.join(predictions, list(KEYS), "left_anti"), predictions.join(truth, list(KEYS), "left_anti"), unknown(truth), unknown(predictions))
    parts = [rows.select(F.lit(nr).alias("nr"), *KEYS).distinct() for nr, rows in enumerate(bad)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def check_aligned(truth: DataFrame, predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> None:
    """Raises ValueError unless both name the same pages once each, with known labels: by the first check that fails."""
    first = misaligned(truth, predictions, labels).orderBy("nr", *KEYS).limit(NAMED).collect()
    if first:
        found = [r for r in first if r.nr == first[0].nr]
        several = len({r.package_id for r in found}) > 1
        raise ValueError(f"{PROBLEMS[first[0].nr]}: {[(r.package_id, r.page_number) if several else r.page_number for r in found]}")


def aligned(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(package_id, page_number, actual, predicted)``."""
    left = truth.select(*KEYS, F.col("doc_type").alias("actual"))
    return left.join(predictions.select(*KEYS, F.col("doc_type").alias("predicted")), list(KEYS))


def label_table(spark, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(label, nr)``: a handful of rows."""
    return spark.createDataFrame([(label, i) for i, label in enumerate(labels)], "label string, nr int")


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(actual, predicted, n)`` for all pairs of labels, zeros too."""
    cells = pairs.sparkSession.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    counted = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return cells.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Support, predictions, hits, precision, recall and F1 of each label."""
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("actual") == F.col("predicted")).cast("int").alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("h")),
    )).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("a").alias("support"), F.sum("p").alias("predicted_count"), F.sum("h").alias("true_positives"))
    rows = label_table(pairs.sparkSession, labels).join(sums, "label", "left").select("label", "nr", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted_count", "true_positives")))
    precision, recall = F.try_divide("true_positives", "predicted_count"), F.try_divide("true_positives", "support")
    rows = rows.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision").isNull() | F.col("recall").isNull(), None).when((F.col("precision") == 0) & (F.col("recall") == 0), 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    return rows.select(
        F.col("label").alias("doc_type"), "nr", "support", "predicted_count", "true_positives", (F.col("predicted_count") - F.col("true_positives")).alias("false_positives"),
        (F.col("support") - F.col("true_positives")).alias("false_negatives"), "precision", "recall", f1.alias("f1"),
    )


def overall(pairs: DataFrame) -> DataFrame:
    """``(total_pages, accuracy)``; an accuracy of 0 for no pages."""
    return pairs.agg(F.count("*").alias("total_pages"), F.coalesce(F.avg((F.col("actual") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Mean F1 over labels with support and a defined F1; 0 if there is none."""
    return metrics.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1_supported"))


def misclassified(pairs: DataFrame) -> DataFrame:
    return pairs.where("actual != predicted")


@dataclass(frozen=True)
class Evaluation:
    """The small results of an evaluation, on the driver."""

    mode: str
    dataset_name: str
    total_pages: int
    accuracy: float
    macro_f1_supported: float
    per_class: list[dict[str, Any]]
    confusion_matrix: dict[str, dict[str, int]]
    #: How many there are; the lists end at the evaluation's limit.
    misclassified_count: int
    misclassified_pages: list[Any]
    mistakes: list[tuple[Any, str, str]]

    @property
    def supported_classes(self) -> list[str]:
        return [m["doc_type"] for m in self.per_class if m["support"] > 0]

    def as_dict(self) -> dict[str, Any]:
        return {
            "schema_version": "1.0.0", "mode": self.mode, "dataset_name": self.dataset_name, "total_pages": self.total_pages, "accuracy": self.accuracy, "per_class": self.per_class,
            "macro_f1_supported": self.macro_f1_supported, "supported_classes": self.supported_classes, "confusion_matrix": self.confusion_matrix, "misclassified_pages": self.misclassified_pages, "misclassified_count": self.misclassified_count,
            "model_name": None, "prompt_version": None, "rules_version": None, "run_report": None,
        }


def evaluate(truth: DataFrame, predictions: DataFrame, mode: str = "rule-only", dataset_name: str = "", labels: tuple[str, ...] = LABELS, listed: int = LISTED) -> Evaluation:
    """Checks alignment, then scores. Only label-sized tables and the first ``listed`` misclassified pages come to the driver; ``misclassified`` gives all of them as a table."""
    check_aligned(truth, predictions, labels)
    pairs = aligned(truth, predictions).cache()
    total = overall(pairs).first()
    metrics = [r.asDict() for r in class_metrics(pairs, labels).orderBy("nr").drop("nr").collect()]
    defined = [m["f1"] for m in metrics if m["support"] and m["f1"] is not None]
    cells = {(r.actual, r.predicted): r.n for r in confusion(pairs, labels).collect()}
    wrong = misclassified(pairs).orderBy(*KEYS).limit(listed).collect()
    n_wrong = sum(n for (a, p), n in cells.items() if a != p)
    several = len({r.package_id for r in wrong}) > 1
    name = lambda r: (r.package_id, r.page_number) if several else r.page_number
    pairs.unpersist()
    return Evaluation(
        mode, dataset_name, total.total_pages, total.accuracy, sum(defined) / len(defined) if defined else 0.0, metrics,
        {a: {p: cells[a, p] for p in labels} for a in labels}, n_wrong, [name(r) for r in wrong], [(name(r), r.actual, r.predicted) for r in wrong],
    )


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, widths)) for r in [head, *rows]]


def _places(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.4f}"


def report_text(e: Evaluation, expand: bool = True) -> str:
    """The evaluation for reading; with ``expand`` mistakes are listed with both labels."""
    labels = list(e.confusion_matrix)
    lines = [f"mode: {e.mode}", f"dataset: {e.dataset_name}", f"total_pages: {e.total_pages}", f"accuracy: {e.accuracy:.4f}", f"macro_f1_supported: {e.macro_f1_supported:.4f}", "", "per-class metrics:"]
    lines += _table(["doc_type", "support", "predicted", "precision", "recall", "f1"], [[m["doc_type"], str(m["support"]), str(m["predicted_count"]), *(_places(m[k]) for k in ("precision", "recall", "f1"))] for m in e.per_class])
    lines.append("")
    if unused := [m["doc_type"] for m in e.per_class if not m["support"]]:
        lines += [f"Note: {', '.join(unused)} has support 0: no true page, so recall and F1 stay N/A and don't enter macro_f1_supported.", ""]
    lines.append("confusion matrix (rows=actual, cols=predicted):")
    lines += _table(["actual\\predicted", *labels], [[a, *(str(e.confusion_matrix[a][p]) for p in labels)] for a in labels])
    lines += ["", f"misclassified pages ({e.misclassified_count}):"]
    if not e.misclassified_pages:
        lines.append("  none")
    elif expand:
        lines += _table(["page", "actual", "predicted"], [[str(p), a, b] for p, a, b in e.mistakes])
    else:
        lines.append("  " + ", ".join(map(str, e.misclassified_pages)))
    if more := e.misclassified_count - len(e.misclassified_pages):
        lines.append(f"  and {more} more")
    return "\n".join(lines)
