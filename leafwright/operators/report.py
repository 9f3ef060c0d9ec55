"""Run counters, tile and heat-map layouts, the gate for personal data, and the columns of saved files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.regexes import java_pattern
from ..schema import LABELS

# One colour for each label in every figure, and what no saved file may hold.
COLOURS = {"URLA_1003": "#0072B2", "INCOME_DOC": "#E69F00", "CREDIT_REPORT": "#009E73", "TITLE_REPORT": "#CC79A7", "OTHER": "#999999"}
PERSONAL = {"SSN-like": r"\b\d{3}-\d{2}-\d{4}\b", "email-like": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"}

TILES_PER_BAND = 40


def _listed() -> dict[str, Column]:
    """Which pages a report lists."""
    return {"llm_target": F.col("targeted"), "empty_text": F.col("normalized_text_length") == 0, "orphan": F.col("is_orphan")}


def _counts() -> list[Column]:
    source = lambda s: F.count_if(F.col("decision_source") == s)
    return [
        F.count("*").alias("total_pages"), source("RULE").alias("rule_resolved"), F.count_if("llm_called").alias("llm_called"), source("LLM").alias("llm_resolved"), source("RULE_FALLBACK").alias("rule_fallback_count"),
        F.count_if(F.array_contains("warnings", "LLM_PARSE_FAILED")).alias("llm_parse_failures"), *(F.count_if(keep).alias(f"{name}_count") for name, keep in _listed().items()),
    ]


def run_totals(results: DataFrame) -> DataFrame:
    """One row in all with what became of the pages: counts alone, so nothing is gathered."""
    return results.agg(*_counts())


def run_counters(results: DataFrame) -> DataFrame:
    """One row per package with what became of its pages, and the pages that its report lists: one aggregate."""
    pages = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("page_number"))))
    return results.groupBy("package_id").agg(*_counts(), *(pages(keep).alias(f"{name}_pages") for name, keep in _listed().items()))


def page_rows(results: DataFrame) -> DataFrame:
    """The page results as saved: twenty columns, by page, without text or identifiers."""
    flag, c = t.truth_value, F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    return results.orderBy("package_id", "page_number").select(
        "package_id", "page_number", "doc_type", "decision_source", "rule_doc_type", "rule_score", "rule_margin", "matched_class_count", flag("strong_signature_matched").alias("strong_signature_matched"),
        flag("llm_called").alias("llm_called"), flag("llm_failed").alias("llm_failed"), text("llm_doc_type").alias("llm_doc_type"), text("llm_confidence").alias("llm_confidence"), "marker_style",
        text("marker_page").alias("marker_page"), text("marker_total").alias("marker_total"), text("instance_id").alias("instance_id"), flag("is_orphan").alias("is_orphan"), "rotation", "normalized_text_length", t.joined("warnings").alias("warnings"),
    )


def group_rows(groups: DataFrame) -> DataFrame:
    return groups.orderBy("package_id", "start_page").select("package_id", "group_id", "doc_type", "start_page", "end_page", "page_count", t.joined("physical_pages").alias("physical_pages"))


def document_rows(documents: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    links = F.array_sort(F.transform("page_links", lambda x: F.struct(F.coalesce(x["logical_page"], F.lit(0)).alias("l"), x["physical_page"].alias("p"))))
    return documents.orderBy("package_id", "doc_id").select(
        "package_id", "doc_id", "doc_type", text("instance_id").alias("instance_id"), "marker_style", text("expected_pages").alias("expected_pages"),
        *(t.joined(c).alias(c) for c in ("observed_logical_pages", "missing_logical_pages", "duplicate_logical_pages")), text("first_page_at").alias("first_page_at"), text("last_page_at").alias("last_page_at"),
        "physical_span", t.truth_value("is_contiguous").alias("is_contiguous"), "completeness", t.joined("issues").alias("issues"),
        F.array_join(F.transform(links, lambda x: F.concat(x["l"].cast("string"), F.lit("->"), x["p"].cast("string"))), ";").alias("logical_to_physical"),
    )


def _strings(field: T.StructField) -> bool:
    kind = field.dataType
    return isinstance(kind, T.StringType) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType))


def personal_data(df: DataFrame) -> DataFrame:
    """One row: how many rows hold each kind of personal data in any text column."""
    columns = [F.array_join(F.col(f.name), " ") if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields if _strings(f)]
    hit = lambda p: _or([F.coalesce(F.regexp_like(c, F.lit(java_pattern(p).pattern)), F.lit(False)) for c in columns])
    return df.agg(*(F.count_if(hit(p)).alias(name.replace("-", "_")) for name, p in PERSONAL.items()))


def _or(parts: list[Column]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | part
    return out


def check_no_pii(*frames: DataFrame) -> None:
    """Raises ValueError if any row of any frame holds personal data; to be called before the first of them is saved."""
    for df in frames:
        if found := [k for k, n in personal_data(df).first().asDict().items() if n]:
            raise ValueError(f"Refusing to write output: text matches an {found[0].replace('_', '-')} pattern")


def check_text(text: str) -> None:
    """The same gate for one string."""
    import re

    for name, pattern in PERSONAL.items():
        if re.search(pattern, text):
            raise ValueError(f"Refusing to write output: text matches an {name} pattern")


def bands(n_pages: int, most: int = TILES_PER_BAND) -> list[tuple[int, int]]:
    """Page ranges of at most ``most`` pages each."""
    return [(a, min(a + most - 1, n_pages)) for a in range(1, n_pages + 1, most)]


def tile_layout(results: DataFrame, truth: DataFrame | None = None, most: int = TILES_PER_BAND) -> DataFrame:
    """Where each page's tile goes and how it looks: band, place, colours, and whether truth disagrees."""
    colours = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    rows = results.select("package_id", "page_number", F.col("doc_type").alias("predicted"))
    if truth is not None:
        rows = rows.join(truth.select("package_id", "page_number", F.col("doc_type").alias("actual")), ["package_id", "page_number"], "full")
    else:
        rows = rows.withColumn("actual", F.lit(None).cast("string"))
    return rows.select(
        "package_id", "page_number", F.floor((F.col("page_number") - 1) / most).cast("int").alias("band"), ((F.col("page_number") - 1) % most).alias("place"), "predicted", "actual",
        F.try_element_at(colours, "predicted").alias("predicted_colour"), F.try_element_at(colours, "actual").alias("actual_colour"), F.coalesce(F.col("predicted") != F.col("actual"), F.lit(False)).alias("mismatch"),
    )


def heatmap_cells(confusion: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Cells of the confusion heat map with row and column numbers and each row's share."""
    place = F.create_map(*(F.lit(x) for i, label in enumerate(labels) for x in (label, i)))
    total = confusion.groupBy("actual").agg(F.sum("n").alias("support"))
    return confusion.join(total, "actual").select("actual", "predicted", F.element_at(place, F.col("actual")).alias("row"), F.element_at(place, F.col("predicted")).alias("column"), "n", F.try_divide("n", "support").alias("share"))


def zero_support_note(metrics: list[dict]) -> str | None:
    """A caption that names the labels without a true page; none if there is none."""
    unused = [m["doc_type"] for m in metrics if not m["support"]]
    return f"{', '.join(unused)}: support 0, recall and F1 undefined" if unused else None


def render(layout: list[dict], cells: list[dict] | None, out_dir: str, title: str = "pages") -> list[str]:
    """Draws ``page_strip.png`` and, with cells, ``confusion_matrix.png``; needs matplotlib."""
    from pathlib import Path

    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt
    from matplotlib.patches import Patch, Rectangle

    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    rows = max((r["band"] for r in layout), default=0) + 1
    truth = any(r["actual"] for r in layout)
    fig, axes = plt.subplots(rows, 1, figsize=(12, 1.2 + rows), squeeze=False)
    for r in layout:
        ax = axes[r["band"], 0]
        for level, key in enumerate(("predicted_colour", "actual_colour")):
            if r[key]:
                ax.add_patch(Rectangle((r["place"], level), 1, 1, facecolor=r[key], edgecolor="white"))
        if r["mismatch"]:
            ax.add_patch(Rectangle((r["place"], 0), 1, 2, fill=False, edgecolor="black", linewidth=2))
    for ax in axes[:, 0]:
        ax.set(xlim=(0, TILES_PER_BAND), ylim=(0, 1 + truth), yticks=[0.5, 1.5][: 1 + truth], yticklabels=["Prediction", "Ground Truth"][: 1 + truth])
    both = [r for r in layout if r["actual"] and r["predicted"]]
    accuracy = f"accuracy {sum(not r['mismatch'] for r in both) / len(both):.4f}" if both else "no ground truth available"
    fig.suptitle(f"{title}\n{len(layout)} pages | {accuracy}")
    fig.legend(handles=[Patch(color=c, label=n) for n, c in COLOURS.items()], loc="lower center", ncol=len(COLOURS))
    paths = [str(out / "page_strip.png")]
    fig.savefig(paths[0], dpi=150)
    plt.close(fig)
    if cells:
        n = max(c["row"] for c in cells) + 1
        grid = [[0] * n for _ in range(n)]
        names = [""] * n
        for c in cells:
            grid[c["row"]][c["column"]] = c["n"]
            names[c["row"]] = c["actual"]
        fig, ax = plt.subplots(figsize=(7, 6))
        ax.imshow(grid, cmap="Blues")
        ax.set(xticks=range(n), yticks=range(n), xticklabels=names, yticklabels=names, xlabel="predicted", ylabel="actual")
        for c in cells:
            ax.text(c["column"], c["row"], str(c["n"]), ha="center", va="center")
        paths.append(str(out / "confusion_matrix.png"))
        fig.savefig(paths[1], dpi=150)
        plt.close(fig)
    return paths
