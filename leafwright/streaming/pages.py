"""Pages as a stream: classification is stateless; grouping waits for whole packages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify, extract
from ..plans.rulepack import RulePack
from ..plans.run import RunResult, run


def classify_stream(pages: DataFrame, rules: RulePack) -> DataFrame:
    """Rule decisions of a stream of raw pages, without their text; nothing is kept between batches."""
    return classify.classify(extract.extract_pages(pages, rules), rules).drop("text", "raw_identifiers")


def windowed_labels(classified: DataFrame, time_col: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pages per label and time window, with late pages taken in up to ``late``."""
    return classified.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), "doc_type").agg(F.count("*").alias("pages"), F.count_if("delegate").alias("delegated"))


def group_finished(packages: DataFrame, rules: RulePack, sink: Callable[[RunResult, int], None], checkpoint: str, mode: str = "rule-only", **options) -> StreamingQuery:
    """Runs whole packages as they arrive: rows of ``packages`` hold ``package_id`` and ``pages``, an array of all its raw pages.

    Each micro-batch goes through the batch run and to ``sink`` with its number, by which a sink can tell a repeated batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        raw = batch.select("package_id", F.explode("pages").alias("page")).select("package_id", "page.*")
        sink(run(raw, rules, mode, **options), number)

    return packages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
