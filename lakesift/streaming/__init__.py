"""Scores over streams: class sums and cell counts add up, so they can be kept as a stream's state.

The state has a row for each class (sums) or cell (counts), however long the stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lakesift.dataset import FeatureFrame
from lakesift.functions.information import mutual_information
from lakesift.operators.chi2 import chi2_of_sums, class_sums
from lakesift.operators.contingency import cells


def stream_chi2(stream: DataFrame, label_col: str, feature_cols: Sequence[str], on_scores: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Calls on_scores with the chi-squared scores of all rows so far, after each batch."""
    names = tuple(feature_cols)

    def scored(sums: DataFrame, batch: int) -> None:
        kept = sums.persist()
        on_scores(chi2_of_sums(kept, names, kept.count()), batch)
        kept.unpersist()

    writer = class_sums(FeatureFrame.of(stream, label_col, names)).writeStream.outputMode("complete").foreachBatch(scored)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_relevance(stream: DataFrame, label_col: str, feature_cols: Sequence[str], on_scores: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Calls on_scores with (pair, mi) of all rows so far, after each batch; pair is the feature's position."""
    counted = cells(stream, [(c, label_col) for c in feature_cols])
    writer = counted.writeStream.outputMode("complete").foreachBatch(lambda found, batch: on_scores(mutual_information(found), batch))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
