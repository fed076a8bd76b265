"""From raw documents and an external score to a verdict per document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import extraction, graph, sections
from plumbline.operators.gate import gate


def document_graph(documents: DataFrame, segmented: bool = False, order: str = "confidence") -> DataFrame:
    """documents(doc_id, text) -> argument graph in adjacency form; one narrow pass."""
    cut = sections.sectioned(documents) if segmented else sections.single_section(documents)
    return graph.build_graph(extraction.with_items(cut, order))


def document_gate(documents: DataFrame, scores: DataFrame, segmented: bool = False,
                  order: str = "confidence") -> DataFrame:
    """scores(doc_id, score, max_score) joined to the structural verdict.

    Text is read once and dropped before the first shuffle; what is shuffled are
    per-node marks, then one row per document. Documents without a score drop out
    with their small metric rows: a join on the ids first would shuffle the texts."""
    metrics = graph.graph_metrics(document_graph(documents, segmented, order))
    return gate(metrics.join(scores, "doc_id"), "score", "max_score")
