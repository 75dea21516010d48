"""Quality of a corpus of records with vectors, as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quern.operators.evaluation import SharedRelevance, category_report, evaluate_retrieval, length_report, metadata_keys, nearest_neighbor, neighbor_summary, records_without, retrieval_summary, tag_counts, validate_vectors
from quern.sources.files import long_form
from quern.sources.tables import materialize


def _by_name(df: DataFrame, section: str, name: str) -> DataFrame:
    """Long form of a table with a row for each name: the metric is `name.column`."""
    columns = [c for c in df.columns if c != name]
    pairs = F.array(*(F.struct(F.concat(F.col(name), F.lit(f".{c}")).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.lit(section).alias("section"), F.inline(pairs))


def run_quality_report(records: DataFrame, threshold: float, cases: DataFrame | None = None, relevance: DataFrame | SharedRelevance | None = None, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(section, metric, value) of vector checks, lengths, neighbours, categories, metadata keys, tags, fields that are missing and, with cases and their relevance, retrieval. records has pos, id, text, source, document_id, category, metadata, tags and embedding."""
    neighbors = materialize(nearest_neighbor(records, threshold), "neighbors")
    parts = {"vectors": validate_vectors(records), "lengths": length_report(records), "neighbors": neighbor_summary(neighbors), "metadata": records_without(records)}
    if cases is not None:
        parts["retrieval"] = retrieval_summary(evaluate_retrieval(cases, relevance, records, ks), ks)
    named = [_by_name(category_report(records), "categories", "category"), _by_name(metadata_keys(records), "metadata_keys", "key"), _by_name(tag_counts(records), "tags", "tag")]
    return reduce(DataFrame.unionByName, [*(long_form(df, section) for section, df in parts.items()), *named])
