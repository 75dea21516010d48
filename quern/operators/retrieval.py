"""Exact batch retrieval, the evidence gate, and prompts for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quern.functions.text import ABSTENTION, context_block, question_error, rag_prompt
from quern.functions.vectors import l2_normalize
from quern.operators.blocks import FEW, FEW_BYTES, packed, top_k, top_k_near
from quern.sources.tables import materialize

MAX_DISTANCE, MAX_CHUNKS, UNKNOWN = 0.65, 5, "desconocido"


def retrieve(queries: DataFrame, index: DataFrame, k: int, query: str = "query_id", id: str = "pos", vector: str = "embedding") -> DataFrame:
    """(query_id, pos, distance, rank): the k rows of the smallest cosine distance; k beyond the index gives all, an empty index nothing. A batch of queries of a checked size goes to the index's partitions; more of them meet it in blocks."""
    if k <= 0:
        raise ValueError(f"top_k must be positive, not {k}")
    unit = lambda df, key: df.select(F.col(key).cast("long").alias("id"), l2_normalize(F.col(vector)).cast("array<double>").alias("vector"))
    asked = materialize(unit(queries, query), "asked")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("vector")), F.lit(0)).alias("bytes")).first()
    if size.n <= FEW and size.bytes <= FEW_BYTES:
        found = top_k_near(asked, unit(index, id), k)
    else:
        found = top_k(packed(asked, "id", "vector"), packed(unit(index, id), "id", "vector"), k)
    return found.select(F.col("query").alias(query), F.col("id").alias(id), (1 - F.col("sim")).alias("distance"), "rank")


def with_content(hits: DataFrame, index: DataFrame, id: str = "pos") -> DataFrame:
    """Hits with the text and source of their rows, and, as a struct, all their other columns but vectors as metadata."""
    kinds = dict(index.dtypes)
    others = [c for c in index.columns if c not in (id, "page_content") and not kinds[c].startswith(("array<float", "array<double"))]
    return hits.join(index.select(id, F.col("page_content").alias("text"), F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.struct(*others).alias("metadata")), id)


def seed_neighbors(seeds: DataFrame, index: DataFrame, k: int, id: str = "pos", vector: str = "embedding") -> DataFrame:
    """(seed, pos, distance, rank) of the k nearest rows to each seed, itself left out."""
    hits = retrieve(seeds.select(F.col(id).alias("seed"), vector), index, k + 1, "seed", id, vector).where(F.col("seed") != F.col(id))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("rank"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def evidence_gate(queries: DataFrame, hits: DataFrame, most: float = MAX_DISTANCE, query: str = "query_id") -> DataFrame:
    """queries with best_distance and has_evidence; without hits there is none."""
    best = hits.groupBy(query).agg(F.min("distance").alias("best_distance"))
    return queries.join(best, query, "left").withColumn("has_evidence", F.coalesce(F.col("best_distance") <= most, F.lit(False)))


def ordered_sources(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, sources): each query's sources once, in order of appearance."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return hits.groupBy(query).agg(F.array_distinct(F.transform(in_order, lambda h: h["source"])).alias("sources"))


def question_hits(questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits with content of those questions that have no error."""
    return with_content(retrieve(questions.where(question_error(F.col("question")).isNull()), index, k), index)


def rag_batch(questions: DataFrame, index: DataFrame, k: int, system: str = "", most: float = MAX_DISTANCE, hits: DataFrame | None = None) -> DataFrame:
    """A row for each of questions(query_id, question, embedding): error, has_evidence, abstained, n_chunks, sources, context, prompt, answer. The sources are of the chunks in the prompt; without evidence the answer is the abstention, the context empty, and the sources are of all hits. hits: question_hits of this k or more."""
    checked = questions.withColumn("error", question_error(F.col("question")))
    hits = question_hits(questions, index, k) if hits is None else hits.where(F.col("rank") <= k)
    gated = evidence_gate(checked.drop("embedding"), hits, most)
    top = hits.where(F.col("rank") <= MAX_CHUNKS)
    text = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("_hits"))
    given = ordered_sources(top).withColumnRenamed("sources", "_given")
    out = gated.join(text, "query_id", "left").join(ordered_sources(hits), "query_id", "left").join(given, "query_id", "left")
    use = F.col("has_evidence")
    out = out.withColumn("sources", F.when(use, F.col("_given")).otherwise(F.col("sources")))
    out = out.withColumn("context", F.when(use, context_block(F.col("_hits"))).otherwise(""))
    return out.select(
        "query_id", "question", "error", "has_evidence", (F.col("error").isNull() & ~use).alias("abstained"), F.when(use, F.size("_hits")).otherwise(0).alias("n_chunks"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "context",
        F.when(use, rag_prompt(system, F.col("context"), F.col("question"))).alias("prompt"), F.when(F.col("error").isNull() & ~use, ABSTENTION).alias("answer"),
    )


def rag_grid_report(questions: DataFrame, index: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """rag_batch for each top_k over one retrieval of the largest; questions also carry fuente_esperada, out_of_corpus and categoria_esperada. A row for each question and k."""
    hits = materialize(question_hits(questions, index, max(ks)), "hits")
    extra = questions.select("query_id", "fuente_esperada", "out_of_corpus", F.col("categoria_esperada").alias("categoria"))
    out = None
    for k in ks:
        one = rag_batch(questions.drop("fuente_esperada", "out_of_corpus", "categoria_esperada"), index, k, hits=hits).withColumn("top_k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    both = out.join(extra, "query_id")
    hit = F.exists("sources", lambda s: s == F.col("fuente_esperada"))
    return both.withColumns({"source_hit": F.coalesce(hit, F.lit(False)), "right_abstention": F.col("abstained") & F.coalesce("out_of_corpus", F.lit(False))})


def rag_rates(report: DataFrame) -> DataFrame:
    """Rates of rag_grid_report's rows(top_k, categoria, ...) for each top_k and category, each top_k, and all: how many rows, those with an error and abstentions, mean chunks, the share that has the expected source among those that expect one, and the share that abstains among those out of the corpus. level: 0 for a category's row, 1 for a top_k's, 3 for all."""
    share = lambda wanted, of: F.when(F.count_if(of) > 0, F.count_if(wanted & of) / F.when(F.count_if(of) > 0, F.count_if(of)))
    expects, outside = F.col("fuente_esperada").isNotNull() & ~F.coalesce("out_of_corpus", F.lit(False)), F.coalesce("out_of_corpus", F.lit(False))
    sets = [[F.col("top_k"), F.col("categoria")], [F.col("top_k")], []]
    return report.groupingSets(sets, "top_k", "categoria").agg(
        F.grouping_id("top_k", "categoria").cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("abstained").alias("abstained"), F.avg("n_chunks").alias("mean_chunks"),
        share(F.col("source_hit"), expects).alias("source_hit_rate"), share(F.col("abstained"), outside).alias("right_abstention_rate"),
    )


def query_log(batch: DataFrame, model: str, timings: tuple[str, ...] = ()) -> DataFrame:
    """A JSON line for each query, with the columns named in timings as t_..."""
    row = F.struct(F.col("question").alias("pregunta"), "top_k", "n_chunks", F.lit(model).alias("modelo"), "abstained", *(F.col(name).cast("double").alias(f"t_{name}") for name in timings))
    return batch.select("query_id", F.to_json(row).alias("line"))
