"""Policy-aware dedup: exact keys for tables' rows, greedy vector similarity for the rest, with an audit event for each discard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import snippet
from quern.operators.blocks import Blocks, earlier_neighbors, packed, rising_neighbors
from quern.sources.tables import materialize

THRESHOLD = 0.93
#: Near rows that are listed for a row at once; edges of lists, and rows (and bytes of their vectors), that one task may settle.
LISTED, FEW_EDGES, FEW_ROWS, FEW_BYTES = 16, 400_000, 4096, 64 << 20
#: Rows that lead a round, bytes of their vectors, and the least share of the others that a round must drop for another to follow.
LEADING, LEADING_BYTES, DROPPED = 4096, 16 << 20, 0.1
#: Policies whose rows are compared by key only.
EXACT_POLICIES = ("exact_only", "exact_key", "group_only")
EVENT = (
    "motivo string, sim double, fuente string, doc_id int, chunk_index int, global_id long, policy string, snip string, "
    "claves struct<entity_key:string,group_key:string,row:int>, pareja struct<fuente:string,doc_id:int,chunk_index:int,global_id:long,score:double,snip:string>"
)


def exact_key(policy: Column) -> Column:
    """A digest of what makes two rows of a source the same under their policy; nulls equal each other."""
    part = lambda *names: F.concat_ws("\x1f", *(F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in names))
    by_policy = F.when(policy == "exact_key", part("entity_key")).when(policy == "group_only", part("group_key", "chunk_index")).otherwise(part("row", "page_content"))
    return F.md5(F.concat(policy, F.lit("\x1e"), by_policy).cast("binary"))


def _firsts(df: DataFrame, key: Column) -> DataFrame:
    """(pos) of the first row of each source and key; digests and positions are grouped."""
    return df.groupBy("source", key.alias("_key")).agg(F.min("pos").alias("pos")).select("pos")


def exact_key_dedup(df: DataFrame) -> DataFrame:
    """df with `kept`: whether the row is the first, by pos, of its source and key. Rows meet the firsts by pos, which is unique, so no key is hot."""
    first = _firsts(df, exact_key(F.col("dedup_policy"))).withColumnRenamed("pos", "_first")
    return df.join(first, F.col("pos") == F.col("_first"), "left").withColumn("kept", F.col("_first").isNotNull()).drop("_first")


@dataclass(frozen=True)
class Greedy:
    """kept(pos); dropped(pos, winner, sim)."""

    kept: DataFrame
    dropped: DataFrame


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes in their order, each with the earlier ones in its list: lost if one of these is kept; else to wait, if one of them must be asked about or waits; else to be asked about, if the list was cut."""
    state: dict[int, str] = {}
    for frame in frames:
        for node, firsts, cut in zip(frame["last"], frame["firsts"], frame["cut"], strict=True):
            of = {state.get(f, "kept") for f in firsts}
            state[node] = "lost" if "kept" in of else "wait" if of & {"ask", "wait"} else "ask" if cut else "kept"
    yield pd.DataFrame({"node": pd.Series(list(state), dtype="int64"), "state": pd.Series(list(state.values()), dtype="str")})


def _settled(edges: DataFrame, cut: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What edges(last, first) tell: the nodes lost, those to ask about since all in their lists are lost and these were cut, and the edges of nodes that wait for these.

    In a round the nodes that no edge ends in are kept, unless they are to be asked about, and what is near them is lost. So few edges as one task may hold are settled there in order.
    """
    none = edges.select(F.col("last").alias("node")).limit(0)
    lost = ask = none
    while not edges.isEmpty():
        lasts, firsts = edges.select(F.col("last").alias("node")).distinct(), edges.select(F.col("first").alias("node")).distinct()
        if edges.count() <= FEW_EDGES:
            listed = edges.groupBy(F.col("last").alias("node")).agg(F.collect_set("first").alias("firsts")).unionByName(ask.withColumn("firsts", F.array().cast("array<long>")))
            marked = listed.join(cut.withColumn("cut", F.lit(True)), "node", "left").join(scores, "node")
            marked = marked.select(F.col("node").alias("last"), "firsts", F.coalesce("cut", F.lit(False)).alias("cut"), "score").repartition(1).sortWithinPartitions(F.col("score").desc(), "last")
            state = materialize(marked.drop("score").mapInPandas(_in_order, "node long, state string"), "states")
            gone, ask, waiting = (state.where(F.col("state") == name).select("node") for name in ("lost", "ask", "wait"))
            rest = edges.join(waiting.toDF("last"), "last", "left_semi").join(gone.toDF("first"), "first", "left_anti")
            return materialize(lost.unionByName(gone), "lost"), ask, materialize(rest.select("last", "first"), "near-pairs")
        heads = firsts.join(lasts, "node", "left_anti").join(ask, "node", "left_anti")
        gone = materialize(edges.join(heads.toDF("first"), "first", "left_semi").select(F.col("last").alias("node")).distinct(), "lost")
        rest = edges.join(gone.toDF("last"), "last", "left_anti").join(gone.toDF("first"), "first", "left_anti")
        rest = materialize(rest.select("last", "first"), "near-pairs")
        freed = lasts.join(gone, "node", "left_anti").join(rest.select(F.col("last").alias("node")), "node", "left_anti")
        again = materialize(freed.join(cut, "node", "left_semi"), "ask")
        lost, ask, moved = lost.unionByName(gone), ask.unionByName(again), edges.count() > rest.count()
        edges = rest
        if not moved:
            break
    return materialize(lost, "lost"), materialize(ask, "ask"), edges


def _finished(undecided: DataFrame, decided: Blocks, threshold: float) -> DataFrame:
    """(node) lost of FEW_ROWS undecided nodes at most: those near to an earlier one of the decided, which are kept, and, in one task in order, those near to one of their own that is kept."""
    mine = packed(undecided, "node", "v", score="score", pivots=decided.pivots)
    gone = materialize(earlier_neighbors(mine, decided, threshold, 1).select(F.col("id").alias("node")), "lost")
    rest = undecided.join(gone, "node", "left_anti").select("node", "score", "v").repartition(1)
    return gone.unionByName(materialize(_lost_of_few(rest, threshold), "lost"))


def _lost_of_few(few: DataFrame, threshold: float) -> DataFrame:
    """(node) lost of FEW_ROWS nodes at most in one partition, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"node": pd.Series(dtype="int64"), "v": pd.Series(dtype=object)}), *frames])
        kept: list[int] = []
        lost = []
        if len(rows):
            m = np.stack(rows["v"].to_numpy())
            near = m @ m.T >= threshold
            for i in range(len(m)):
                (lost if near[i, kept].any() else kept).append(i)
        yield pd.DataFrame({"node": rows["node"].to_numpy("int64")[lost]})

    return few.sortWithinPartitions(F.col("score").desc(), "node").select("node", "v").mapInPandas(run, "node long")


def _led(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lost, rest): the first LEADING of the nodes are settled in one task, all later ones near to those that are kept are lost, and so on with the rest, until that is empty or a round drops few. No kept node is near to the rest, so that is a table of its own."""
    lost, rest = nodes.select("node").limit(0), nodes.select("node", "score", "v")
    n, width = rest.agg(F.count("*"), F.max(F.size("v"))).first()
    leading = max(1, min(LEADING, LEADING_BYTES // (8 * max(width or 1, 1))))
    while n > leading:
        head = materialize(rest.orderBy(F.col("score").desc(), "node").limit(leading), "leading")
        gone = materialize(_lost_of_few(head.repartition(1), threshold), "lost")
        kept = head.join(F.broadcast(gone), "node", "left_anti").select("v").toArrow()
        shared = nodes.sparkSession.sparkContext.broadcast(np.asarray(kept["v"].combine_chunks().flatten(), float).reshape(len(kept), -1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column("v").flatten(), float).reshape(batch.num_rows, -1)
                near = np.zeros(len(x), bool)
                for lo in range(0, len(shared.value) if len(x) else 0, 256):
                    still = np.flatnonzero(~near)
                    near[still] = (x[still] @ shared.value[lo : lo + 256].T >= threshold).any(axis=1)
                # the vectors of what is lost are not written again
                held = [c.filter(pa.array(~near)).take(pa.array(np.cumsum(~near) - 1, mask=near)) if name == "v" else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(near)], [*batch.schema.names, "near"])

        told = materialize(rest.join(F.broadcast(head.select("node")), "node", "left_anti").mapInArrow(run, "node long, score double, v array<double>, near boolean"), "led")
        lost = lost.unionByName(gone).unionByName(told.where("near").select("node"))
        rest, before = told.where("NOT near").drop("near"), n - leading
        n = rest.count()
        if before - n < DROPPED * before:
            return lost, rest
    if n:
        lost, rest = lost.unionByName(materialize(_lost_of_few(rest.repartition(1), threshold), "lost")), rest.limit(0)
    return lost, rest


def _lost(nodes: DataFrame, threshold: float, known: DataFrame | None) -> DataFrame:
    """(node) of the nodes(node, score, v) that are dropped.

    Each node lists the first LISTED of the earlier ones near to it. A node is lost if one in its list is kept, and kept if all are lost and the list was whole; if
    it was cut, the node is asked about again, among the nodes that are not lost. The fewer are asked about, the longer their lists may be: LISTED pairs for each of
    all nodes are written at most in a turn, however many are near to each other, and what is lost meets nothing again. known(node, first): whole lists that are there already, with null for an empty one.
    """
    whole = packed(nodes, "node", "v", score="score")
    some = lambda of: packed(of, "node", "v", score="score", pivots=whole.pivots)
    lost = cut = nodes.select("node").limit(0)
    n = nodes.count()
    if known is None:
        ask, edges = nodes.select("node"), None
    else:
        ask = materialize(nodes.select("node").join(known.select("node"), "node", "left_anti"), "ask")
        edges = materialize(known.where("first IS NOT NULL").select(F.col("node").alias("last"), "first").distinct(), "near-pairs")
    while True:
        if edges is None or not ask.isEmpty():
            rows = whole if edges is None else some(nodes.join(ask, "node", "left_semi"))
            others = whole if edges is None else some(nodes.join(lost, "node", "left_anti"))
            found = materialize(earlier_neighbors(rows, others, threshold, LISTED if edges is None else LISTED * max(1, n // ask.count())), "near-lists")
            new = found.select(F.col("id").alias("last"), F.explode("near.other").alias("first"))
            edges = new if edges is None else materialize(edges.unionByName(new), "near-pairs")
            longer = found.where(F.col("n_near") > F.size("near")).select(F.col("id").alias("node"))
            cut = materialize(cut.join(ask, "node", "left_anti").unionByName(longer), "cut-lists")
        gone, ask, edges = _settled(edges, cut, nodes.select("node", "score"))
        lost = materialize(lost.unionByName(gone), "lost")
        if ask.isEmpty():
            return lost
        waiting = materialize(ask.unionByName(edges.select(F.col("last").alias("node")).distinct()), "undecided")
        undecided = nodes.join(waiting, "node", "left_semi")
        size = undecided.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v")), F.lit(0)).alias("bytes")).first()
        if size.n <= FEW_ROWS and size.bytes <= FEW_BYTES:
            return lost.unionByName(_finished(undecided, some(nodes.join(lost, "node", "left_anti").join(waiting, "node", "left_anti")), threshold))


def _whole_lists(rows: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """known of _lost() from near(pos, n_near, near) of neighbors(): for each node whose list is whole its earlier near nodes."""
    listed = nodes.select("node", "rank").join(near.select(F.col("pos").alias("node"), "n_near", "near"), "node").where(F.coalesce("n_near", F.lit(0)) <= F.coalesce(F.size("near"), F.lit(0)))
    listed = listed.select("node", "rank", F.explode_outer("near.other").alias("pos"))
    of = rows.select("pos", "node_key").join(nodes.select("node_key", F.col("node").alias("first"), F.col("rank").alias("first_rank")), "node_key").drop("node_key")
    both = listed.join(of, "pos", "left")
    return both.select("node", F.when(F.col("first_rank") < F.col("rank"), F.col("first")).alias("first"))


def greedy_semantic_dedup(df: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", score: str = "semantic_score", near: DataFrame | None = None) -> Greedy:
    """Visit rows by score, highest first, equals by pos; drop a row if a kept one is at least threshold near.

    The kept rows are the lexicographically first independent set of the graph of near pairs in that order. Equal vectors are one node. No table of
    near pairs is made: see _led() and _lost(). near(pos, n_near, near): what neighbors() has found with this threshold among these rows and others.
    """
    rows = df.select("pos", F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"), F.col(vector).cast("array<double>").alias("v"))
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("node_key", F.when(own >= threshold, F.md5(F.to_json("v"))).otherwise(F.concat(F.lit("row"), F.col("pos").cast("string")))).withColumn("own", own)
    rows = materialize(rows.withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"))), "dedup-rows")
    nodes = rows.groupBy("node_key").agg(F.min(F.struct("rank", "v")).alias("m")).select("node_key", "m.rank", F.col("m.rank.p").alias("node"), (-F.col("m.rank.s")).alias("score"), "m.v")
    nodes = materialize(nodes, "dedup-nodes")
    if near is None and nodes.count() > LEADING:
        lost, rest = _led(nodes, threshold)
        lost = materialize(lost if rest.isEmpty() else lost.unionByName(_lost(rest, threshold, None)), "lost")
    else:
        lost = _lost(nodes, threshold, None if near is None else _whole_lists(rows, nodes, near))
    # the nearest kept rows of what was dropped; the slack is for products that are summed in another order here
    kept_nodes, lost_nodes = nodes.join(lost, "node", "left_anti"), nodes.join(lost, "node", "left_semi")
    kept_blocks = packed(kept_nodes, "node", "v", score="score")
    rising = rising_neighbors(packed(lost_nodes, "node", "v", score="score", pivots=kept_blocks.pivots), kept_blocks, threshold - 1e-9)
    state = nodes.join(lost.withColumn("lost", F.lit(True)), "node", "left").select("node_key", "node", F.coalesce("lost", F.lit(False)).alias("lost"))
    rows = rows.select("pos", "node_key", "own", "rank").join(state, "node_key")
    kept = rows.where(~F.col("lost") & (F.col("pos") == F.col("node"))).select("pos")
    best = F.max_by(F.struct("winner", "sim"), F.struct("sim", (-F.col("winner_rank.s")).alias("s"), (-F.col("winner_rank.p")).alias("p"))).alias("b")
    rivals = rows.where("lost").join(rising.select(F.col("id").alias("node"), F.col("other").alias("winner"), F.struct((-F.col("score")).alias("s"), F.col("other").alias("p")).alias("winner_rank"), "sim"), "node").where("winner_rank < rank")
    dropped = rivals.groupBy("pos").agg(best).select("pos", "b.winner", "b.sim")
    copies = rows.where(~F.col("lost") & (F.col("pos") != F.col("node"))).select("pos", F.col("node").alias("winner"), F.col("own").alias("sim"))
    return Greedy(kept, dropped.unionByName(copies))


@dataclass(frozen=True)
class Dedup:
    """The rows that stay, with their columns, and the discards as EVENT rows."""

    kept: DataFrame
    events: DataFrame


def is_exact() -> Column:
    """Rows of an exact policy go through their keys, all others (null, semantic_optional) through greedy similarity."""
    return F.coalesce(F.col("dedup_policy").isin(*EXACT_POLICIES), F.lit(False))


def key_and_snippet() -> dict[str, Column]:
    """What decide() needs of a text, as columns `key` and `snip`."""
    return {"key": F.when(is_exact(), exact_key(F.col("dedup_policy"))), "snip": snippet(F.col("page_content"))}


def decide(df: DataFrame, semantic: DataFrame, threshold: float = THRESHOLD, near: DataFrame | None = None) -> Dedup:
    """kept(pos) and events of df(pos, source, doc_id, chunk_index, row, entity_key, group_key, dedup_policy, semantic_score, key, snip), where semantic(pos, semantic_score, embedding) are the rows of no exact policy. No text and, but for these, no vector is moved."""
    exact = df.where(is_exact())
    greedy = greedy_semantic_dedup(semantic, threshold, near=near)
    kept = materialize(_firsts(exact, F.col("key")).unionByName(greedy.kept), "kept-rows")
    pair, no_pair = "struct<fuente:string,doc_id:int,chunk_index:int,global_id:long,score:double,snip:string>", F.lit(None)
    base = dict(fuente=F.col("source"), doc_id=F.col("doc_id").cast("int"), chunk_index=F.col("chunk_index").cast("int"), global_id=F.col("pos"), policy=F.col("dedup_policy"), snip=F.col("snip"))
    keys = F.struct("entity_key", "group_key", F.col("row").cast("int").alias("row"))
    by_key = exact.join(kept, "pos", "left_anti").select(F.lit("dedup_clave").alias("motivo"), F.lit(None).cast("double").alias("sim"), *(c.alias(n) for n, c in base.items()), keys.alias("claves"), no_pair.cast(pair).alias("pareja"))
    by_sim = winner_lookup(df.where(~is_exact()), greedy.dropped)
    by_sim = by_sim.select(F.lit("dedup_coseno").alias("motivo"), F.round("sim", 4).alias("sim"), *(c.alias(n) for n, c in base.items()), F.lit(None).cast("struct<entity_key:string,group_key:string,row:int>").alias("claves"), "pareja")
    return Dedup(kept, by_key.unionByName(by_sim))


def deduplicate(df: DataFrame, threshold: float = THRESHOLD, near: DataFrame | None = None) -> Dedup:
    """The rows of df that decide() keeps, and its events; greedy similarity may be given the near rows that are known."""
    decided = decide(df.withColumns(key_and_snippet()), df.where(~is_exact()), threshold, near)
    return Dedup(df.join(decided.kept, "pos", "left_semi"), decided.events)


def winner_lookup(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """Discarded rows with sim and, in pareja, the identity, score and snippet (snip, or that of the text) of the row that beat them."""
    snip = F.col("snip") if "snip" in df.columns else snippet(F.col("page_content"))
    other = F.struct(F.col("source").alias("fuente"), F.col("doc_id").cast("int").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("pos").alias("global_id"), F.col("semantic_score").cast("double").alias("score"), snip.alias("snip"))
    return df.join(dropped, "pos").join(df.select(F.col("pos").alias("winner"), other.alias("pareja")), "winner")


def audit_sample(events: DataFrame, source: str | None = None, reason: str | None = None, top: int | None = None) -> DataFrame:
    """Events of sources that contain a text and of a reason ('coseno' or 'clave'), the most similar first, those by key last."""
    if source:
        events = events.where(F.contains("fuente", F.lit(source)))
    if reason:
        events = events.where(F.col("motivo") == f"dedup_{reason}")
    events = events.orderBy(F.col("sim").desc_nulls_last(), "fuente", "global_id")
    return events.limit(top) if top else events


def emptied_sources(before: DataFrame, after: DataFrame, events: DataFrame) -> DataFrame:
    """(fuente, motivo, sim, global_id) of sources that lost all rows: their event of the highest similarity, the first of equals."""
    gone = before.select(F.col("source").alias("fuente")).distinct().join(after.select(F.col("source").alias("fuente")).distinct(), "fuente", "left_anti")
    best = F.max_by(F.struct("motivo", "sim", "global_id"), F.struct(F.coalesce("sim", F.lit(float("-inf"))).alias("s"), (-F.col("global_id")).alias("p"))).alias("b")
    return events.join(gone, "fuente", "left_semi").groupBy("fuente").agg(best).select("fuente", "b.*")
