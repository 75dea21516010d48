"""Queries of delimited tables, files, sinks and records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from quern.operators import delimited as D, dedup
from quern.queries.base import CHUNKS, ORACLE_SQL, Tables, chunks, query  # noqa: F401 (tests take ORACLE_SQL from here)
from quern.sources import files
from quern.sources.loader import load_files
from quern.sources.tables import materialize, with_global_index

#: The first 2000 parts by key as text, as a profile sees them.
_PART = "p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 2000))"
_CELLS = ("p_name", "p_mfgr", "p_brand", "p_type", "p_size", "p_container", "p_retailprice")


def _part(t: Tables) -> DataFrame:
    have = [c for c in _CELLS if c in t.part.columns]
    return t.part.select(F.col("p_partkey").alias("at"), *have)


@query("c1_profile_part", f"""
WITH {_PART} SELECT count(*) AS n_rows, count(DISTINCT p_brand) AS n_distinct_brand_type, count(*) FILTER (n <= 1000) AS filled_size, count(*) FILTER (n <= 1000) AS numeric_size,
    count(DISTINCT CASE WHEN n <= 1000 THEN p_size END) AS distinct_size, count(DISTINCT CASE WHEN n <= 1000 THEN p_brand END) AS distinct_brand, 0 AS numeric_brand, sum(length(p_brand || '|' || p_size))::BIGINT AS n_chars FROM p""".replace("count(DISTINCT p_brand) AS n_distinct_brand_type", "count(DISTINCT p_brand || '|' || p_size) AS n_distinct"))
def _(t: Tables) -> DataFrame:
    row = D.profile_row(t.part.select(F.col("p_partkey").alias("at"), "p_brand", "p_size"), "at")
    return row.select("n_rows", "n_distinct", F.col("filled_1").alias("filled_size"), F.col("numeric_1").alias("numeric_size"), F.col("distinct_1").alias("distinct_size"), F.col("distinct_0").alias("distinct_brand"), F.col("numeric_0").alias("numeric_brand"), "n_chars")


def _advice(t: Tables, df: DataFrame, source: str, recipes: dict[str, D.Recipe] = D.RECIPES) -> DataFrame:
    a = D.advise(D.profile_table(df, source, "at"), recipes)
    row = (a.source, a.csv_kind, a.treatment, a.dedup_policy, ",".join(a.id_columns), ",".join(a.measure_columns), ",".join(a.grouping_keys), a.confidence)
    return t.spark.createDataFrame([row], "source string, csv_kind string, treatment string, dedup_policy string, id_columns string, measure_columns string, grouping_keys string, confidence double")


def _facts(t: Tables) -> DataFrame:
    """Line items with names that tell their roles."""
    li = t.lineitem
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.date_format("l_shipdate", "yyyy-MM").alias("fecha"), F.col("l_returnflag").alias("grupo"), F.col("l_linestatus").alias("clase"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("modo"), F.col("l_quantity").cast("int").cast("string").alias("cantidad"))


_FACTS = "facts AS (SELECT l_orderkey * 10 + l_linenumber AS at, strftime(l_shipdate, '%Y-%m') AS fecha, l_returnflag AS grupo, l_linestatus AS clase, 'm' || l_linenumber AS modo, (l_quantity::INT)::VARCHAR AS cantidad FROM lineitem)"
_ENTITIES = "ents AS (SELECT s_suppkey AS at, 'S' || s_suppkey AS pk, s_name AS nombre, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE '' END AS distrito FROM supplier)"


def _entities(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("at"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pk"), F.col("s_name").alias("nombre"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("").alias("distrito"))


@query("c2_match_recipe", f"WITH {_ENTITIES} SELECT 'places.csv' AS source, 'entity_table' AS csv_kind, 'entity_doc' AS treatment, 'exact_key' AS dedup_policy, 'pk' AS id_columns, '' AS measure_columns, '' AS grouping_keys, 0.99::DOUBLE AS confidence FROM ents LIMIT 1")
def _(t: Tables) -> DataFrame:
    return _advice(t, _entities(t), "places.csv", {"places.csv": D.Recipe("entity_table", "known", ("pk",))})


@query("c3_infer_kind", f"""
WITH {_ENTITIES}, {_FACTS}
SELECT 'entities' AS source, 'entity_table' AS csv_kind, 'entity_doc' AS treatment, 'exact_key' AS dedup_policy, 'pk' AS id_columns, '' AS measure_columns, '' AS grouping_keys, 0.8::DOUBLE AS confidence WHERE (SELECT count(*) FROM ents) > 0
UNION ALL SELECT 'facts', 'unknown_csv', 'row_as_doc', 'exact_only', 'cantidad', 'cantidad', '', 0.4 WHERE (SELECT count(*) FROM facts) > 0
UNION ALL SELECT 'prices', 'time_series', 'grouped_doc', 'group_only', '', 'precio', 'fecha,grupo,clase,modo', 0.85 WHERE (SELECT count(*) FROM facts) > 0""")
def _(t: Tables) -> DataFrame:
    prices = _facts(t).withColumnRenamed("cantidad", "precio")
    return _advice(t, _entities(t), "entities").unionByName(_advice(t, _facts(t).select("at", "fecha", "cantidad"), "facts")).unionByName(_advice(t, prices, "prices"))


@query("c4_grouping_keys", f"WITH {_FACTS} SELECT unnest(['fecha', 'grupo', 'clase', 'modo']) AS key, unnest([0, 1, 2, 3]) AS place WHERE (SELECT count(*) FROM facts) > 0")
def _(t: Tables) -> DataFrame:
    keys = D.grouping_keys(D.profile_table(_facts(t).withColumnRenamed("cantidad", "precio"), "facts", "at"))
    return t.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, place int")


@query("c5_entity_docs", f"""
WITH {_ENTITIES} SELECT "at" AS row, 'pk: ' || pk || ' | nombre: ' || nombre || CASE WHEN distrito <> '' THEN ' | distrito: ' || distrito ELSE '' END AS page_content, pk AS entity_key, distrito AS district, '' AS neighborhood, 'no_chunk' AS chunking_hint FROM ents""")
def _(t: Tables) -> DataFrame:
    docs = D.entity_docs(_entities(t), D.Advice("suppliers.csv", "entity_table", ["pk"]), "at")
    return docs.select("row", "page_content", "entity_key", "district", "neighborhood", "chunking_hint")


@query("c6_grouped_docs", f"""
WITH {_FACTS} SELECT min("at") AS row, 'Resumen del dataset facts.csv.' || chr(10) || 'fecha: ' || fecha || chr(10) || 'grupo: ' || grupo || chr(10) || 'modo: ' || modo || chr(10) || chr(10)
    || string_agg('- clase: ' || clase || ' | cantidad: ' || cantidad, chr(10) ORDER BY "at", '- clase: ' || clase || ' | cantidad: ' || cantidad) AS page_content, fecha || '|' || grupo || '|' || modo AS group_key, count(*)::INT AS group_size FROM facts GROUP BY fecha, grupo, modo""")
def _(t: Tables) -> DataFrame:
    docs = D.grouped_docs(_facts(t), D.Advice("facts.csv", "time_series", grouping_keys=["fecha", "grupo", "modo"]), "at")
    return docs.select("row", "page_content", "group_key", "group_size")


@query("c7_row_docs", f"""WITH {_FACTS} SELECT "at" AS row, 'fecha: ' || fecha || ' | grupo: ' || grupo || ' | clase: ' || clase || ' | modo: ' || modo || ' | cantidad: ' || cantidad AS page_content, 'normal_chunk' AS chunking_hint FROM facts""")
def _(t: Tables) -> DataFrame:
    return D.row_docs(_facts(t), D.Advice("facts.csv", "unknown_csv"), "at").select("row", "page_content", "chunking_hint")


@query("c8_transform_table", f"WITH {_FACTS} SELECT 'time_series' AS csv_kind, fecha || '|' || grupo || '|' || clase || '|' || modo AS group_key, count(*)::INT AS group_size FROM facts GROUP BY fecha, grupo, clase, modo")
def _(t: Tables) -> DataFrame:
    return D.transform_table(_facts(t).withColumnRenamed("cantidad", "precio"), "new.csv", "at").select("csv_kind", "group_key", "group_size")


# ---- files and sinks: data of the tables written out and read back ------------------------------------------------------------


#: Names with a line end, which is then quoted, or with a separator of lines that doesn't end any.
_NAME = "CASE WHEN s_suppkey % 3 = 0 THEN trim(s_name) || chr(10) || 'x' WHEN s_suppkey % 5 = 0 THEN trim(s_name) || chr(8232) || 'y' ELSE trim(s_name) END"


def _written(t: Tables) -> str:
    """A folder with the suppliers as delimited files, as many as Spark has partitions of them."""
    path = materialize(t.supplier.select("s_suppkey"), "suppliers").inputFiles()[0].rsplit("/", 1)[0] + "-csv"
    key, name = F.col("s_suppkey"), F.trim("s_name")
    named = F.when(key % 3 == 0, F.concat(name, F.lit("\nx"))).when(key % 5 == 0, F.concat(name, F.lit("\u2028y"))).otherwise(name)
    rows = t.supplier.select(key.alias("Clave"), F.concat(F.lit(" "), named).alias("NOMBRE "), F.col("s_nationkey").alias("Nación"))
    rows.write.csv(path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col("cells")[k].alias(name) for k, name in (("clave", "clave"), ("nombre", "nombre"), ("nación", "nacion"))))


@query("s6_read_delimited", f"SELECT s_suppkey::VARCHAR AS clave, {_NAME} AS nombre, s_nationkey::VARCHAR AS nacion FROM supplier")
def _(t: Tables) -> DataFrame:
    return _named(files.read_delimited(files.scan_files(t.spark, _written(t))[0]))


@query("s6_read_delimited_folder", f"SELECT s_suppkey::VARCHAR AS clave, {_NAME} AS nombre, s_nationkey::VARCHAR AS nacion FROM supplier")
def _(t: Tables) -> DataFrame:
    return _named(files.read_delimited_folder(t.spark, _written(t)))


@query("load_files", rf"""
SELECT 'clave: ' || s_suppkey || ' | nombre: ' || regexp_replace({_NAME}, '[\n\x{{2028}}]', ' ') || ' | nación: ' || s_nationkey AS content, 'unknown_csv' AS kind, 'exact_only' AS policy FROM supplier""")
def _(t: Tables) -> DataFrame:
    out = load_files(t.spark, _written(t))
    return out.select(F.col("page_content").alias("content"), F.col("csv_kind").alias("kind"), F.col("dedup_policy").alias("policy"))


@query("s1_scan_files")
def _(t: Tables) -> DataFrame:
    found, _ = files.scan_files(t.spark, t.sf_dir, (".parquet",))
    return found.select("source", "file_hash")


@query("s2_with_file_hash", "SELECT doc_id, 'doc' || doc_id || '.txt' AS source, sha256(text) AS file_hash FROM documents")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.with_file_hash(rows).select("doc_id", "source", "file_hash")


@query("s3_decode_text", "SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'caf' || chr(233) || ' ' || lang FROM documents WHERE doc_id % 2 = 1")
def _(t: Tables) -> DataFrame:
    bom = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))
    latin = F.concat(F.encode(F.lit("caf"), "utf-8"), F.unhex(F.lit("E9")), F.encode(F.concat(F.lit(" "), "lang"), "utf-8"))
    return t.documents.select("doc_id", files.decode_text(F.when(F.col("doc_id") % 2 == 0, bom).otherwise(latin)).alias("text"))


#: Cells that begin with a quote, with a letter in place of what is quoted: delimiters and line ends that are left are those of the csv module.
_UNQUOTED = lambda text, c: rf"""regexp_replace({text}, '(^|[{c}\r\n])"(?:[^"]|"")*(?:"|$)', '\1Q', 'g')"""
_CHAR = {";": "chr(59)", ",": "chr(44)", "\\t": "chr(9)"}
_FIELDS = lambda line, c: f"len({line}) - len(replace({line}, {c}, '')) + 1"
_WIDTH = lambda c: f"list_distinct(list_transform(string_split({_UNQUOTED('first', c)}, chr(10)), lambda x: {_FIELDS('x', _CHAR[c])}))"
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


@query("s4_read_plain_text", rf"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\x{{feff}}', '') AS text FROM documents), h AS (SELECT *, array_to_string(list_slice(string_split(text, chr(10)), 1, 200), chr(10)) AS head FROM d),
l AS (SELECT *, array_to_string(list_slice(list_filter(string_split_regex(head, '\r\n|[\n\r\v\f\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: NOT regexp_full_match(x, '{_BLANK}')), 1, 5), chr(10)) AS first FROM h),
w AS (SELECT *, {", ".join(f"{_WIDTH(c)} AS {n}" for n, c in zip(("s", "c", "t"), _CHAR))} FROM l),
n AS (SELECT *, {", ".join(f"CASE WHEN len({n}) = 1 THEN {n}[1] ELSE 0 END AS n_{n}" for n in ("s", "c", "t"))} FROM w),
r AS (SELECT *, CASE WHEN n_t > 1 AND n_t >= greatest(n_s, n_c) THEN chr(9) WHEN n_c > 1 AND n_c >= n_s THEN chr(44) ELSE chr(59) END AS delimiter FROM n),
u AS (SELECT *, string_split_regex(CASE delimiter WHEN chr(9) THEN {_UNQUOTED("head", "\\t")} WHEN chr(44) THEN {_UNQUOTED("head", ",")} ELSE {_UNQUOTED("head", ";")} END, '\r\n|\r|\n') AS records FROM r)
SELECT 'd' || doc_id || '.md' AS source, text AS page_content FROM u
WHERE NOT coalesce(len(records) - (records[-1] = '')::INT > 50 AND records[1] <> '' AND {_FIELDS("records[1]", "delimiter")} >= 2, false)""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat(F.lit("/in/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.read_plain_text(files.with_file_hash(rows)).select("source", "page_content")


@query("s7_is_tabular", "SELECT o_custkey, count(*) > 50 AS tabular FROM (SELECT o_custkey % 10 AS o_custkey FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Each text has its first 60 lines, of which the operator looks at 51."""
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    rows = t.orders.select((F.col("o_custkey") % 10).alias("o_custkey"), line.alias("line"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("line"))).where("n <= 60")
    text = rows.groupBy("o_custkey").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("text"))
    return text.select("o_custkey", files.is_tabular(F.col("text")).alias("tabular"))


@query("s8_with_doc_ordinal", "SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_id FROM documents")
def _(t: Tables) -> DataFrame:
    return files.with_doc_ordinal(t.documents.withColumn("pos", F.col("doc_id")), "pos").select("source", "text", "doc_id")


@query("s9_export_chunks", f"WITH {CHUNKS} SELECT pos, page_content, len(v) AS dim FROM chunks")
def _(t: Tables) -> DataFrame:
    path = materialize(t.region, "export").inputFiles()[0].rsplit("/", 1)[0] + "-chunks"
    files.export_chunks(chunks(t), path)
    return files.load_chunks(t.spark, path).select("pos", "page_content", F.size("embedding").cast("long").alias("dim"))


@query("s10_write_audit", f"""
WITH {CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY source, entity_key ORDER BY pos) AS n FROM chunks WHERE dedup_policy = 'exact_key')
SELECT motivo, fuente, global_id FROM (SELECT 'dedup_clave' AS motivo, source AS fuente, pos AS global_id FROM k WHERE n > 1)""")
def _(t: Tables) -> DataFrame:
    path = materialize(t.region, "audit").inputFiles()[0].rsplit("/", 1)[0] + "-events"
    files.write_audit(dedup.deduplicate(chunks(t).where("dedup_policy = 'exact_key'")).events, path)
    return files.read_audit(t.spark, path, dedup.EVENT).select("motivo", "fuente", "global_id")


@query("s11_index_table", f"WITH {CHUNKS} SELECT count(*) FILTER (pos % 2 = 1) AS alive, count(*) AS total FROM chunks")
def _(t: Tables) -> DataFrame:
    """Rows of even places, then those of odd places appended."""
    rows = chunks(t).select(files.chunk_id(F.col("source"), F.col("pos")).alias("id"), "embedding", F.col("page_content").alias("document"), "doc_category", "dedup_policy", "pos")
    name = f"index_{uuid.uuid4().hex}"
    files.index_table(rows.where("pos % 2 = 0"), name)
    counts = files.index_table(rows.where("pos % 2 = 1"), name, recreate=False)
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame([counts], "alive long, total long")


@query("s12_load_records", """
SELECT doc_id AS pos, CASE doc_id % 4 WHEN 0 THEN source || doc_id WHEN 1 THEN lang || doc_id WHEN 2 THEN '' ELSE 'row_' || lpad(doc_id::VARCHAR, 8, '0') END AS id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE source END AS text,
    CASE doc_id % 2 WHEN 0 THEN doc_id::DOUBLE ELSE n_chars::DOUBLE END AS first, CASE WHEN doc_id % 4 = 1 THEN lang ELSE '' END AS source FROM documents""")
def _(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    key = lambda c: F.concat(c, i.cast("string"))
    raw = t.documents.select(
        i.alias("pos"), F.when(i % 4 == 0, key(F.col("source"))).when(i % 4 == 2, "").alias("chunk_id"), F.when(i % 4 == 1, F.create_map(F.lit("uid"), key(F.col("lang")), F.lit("fuente"), F.col("lang"))).alias("meta"),
        F.when(i % 3 == 0, F.col("text")).alias("document"), F.when(i % 3 < 2, F.col("lang")).alias("page_content"), F.col("source").alias("texto"),
        F.when(i % 2 == 0, F.array(i.cast("double"))).alias("values"), F.struct(F.array(F.col("n_chars").cast("double")).alias("vector")).alias("data"),
    )
    return files.load_records(raw).select("pos", "id", "text", F.col("embedding")[0].alias("first"), "source")


@query("s12_read_records", "SELECT doc_id AS pos, source || doc_id AS id, text FROM documents")
def _(t: Tables) -> DataFrame:
    """The table as lines of JSON in one folder, in order, read back with each row's place."""
    path = materialize(t.region, "records").inputFiles()[0].rsplit("/", 1)[0] + "-jsonl"
    rows = t.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.concat("source", F.col("doc_id").cast("string")).alias("uid"), F.col("text").alias("texto")).write.json(path)
    return files.load_records(files.read_records(t.spark, path)).select("pos", "id", "text")


@query("s13_long_form", "WITH s AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT source)::DOUBLE AS sources, max(length(text))::DOUBLE AS longest FROM documents) SELECT 'lengths' AS section, unnest(['n', 'sources', 'longest']) AS metric, unnest([n, sources, longest]) AS value FROM s")
def _(t: Tables) -> DataFrame:
    row = t.documents.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.max(F.length("text")).alias("longest"))
    return files.long_form(row, "lengths")


@query("s14_write_question_set", "SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, text FROM benchmark")
def _(t: Tables) -> DataFrame:
    path = materialize(t.region, "questions").inputFiles()[0].rsplit("/", 1)[0] + "-set"
    files.write_question_set(t.benchmark, path)
    files.write_question_set(t.benchmark.withColumn("item_id", F.col("item_id") + 1000000), path, append=True)
    return t.spark.read.schema(t.benchmark.schema).json(path)


@query("t17_chunk_id", f"WITH {CHUNKS} SELECT source || '::' || (row_number() OVER (ORDER BY source, pos) - 1) AS id, pos FROM chunks")
def _(t: Tables) -> DataFrame:
    rows = with_global_index(chunks(t).select("source", "pos"), "source", "pos", name="place")
    return rows.select(files.chunk_id(F.col("source"), F.col("place")).alias("id"), "pos")
