import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import delimited as D
from quern.operators.sampling import balanced_sample, parse_question_array
from quern.sources import delimited_text, digests, files
from quern.sources.tables import with_global_index


def write(path, name, content):
    (path / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path, "a.TXT", "﻿hola")
    write(tmp_path / "sub", "b.md", "café".encode("cp1252"))
    write(tmp_path, "c.md", b"x\x90\xe9")
    write(tmp_path, "d.exe", "no")
    found, ignored = files.scan_files(spark, str(tmp_path))
    text = {r.source: r.t for r in found.select("source", files.decode_text(F.col("content")).alias("t")).collect()}
    assert text == {"a.TXT": "hola", "b.md": "café", "c.md": "x\x90é"}
    assert ignored.count() == 1
    assert found.where("source = 'c.md'").first().file_hash == hashlib.sha256(b"x\x90\xe9").hexdigest()


def test_hashes_of_files_that_no_task_reads_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "LARGE", 20_000)
    monkeypatch.setattr(digests, "STEP", 16_384)
    (tmp_path / "a b").mkdir()
    noise = random.Random(5).randbytes(150_000)
    held = {"noise.md": noise, "cut.md": noise[:60_000] + b"\n", "long.txt": b"x" * 50_000, "marked.csv": b"\xef\xbb\xbfa;b\r\n" + b"1;2\r\n" * 9000, "marked.txt": b"\xef\xbb\xbf" + b"uno dos\n" * 6000 + b"fin", "small.md": noise[:900], "lines.txt": b"\n" * 30_000, "z.gz": gzip.compress(noise)}
    for name, content in held.items():
        write(tmp_path / "a b", name, content)
    settings = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.sources.binaryFile.maxLength": "20000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found, _ = files.scan_files(spark, str(tmp_path))
        got = {r.source: r.file_hash for r in found.select("source", "file_hash").collect()}
        assert got == {name: hashlib.sha256(content).hexdigest() for name, content in held.items() if name != "z.gz"}
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        found, _ = files.scan_files(spark, str(tmp_path), (".md", ".gz"))
        assert {r.source: (bytes(r.content), r.file_hash) for r in found.collect()} == {name: (content, hashlib.sha256(content).hexdigest()) for name, content in held.items() if name.endswith(("md", "gz"))}
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_read_delimited(spark, tmp_path):
    write(tmp_path, "t.csv", 'ID,x; Nombre ;ID\n1;" a ";2\n3;b\n4;c;5;6;7\n')
    found, _ = files.scan_files(spark, str(tmp_path))
    rows = [r.cells for r in files.read_delimited(found).orderBy("row").collect()]
    assert rows[0] == {"id": "2", "nombre": "a"} and rows[1] == {"id": "", "nombre": "b"} and rows[2] == {"id": "5", "nombre": "c", "col": "6"}


def plain_rows(text):
    import csv
    import io

    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimited_text.sniff_delimiter(text))
    names = [delimited_text.column_name(c) for c in next(rows, [])]
    return [dict(zip([*names, "col"], [c.strip() for c in cells] + [""] * (len(names) - len(cells)), strict=False)) for cells in rows if cells]


TRICKY = 'k;text;k2\r\n' + "".join(f'{i};"line {i}\nnext ""quoted"" \r\n; end";x{i}\r\n' if i % 3 else f'{i};a "b" c\u2028d\x0be;"y"z\n' for i in range(400)) + '\n\n"open;1;2\nstill open\n'


@pytest.mark.parametrize("size", [1, 40, 700, 1 << 20])
def test_chunks_of_delimited_files(spark, size):
    """Chunk edges inside quoted line ends, other line separators inside cells, blank lines, an open quote at the end."""
    texts = {"a.csv": TRICKY, "b.csv": "p,q\n1,2\n", "c.csv": "", "d.csv": "only;header\n", "e.csv": "\n;\n1;2\n", "f.csv": 'm;n\r1;"2\r3"\r4;5'}
    rows = [(name, "h" + name, text.encode()) for name, text in texts.items()] + [("g.csv", "hg", "añ;b\n1;ü\n".encode("cp1252")), ("h.csv", "hh", b"\xef\xbb\xbfid;x\n7;8\n")]
    found = spark.createDataFrame(rows, "source string, file_hash string, content binary")
    out = delimited_text.records(delimited_text.file_chunks(found, size), ["source", "file_hash"]).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.source, r.row)):
        got.setdefault(r.source, []).append(r.cells)
        assert r.row == len(got[r.source]) - 1 and (r.header is not None) == (r.row == 0)
    expected = {name: plain_rows(text) for name, text in texts.items()} | {"g.csv": [{"añ": "1", "b": "ü"}], "h.csv": [{"id": "7", "x": "8"}]}
    assert got == {name: rows for name, rows in expected.items() if rows}


def test_folder_of_delimited_files_in_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path, "in/big.csv", TRICKY)
    write(tmp_path, "in/x.CSV", "p,q\n1,2\n3,4\n")
    write(tmp_path, "in/no.txt", "p,q\n1,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        out = delimited_text.records(delimited_text.folder_chunks(spark, f"{tmp_path}/in", 300), ["path"])
        rows = sorted((r.path.rsplit("/", 1)[1], r.row, tuple(r.cells.items())) for r in out.collect())
        assert spark.read.text(f"{tmp_path}/in/big.csv", lineSep="\n").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [("big.csv", n, tuple(c.items())) for n, c in enumerate(plain_rows(TRICKY))] + [("x.CSV", n, tuple(c.items())) for n, c in enumerate(plain_rows("p,q\n1,2\n3,4\n"))]
    assert rows == sorted(expected)


def test_tabular_text(spark):
    rows = [("a;b\n" * 60,), ("a;b\n" * 20,), ("prose\n" * 60,), (None,)]
    out = spark.createDataFrame(rows, "t string").select(files.is_tabular(F.col("t")).alias("o")).collect()
    assert [r.o for r in out] == [True, False, False, False]


def table(spark, columns, n=5):
    return spark.createDataFrame([(i, *(f"{c}{i}" if c[0] != "#" else str(i) for c in columns)) for i in range(n)], ", ".join(["at int", *(f"`{c.lstrip('#')}` string" for c in columns)]))


@pytest.mark.parametrize(
    ("columns", "kind"),
    [(["pk", "nombre", "tipo"], "entity_table"), (["a", "b", "c"], "unknown_csv"), (["titulo", "descripcion"], "textual_table"), (["fecha", "x", "y", "#precio"], "time_series"), (["w", "x", "y", "#precio"], "fact_table")],
)
def test_kinds(spark, columns, kind):
    assert D.advise(D.profile_table(table(spark, columns), "new.csv", "at")).csv_kind == kind


def test_empty_table_is_unknown(spark):
    p = D.profile_table(table(spark, ["a", "b"]).limit(0), "new.csv", "at")
    assert p.n_rows == 0 and D.advise(p).csv_kind == "unknown_csv"


def test_recipe_needs_its_columns(spark):
    name = "210227-0-piscinas-publicas.csv"
    assert D.advise(D.profile_table(table(spark, ["pk", "x"]), name, "at")).confidence == 0.99
    assert D.advise(D.profile_table(table(spark, ["x", "y"]), name, "at")).confidence == 0.4


def test_transform(spark):
    docs = D.transform_table(table(spark, ["fecha", "x", "y", "#precio"]), "new.csv", "at")
    row = docs.orderBy("row").first()
    assert row.page_content == "Resumen del dataset new.csv.\nfecha: fecha0\nx: x0\ny: y0\n\n- precio: 0" and row.group_key == "fecha0|x0|y0" and row.group_size == 1


def test_global_index(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    assert all(r.place == r.k - 1 for r in with_global_index(df, "k", name="place").collect())


def test_index_table(spark):
    df = spark.createDataFrame([("a", [1.0], "t", None), ("b", [2.0], "u", "m")], "id string, embedding array<double>, document string, meta string")
    assert files.index_table(df, "ix_test") == (2, 2)
    assert {r.meta for r in spark.table("ix_test").collect()} == {"null", "m"}
    with pytest.raises(ValueError, match="unique"):
        files.index_table(df.union(df), "ix_test")
    more = spark.createDataFrame([("c", [1.0], "t", None)], df.schema)
    assert files.index_table(more, "ix_test", recreate=False) == (1, 3)
    spark.sql("DROP TABLE ix_test")


def test_sample_needs_rows(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", " ")], "pos long, source string, page_content string")
    with pytest.raises(ValueError, match="2 rows asked"):
        balanced_sample(df, 2, "s")


@pytest.mark.parametrize(("raw", "pairs"), [('[{"pregunta": "p", "respuesta_posible": "NO GENERADA"}, 3]', [("p", "")]), ('{"pregunta": "q", "respuesta_posible": "r"}', None), ('{"preguntas": [{"pregunta": "q"}]}', [("q", "")]), ("[]", [("", "")]), ("none", None)])
def test_question_array(spark, raw, pairs):
    out = spark.createDataFrame([(raw,)], "r string").select(parse_question_array(F.col("r"), 5).alias("p")).first().p
    assert (out and [tuple(p) for p in out]) == pairs


def test_records(spark, tmp_path):
    """Lists, wrapped lists, single objects and lines of JSON; aliases in their order, and values that are no text, no object or not there."""
    import json

    rows = [{"id": "a", "content": "low", "text": "high", "embedding": [1, 2]}, {"uid": 7, "texto": "t", "data": {"values": [3, 4]}, "meta": {"fuente": "f", "doc_id": "d"}}, {"text": "", "content": "not this", "metadata": {"chunk_id": "m", "source": "s", "categoria": "k"}}, {"page_content": None}]
    expected = [(0, "a", "high", [1.0, 2.0], "", "", ""), (1, "7", "t", [3.0, 4.0], "f", "d", ""), (2, "m", "", None, "s", "", "k"), (3, "row_00000003", "", None, "", "", "")]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"n": 4, "records": rows}))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("list.json", "wrapped.json", "lines.jsonl"):
        out = files.load_records(files.read_records(spark, f"file://{tmp_path}/{name}")).orderBy("pos").collect()
        assert [(r.pos, r.id, r.text, r.embedding, r.source, r.document_id, r.category) for r in out] == expected, name
    (tmp_path / "one.json").write_text(json.dumps(rows[0]))
    assert files.load_records(files.read_records(spark, f"file://{tmp_path}/one.json")).first().id == "a"


def test_vector_checks(spark):
    from quern.operators import evaluation as E

    rows = [("a", [3.0, 4.0], "t", "s", {"k": "v"}, 0), ("a", [0.0, 0.0], " ", "", None, 1), ("b", None, "", "", None, 2), ("b", [float("nan"), 1.0], "t", "s", {}, 3), ("c", [0.0, 2.0], "t", "s", {"k": "v"}, 4)]
    schema = "id string, embedding array<double>, text string, source string, metadata map<string,string>, pos long"
    df = spark.createDataFrame(rows, schema)
    r = E.validate_vectors(df).first()
    assert (r.n, r.n_valid, r.n_missing, r.dim, r.n_bad, r.n_zero, r.n_no_metadata, r.n_no_source, r.n_no_text, r.n_duplicate_ids) == (5, 4, 1, 2, 1, 1, 2, 1, 1, 1)
    assert (r.norm_min, r.norm_mean, r.norm_max, r.norm_p25, r.norm_p50, r.norm_p75) == (0.0, 2.0, 5.0, 0.75, 1.5, 2.75)
    assert [tuple(x) for x in E.dimension_distribution(df).collect()] == [(2, 4)] and [tuple(x) for x in E.duplicate_ids(df).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="different dimensions"):
        E.validate_vectors(df.union(spark.createDataFrame([("d", [1.0], "t", "s", None, 5)], schema))).collect()
    with pytest.raises(Exception, match="no record has a vector"):
        E.validate_vectors(df.where("embedding IS NULL")).collect()


def test_audit_of_a_source_minds_case(spark):
    from quern.operators.dedup import audit_sample

    df = spark.createDataFrame([("Source1", "dedup_coseno", 0.9, 1), ("source1", "dedup_coseno", 0.8, 2), ("source1", "dedup_clave", None, 3)], "fuente string, motivo string, sim double, global_id long")
    assert [r.global_id for r in audit_sample(df, "sour").collect()] == [2, 3] and [r.global_id for r in audit_sample(df, "Sour", "coseno", 5).collect()] == [1]


def test_load_files(spark, tmp_path):
    from quern.sources.loader import DOCUMENT, load_files

    (tmp_path / "sub").mkdir()
    (tmp_path / "note.md").write_bytes(b"caf\xe9 with \x93quotes\x94\nsecond line")
    (tmp_path / "sub" / "table.txt").write_text("Codigo_temporada,b,b\n" + "".join(f"1,x{i}, y{i} \n" for i in range(60)))
    (tmp_path / "short.txt").write_text("a;b\n1;2\n")
    (tmp_path / "areas.csv").write_text("\ufeffID-NOMBRE;Direccion;Tipo\n" + "".join(f"n{i};street {i};t{i % 2}\n" for i in range(12)))
    (tmp_path / "facts.csv").write_text("mes;centro;clase;precio\n" + "".join(f"m{i % 2};c{i % 3};k;{i}\n" for i in range(12)) + "m0;c0;k;1;extra\n")
    (tmp_path / "empty.csv").write_text("a;b\n")
    (tmp_path / "other.bin").write_bytes(b"x")
    out = load_files(spark, f"file://{tmp_path}")
    assert out.columns == [c.split()[0] for c in DOCUMENT.split(", ")]
    by = {}
    for r in out.orderBy("source", "doc_id").collect():
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"note.md", "table.txt", "short.txt", "areas.csv", "facts.csv"}
    assert all([r.doc_id for r in rows] == list(range(len(rows))) and len({r.file_hash for r in rows}) == 1 for rows in by.values())
    assert by["note.md"][0].page_content == "café with “quotes”\nsecond line" and by["short.txt"][0].page_content == "a;b\n1;2\n"
    assert len(by["table.txt"]) == 60 and by["table.txt"][3].page_content == "codigo_temporada: 1 | b: y3" and (by["table.txt"][3].csv_kind, by["table.txt"][3].dedup_policy) == ("tabular_txt", "exact_only")
    assert len(by["areas.csv"]) == 12 and by["areas.csv"][5].page_content == "id-nombre: n5 | direccion: street 5 | tipo: t1"
    assert {r.csv_kind for r in by["areas.csv"]} == {"entity_table"} and by["areas.csv"][5].entity_key == "n5"
    assert {r.csv_kind for r in by["facts.csv"]} <= {"fact_table", "time_series"} and sum(r.group_size for r in by["facts.csv"]) == 13 and all(r.is_aggregated for r in by["facts.csv"])
    assert load_files(spark, f"file://{tmp_path}/sub").count() == 60


def test_jobs_of_a_load_dont_follow_the_files(spark, tmp_path):
    from quern.sources.loader import load_files

    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        (tmp_path / f"{n}").mkdir()
        for i in range(n):
            columns = (("pk", "nombre", "tipo"), ("a", "b", "c"), ("fecha", "x", "y", "precio"))[i % 3]
            write(tmp_path / f"{n}", f"f{i}.csv", ";".join(columns) + "\n" + "".join(";".join(f"{c}{k % 4}" if c != "precio" else str(k) for c in columns) + "\n" for k in range(6)))
        spark.sparkContext.setJobGroup(f"load-{n}", "")
        rows = load_files(spark, f"{tmp_path}/{n}").collect()
        made = len(tracker.getJobIdsForGroup(f"load-{n}"))
        spark.sparkContext.setJobGroup("other", "")
        kinds = {r.csv_kind for r in rows}
        assert kinds == {"entity_table", "unknown_csv", "time_series"} and len({r.source for r in rows}) == n
        return made

    few, many = jobs(3), jobs(60)
    assert many <= few + 8


def test_ordinals_spread_a_hot_source(spark):
    from quern.sources import tables

    rows = [(None if i % 20 == 0 else "b" if i % 20 == 1 else "hot", (i * 7919) % 2000, f"t{i}") for i in range(2000)] + [("hot", 5, "again")]
    df = spark.createDataFrame(rows, "source string, pos int, text string").repartition(6)
    got = {(r.source, r.pos, r.text): r.doc_id for r in files.with_doc_ordinal(df, "pos").collect()}
    for source in (None, "b", "hot"):
        own = sorted((p, t) for s, p, t in rows if s == source)
        assert sorted(got[(source, p, t)] for p, t in own) == list(range(len(own)))
        assert all(abs(got[(source, p, t)] - n) <= 1 for n, (p, t) in enumerate(own))
    placed = tables.with_global_index(df.select("source", "pos").withColumn("part", F.spark_partition_id()), "source", "pos")
    parts = placed.where("source = 'hot'").withColumn("task", F.floor(F.col("index") / 600)).select("task").distinct().count()
    assert parts > 1


def test_quantiles_of_mostly_equal_values(spark):
    import numpy as np

    from quern.operators import metrics

    rng = np.random.default_rng(7)
    values = np.concatenate([np.zeros(9000), rng.normal(size=900), [1e308, -1e308, 1e-300, 5e-324]])
    rows = [(float(x), "all" if i % 3 else None) for i, x in enumerate(values)] + [(None, "all"), (float("nan"), "all"), (float("inf"), None)]
    df = spark.createDataFrame(rows, "v double, g string").repartition(5)
    cuts = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p97": 0.97, "p100": 1.0}
    plain = lambda xs: [np.quantile(xs / 4, q) * 4 for q in cuts.values()]
    assert list(metrics.quantiles(df, "v", cuts).first()) == pytest.approx(plain(values), rel=1e-12)
    got = {r.g: r for r in metrics.quantiles(df, "v", cuts, "g").collect()}
    for g in ("all", None):
        assert [got[g][c] for c in cuts] == pytest.approx(plain(np.array([v for v, k in rows if k == g and v is not None and np.isfinite(v)])), rel=1e-12)


def test_sql_of_plain_text_leaves_out_tables():
    """The SQL of s4_read_plain_text has the operator's rule: quoted line ends and delimiters, blank lines, CR, three delimiters."""
    import duckdb
    import pandas as pd

    from quern.queries.tables import ORACLE_SQL
    from quern.sources.files import HEAD_LINES, _is_table

    texts = ["", "plain", "a,b\n" * 50, "a,b\n" * 51, "a;b\r\n" * 60, "a\tb\r" * 60, "\n" + "a;b\n" * 60, "a;b,c\n" * 60, "a,b\n" + "word\n" * 60, '"x;y"\n' * 60, '"x;y";z\n' * 60, 'a;"b\nc"\n' * 40, 'a;"b\nc"\n' * 60, 'q;"open\n' + "a;b\n" * 60, "a;b\n\n" * 30, 'a;"b""c"d;e\n' * 55]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    kept = {r[0] for r in con.execute(ORACLE_SQL["s4_read_plain_text"]).fetchall()}
    assert kept == {f"d{i}.md" for i, t in enumerate(texts) if not _is_table("\n".join(t.split("\n")[:HEAD_LINES]))}
    assert 3 < len(kept) < len(texts) - 3
