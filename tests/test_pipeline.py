import json

from siltstone import __main__ as cli
from siltstone import schemas
from siltstone.config import ChunkConfig, Config, SearchConfig, Source
from siltstone.operators.answer import stub_generator
from siltstone.plans import pipeline
from siltstone.streaming.ingest import page_chunks, stream_chunks, stream_pages


def _config():
    return Config(sources=tuple(Source(f"s{i}", f"u:{i}", "p", True) for i in range(4)), search=SearchConfig(2, 0.2))


def _getter():
    def page(url):  # inside a function, so that workers get its code and need no test module
        if url == "u:3":
            raise OSError
        return f"<nav>menu</nav><p>{' '.join(f'topic{url[-1]} word{j}' for j in range(120))}</p>"

    return page


def test_pipeline_end_to_end(spark, tmp_path):
    root, config = f"file://{tmp_path}", _config()
    pipeline.run_pipeline(spark, config, root, _getter())
    lines = pipeline.run_pipeline(spark, config, root, _getter())
    assert any("chunk_size_drift_pct" in x for x in lines) and any("fetch_failures" in x and "1" in x for x in lines)
    chunks, vectors = spark.read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/vectors")
    assert sorted(r.chunk_id for r in chunks.collect()) == list(range(1, chunks.count() + 1)) and vectors.count() == chunks.count()
    questions = spark.createDataFrame([(1, "topic1 topic1 topic1"), (2, "zzz qqq")], "query_id bigint, query string")
    answers = pipeline.answer_questions(spark, questions, root, config, stub_generator)
    got = {r.query_id: r for r in answers.collect()}
    assert got[1].sources == ["s1"] and not got[1].fallback and got[2].fallback
    assert pipeline.query_metrics(answers).count() == 2
    logged = pipeline.ask_and_log(spark, questions, root, config, stub_generator)
    assert logged.count() == 2 and spark.read.parquet(f"{root}/query_metrics").count() == 2
    documents = spark.read.parquet(f"{root}/document_table")
    assert documents.columns == schemas.DOCUMENTS.names and {r.purpose for r in vectors.collect()} == {"p"}
    assert [(r.id, r.source) for r in documents.orderBy("id").collect()] == [(1, "s0"), (2, "s1"), (3, "s2")]


def test_command_line_and_evaluation_set(spark, tmp_path, capsys, caplog):
    root, config = f"file://{tmp_path}", _config()
    pipeline.run_pipeline(spark, config, root, _getter())
    labels = [{"query": "topic1 topic1", "expected_source": "s1", "expected_text_fragment": "topic1 word3"}, {"query": "topic2 topic2", "expected_source": "s0"}]
    (tmp_path / "set.json").write_text(json.dumps(labels))
    (tmp_path / "config.json").write_text(json.dumps({"query": {"confidence_threshold": 0.2}, "chunking": {"chunk_size": 200}, "monitoring": {"chunk_drift_threshold_pct": 5}}))
    run = lambda *a: cli.main(["--root", root, "--config", str(tmp_path / "config.json"), "--log", str(tmp_path / "log.txt"), *a])
    assert run("evaluate", f"file://{tmp_path}/set.json") == 0
    said = capsys.readouterr().out
    assert "Precision@1          50.0%" in said and "MISS topic2 topic2: expected s0, got s2" in said and "Queries              2" in said
    assert run("ask", "topic1 topic1") == 0 and "[s1]" in capsys.readouterr().out
    assert run("search", "topic2 topic2") == 0 and "1. " in capsys.readouterr().out
    assert run("chunk") == 0 and "mean chunk length moved" in caplog.text
    assert run("report") == 0 and "chunk_size_drift_pct" in capsys.readouterr().out
    assert "report done" in (tmp_path / "log.txt").read_text()


def test_folders_fill_the_tables(spark, tmp_path, caplog):
    """HTML files, processed and chunked JSON (a file each, a list, or lines) take the place of what their sources had."""
    caplog.set_level("INFO", "siltstone")
    root, config = f"file://{tmp_path}/root", _config()
    run = lambda *a: cli.main(["--root", root, *a])
    (tmp_path / "html").mkdir()
    for i in (0, 2):
        (tmp_path / "html" / f"s{i}.html").write_text(_getter()(f"u:{i}").replace("</nav>", "</nav>\n\n"))
    (tmp_path / "html" / "other.txt").write_text("no page")
    assert run("import-html", f"file://{tmp_path}/html") == 0
    assert {(r.source, r.raw_filename) for r in spark.read.parquet(f"{root}/raw").collect()} == {("s0", "s0.html"), ("s2", "s2.html")}
    pipeline.run_transform(spark, config, root)
    for i in (0, 2):
        pipeline.run_chunk(spark, config, root)
    assert run("export-processed", f"file://{tmp_path}/processed") == 0 and run("export-chunked", f"file://{tmp_path}/chunked") == 0
    one = json.loads(next(x for p in (tmp_path / "chunked").glob("part-*") for x in p.read_text().splitlines()))
    one["chunks"] = one["chunks"][:1]
    fresh = f"file://{tmp_path}/fresh"
    pipeline.run_import(spark, fresh, "processed", f"file://{tmp_path}/processed")
    pipeline.run_import(spark, fresh, "chunked", f"file://{tmp_path}/chunked")
    same = lambda name, *c: sorted(map(repr, spark.read.parquet(f"{root}/{name}").select(*c).collect())) == sorted(map(repr, spark.read.parquet(f"{fresh}/{name}").select(*c).collect()))
    assert same("documents", "text", "metadata") and same("chunked", "source", "purpose", "full_text_length", "chunk_config", "chunks")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "more" / "b.json").write_text(json.dumps([one | {"source": "new", "purpose": None}, one | {"source": None}]))
    pipeline.run_import(spark, fresh, "chunked", f"file://{tmp_path}/more")
    got = {r.source: (r.purpose, len(r.chunks)) for r in spark.read.parquet(f"{fresh}/chunked").collect()}
    assert got[one["source"]] == ("p", 1) and got["new"] == ("unknown", 1) and len(got) == 3
    pipeline.run_load(spark, config, fresh)
    assert spark.read.parquet(f"{fresh}/document_table").count() == 3
    assert "import_chunked starts" in caplog.text and "2 in, 2 out" in caplog.text


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(f"s{i}", _getter()(f"u:{i}")) for i in range(3)], "source string, html string")
    pages.repartition(3).write.parquet(f"file://{tmp_path}/in")
    config = Config(chunk=ChunkConfig(200, 40, 20))
    stream = stream_pages(spark, f"file://{tmp_path}/in", pages.schema)
    stream_chunks(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", config).awaitTermination()
    batch = page_chunks(pages, config)
    got = spark.read.parquet(f"file://{tmp_path}/out").select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 0
