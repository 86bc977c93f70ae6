"""Files, containers, the index on disk, the stream and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.sources import files
from corpusloom.streaming.ingest import ingest, loads_per_hour
from tests.conftest import SF


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def root(tmp_path):
    (tmp_path / "sub/.hidden").mkdir(parents=True)
    (tmp_path / "a.DOCX").write_bytes(docx("One", "", "Two"))
    (tmp_path / "sub/b.md").write_text("# B\r\n", newline="")
    (tmp_path / "sub/c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "sub/.hidden/d.txt").write_text("no")
    (tmp_path / "e.pdf").write_text("no")
    return tmp_path


def test_files(spark, root):
    found = files.files(spark, str(root))
    got = {r.source: (r.text, r.error) for r in files.texts(found).collect()}
    assert got == {"a.DOCX": ("One\n\n\n\nTwo", None), "sub/b.md": ("# B\r\n", None), "sub/c.txt": (None, "UnicodeDecodeError")}
    m = files.manifest_of(found, ["sub/b.md"])
    assert {r.source for r in m.where("canonical").collect()} == {"sub/b.md"}
    entries = spark.createDataFrame([("a.DOCX",), ("../x.txt",), ("/etc/x.txt",), ("e.pdf",), ("gone.txt",), (None,)], "source string")
    assert {(r.source, r.reason) for r in files.refused_sources(entries, found).collect()} == {("../x.txt", "outside the root"), ("/etc/x.txt", "absolute path"), ("e.pdf", "unsupported kind"), ("gone.txt", "missing file"), (None, "no path")}


def test_containers(spark, tmp_path):
    m = spark.createDataFrame([("b", "s2", "h", True), ("a", "s1", "h", False)], "id string, source string, hash string, canonical boolean")
    path = str(tmp_path / "m.json")
    files.write_container(m, path, "manifest_version", "documents", ["source"])
    first = open(path).read()
    files.write_container(m.repartition(3), path, "manifest_version", "documents", ["source"])
    assert open(path).read() == first == json.dumps(json.loads(first), indent=2) + "\n"
    assert [r.id for r in files.container(spark, path, files.MANIFEST_SCHEMA, "documents").orderBy("position").collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        files.container(spark, str(tmp_path / "bad.json"), files.MANIFEST_SCHEMA, "documents")
    lines = str(tmp_path / "log")
    for _ in range(2):
        files.append_records(m, lines)
    assert spark.read.json(lines).count() == 4


def test_index_lifecycle(spark, tmp_path):
    v = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [3.0, 4.0])], "id string, v array<double>")
    identity = lambda n=2, model="m": spark.createDataFrame([(model, 2, n)], "model_id string, dimension long, vector_count long")
    path = str(tmp_path / "ix")
    state = lambda expected: files.resolve_index(spark, path, expected, lambda: v)[1]
    assert [state(identity()), state(identity()), state(identity(model="other")), state(identity(model="other"))] == ["rebuilt absent", "loaded", "rebuilt stale", "loaded"]
    assert [r.problem for r in files.load_index(spark, path)[2].collect()] == []
    files.save_index(v, identity(3), path)
    assert [r.problem for r in files.load_index(spark, path)[2].collect()] == ["vector_count"]


def test_stream_ingests_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    docs = spark.createDataFrame([("d1", "a\n\nb"), ("d2", "c")], "document_id string, text string")
    for _ in range(2):
        docs.limit(1).write.mode("append").parquet(src)
        ingest(spark.readStream.schema(docs.schema).parquet(src), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    hours = loads_per_hour(spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",)], "s string").select(F.to_timestamp("s").alias("loaded_at")))
    assert [r.n for r in hours.collect()] == [2]


def test_command_line(spark, capsys):
    question = spark.read.parquet(f"{SF}/resume_qa_pairs.parquet").where("question IS NOT NULL").first().question
    assert json.loads(cli.answer(spark, SF, question, 2))["outcome"] == "Answer"
    assert json.loads(cli.answer(spark, SF, "§§§", 2))["outcome"] == "Abstain"
    fused = json.loads(cli.answer(spark, SF, question, 3, route="fused"))
    lexical = json.loads(cli.answer(spark, SF, question, 1, route="lexical"))
    assert len(fused["statements"]) == 3 and lexical["statements"][0] in fused["statements"]
    with pytest.raises(SystemExit):
        cli.main(["--data", SF, "--question", " "])
