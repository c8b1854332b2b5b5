"""Readers, writers and the incremental run, each over files of its own."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexspan.binding import chapters
from lexspan.operators import judge
from lexspan.sources import readers, writers
from lexspan.streaming import incremental
from tests.conftest import DATA

SRC = "\\id GEN Test\n\\h Gen\n\\c 1\n\\p\n\\v 1 one & two\n\\v 2-3 \\add x\\add* <y>\n\\s1 Head\n\\q1\n\\v 4 four\n"


def book(spark):
    return spark.createDataFrame([("GEN", SRC)], "book string, src string")


def test_marked_books(spark, tmp_path):
    (tmp_path / "01.usfm").write_text(SRC)
    (tmp_path / "02.SFM").write_text("\\id exo\n\\c 1\n")
    (tmp_path / "03.txt").write_text("no")
    got = {r.book: r.src for r in readers.marked_books(spark, str(tmp_path), "c").collect()}
    assert got == {"GEN": SRC, "EXO": "\\id exo\n\\c 1\n"}


def test_verse_lines_go_out_and_in(spark, tmp_path):
    writers.write_verse_lines(book(spark), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "book=GEN").glob("part*")
    assert file.read_text() == "GEN 1:1\tone & two\nGEN 1:2\tx <y>\nGEN 1:3\t<range>\nGEN 1:4\tfour\n"
    (tmp_path / "in.tsv").write_text(file.read_text() + "junk\n")
    got = {(r.book, r.first, r.last, r.text) for r in readers.verse_lines(spark, str(tmp_path / "in.tsv")).collect()}
    assert got == {("GEN", 1, 1, "one & two"), ("GEN", 2, 3, "x <y>"), ("GEN", 4, 4, "four"), (None, None, None, "junk")}


def test_chunks(spark, tmp_path):
    for name, text in (("front/title", "Genesis"), ("01/01", "\\v 1 a"), ("01/03", "\\v 3 b"), ("01/title", "Start"), ("02/01", " "), ("10/01", "\\v 1 z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.txt").write_text(text)
    chunks = readers.chunk_tree(spark, str(tmp_path))
    assert readers.stitched(chunks, "GEN").collect()[0].src == "\\id GEN\n\\h Genesis\n\\c 1\n\\s1 Start\n\\p\n\\v 1 a\n\\p\n\\v 3 b\n\\c 10\n\\p\n\\v 1 z\n"


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "x", "n": "many", "list": [1]}))
    (tmp_path / "b.json").write_text("{nope")
    docs = readers.manifests(spark, str(tmp_path))
    assert {r.path[-6:]: r.problem for r in docs.select("path", "problem").collect()} == {"a.json": None, "b.json": "not-json"}
    (r,) = readers.manifest_fields(docs.filter("problem IS NULL"), {"id": ("$.id", "string"), "n": ("$.n", "int"), "gone": ("$.gone", "string"), "first": ("$.list[0]", "int")}).collect()
    assert (r.id, r.n, r.gone, r.first) == ("x", None, None, 1) and sorted(r.problems) == ["missing gone", "not int: n"]


def test_schemes(spark, tmp_path):
    (tmp_path / "eng.vrs").write_text("# comment\nGEN 1:31 2:25\nPSA 13:6\nGEN 31:55 = GEN 32:1\nPSA 13:5-6 = PSA 13:6\nGEN 32:1-32 = GEN 32:2-33\nX 1:1 = 2\n")
    counts, lines = readers.schemes(spark, str(tmp_path))
    assert {tuple(r) for r in counts.collect()} == {("eng", "GEN", 1, 31), ("eng", "GEN", 2, 25), ("eng", "PSA", 13, 6)}
    assert {(r.from_book, r.from_verse, r.to_verse, r.len, r["shape"]) for r in lines.collect()} == {("GEN", 55, 1, 1, "Parallel"), ("PSA", 5, 6, 2, "Merge"), ("GEN", 1, 2, 32, "Parallel")}


def test_word_processor_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Creation", "Heading1")}{p("1")}{p("1 In the beginning. 2 And then. In 1999 no.")}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(blob.getvalue())
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    paragraphs = readers.document_paragraphs(spark, str(tmp_path))
    assert paragraphs.filter("at < 0").count() == 1
    assert readers.guessed_markup(paragraphs).collect()[0].src == "\\s1 Creation\n\\c 1\n\\p\n\\v 1 In the beginning. \\v 2 And then. In 1999 no.\n"


def test_exports_are_well_formed(spark):
    b = book(spark)
    usx = ElementTree.fromstring(writers.usx(b).collect()[0].usx)
    assert [v.get("number") for v in usx.iter("verse")] == ["1", "2-3", "4"] and [c.text for c in usx.iter("char")] == ["x"]
    assert "one &amp; two" in writers.html(b).collect()[0].html
    usj = json.loads(writers.usj(b).collect()[0].usj)
    assert usj["type"] == "USJ" and [x["number"] for x in usj["content"] if x["type"] == "verse"] == ["1", "2-3", "4"]


def test_exports_of_every_book_are_well_formed(spark):
    from lexspan.plans.versions import noted

    for r in writers.usx(noted(spark, DATA)).limit(80).collect():
        ElementTree.fromstring(r.usx)


def test_findings_are_written_by_corpus(spark, tmp_path):
    found = judge.placement(chapters(spark, DATA))
    writers.write_findings(found, str(tmp_path / "f"), "glyph")
    assert spark.read.parquet(str(tmp_path / "f")).count() == found.count()


def test_incremental_is_cold(spark, tmp_path):
    """Books arrive in batches, some twice, some changed, one removed; after each batch the claims are a cold run's."""
    texts = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()}
    batches = [{i: texts[i] for i in list(texts)[:30]}, {i: texts[i] for i in list(texts)[25:60]}, {i: (lang, t.replace(",", " ,")) for i, (lang, t) in list(texts.items())[:8]}, {list(texts)[9]: (texts[list(texts)[9]][0], None)}]
    (tmp_path / "in").mkdir()
    schema = "corpus string, book string, text string"
    state, held = incremental.BookState(spark, f"file://{tmp_path}/state"), {}
    for batch in batches:
        spark.createDataFrame([(lang, str(i), t) for i, (lang, t) in batch.items()], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
        incremental.follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), state, str(tmp_path / "check")).awaitTermination()
        held |= batch
        cold = spark.createDataFrame([(lang, str(i), t) for i, (lang, t) in held.items() if t is not None], schema).withColumn("chapter", F.lit(0))
        want = {tuple(r) for r in judge.placement(cold.select("corpus", "book", "chapter", "text")).collect()}
        assert {tuple(r) for r in incremental.judged(state.current()).collect()} == want
    assert len(state._versions()) == len(batches)
    again = spark.createDataFrame([(lang, str(i), t) for i, (lang, t) in held.items()], schema)
    before = state.current().count()
    state.upsert(again, 99)  # nothing new: nothing is counted again
    assert state.current().count() == before


def test_only_touched_buckets_are_written(spark, tmp_path):
    from lexspan.streaming.incremental import BookState, bucket

    state = BookState(spark, str(tmp_path / "state"), buckets=8)
    first = spark.createDataFrame([("en", f"b{i}", f"text, {i}.") for i in range(30)], "corpus string, book string, text string")
    state.upsert(first, 1)
    state.upsert(spark.createDataFrame([("en", "b3", None), ("en", "b4", "new; text")], first.schema), 2)
    own = {r[0] for r in first.filter("book IN ('b3', 'b4')").select(bucket(8)).collect()}
    assert {int(p.name.partition("=")[2]) for p in (tmp_path / "state" / "2").glob("bucket=*")} == own
    assert {r.book for r in state.current().select("book").distinct().collect()} == {f"b{i}" for i in range(30)} - {"b3"}
    state.upsert(spark.createDataFrame([("en", "b4", "new; text")], first.schema), 3)
    state.upsert(spark.createDataFrame([("en", "b4", "newer: text")], first.schema), 4)
    assert {r.glyph for r in state.current().filter("book = 'b4'").collect()} == {":"}
    assert not list((tmp_path / "state" / "2").glob(f"bucket={[r[0] for r in first.filter("book = 'b4'").select(bucket(8)).collect()][0]}"))


def test_keyed_store(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexspan.streaming.keyed import KeyedStore, key_of

    store, asked = KeyedStore(spark, str(tmp_path / "store")), []

    def compute(fresh):
        rows = fresh.collect()
        asked.append(sorted(r.text for r in rows if r.text is not None))
        return spark.createDataFrame([(r.key, w) for r in rows for w in (r.text or "").split()], "key string, word string")

    def ask(texts, generation, version=1):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", key_of(version, F.col("text")))
        return sorted(r.word for r in store.resolve(docs, compute, generation).collect())

    assert ask(["a b", "c", "", None, "c"], 1) == ["a", "b", "c"] and asked[-1] == ["", "a b", "c"]
    assert ask(["a b", "d", ""], 2) == ["a", "b", "d"] and asked[-1] == ["d"]
    assert ask(["a b", "d", ""], 2) == ["a", "b", "d"] and asked[-1] == ["d"]  # a generation run again
    assert ask(["a b"], 3, version=2) == ["a", "b"] and asked[-1] == ["a b"]
    store.sweep(3, keep=2)
    assert ask(["c", "d", "a b"], 5) == ["a", "b", "c", "d"] and asked[-1] == ["c"]
    store.sweep(5, keep=9, budget=2)
    assert store.rows().count() <= 4


def test_yaml():
    from lexspan.sources.yaml import parse

    text = """# a manifest
---
dublin_core:
  type: 'bundle'
  title: "A \\"title\\""   # a comment
  version: 4.1
  issued: 2017-06-12
  count: 12
  flags: [one, 'two, three', {a: 1, b: [2]}]
  url: http://x.org/a#b
  empty:
  language: {identifier: en, direction: ltr}
  relation:
  - 'en/tq'
  - "en/tn?v=4"
projects:
  -
    title: 'Genesis '
    sort: 1
    categories: [ 'bible-ot' ]
  - title: Exodus
    sort: 2
    nested:
      - - 1
        - ~
note: |
  two
   lines

folded: >-
  one
  line
ok: true
ok: false
"""
    doc = parse(text)
    core = doc["dublin_core"]
    assert core == {"type": "bundle", "title": 'A "title"', "version": 4.1, "issued": "2017-06-12", "count": 12, "flags": ["one", "two, three", {"a": 1, "b": [2]}], "url": "http://x.org/a#b", "empty": None, "language": {"identifier": "en", "direction": "ltr"}, "relation": ["en/tq", "en/tn?v=4"]}
    assert doc["projects"] == [{"title": "Genesis ", "sort": 1, "categories": ["bible-ot"]}, {"title": "Exodus", "sort": 2, "nested": [[1, None]]}]
    assert (doc["note"], doc["folded"], doc["ok"]) == ("two\n lines\n", "one line", False) and list(doc) == ["dublin_core", "projects", "note", "folded", "ok"]
    assert parse("") is None and parse("# x\n---\na: 1\n---\nb: 2\n") == {"a": 1} and parse("- 1\n- x: y\n  z: [ ]\n") == [1, {"x": "y", "z": []}]
    for bad in ("a: &x 1", "a: *x", "a: [1", "a: 1\n   b: 2\n c: 3", "\ta: 1", "a: 'x"):
        with pytest.raises(ValueError):
            parse(bad)


def test_yaml_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.yaml").write_text("core:\n  title: Titus\n  version: 3\n")
    (tmp_path / "m" / "broken.yml").write_text("a: [1\n")
    docs = readers.yaml_manifests(spark, str(tmp_path / "m"))
    problems = {r.path.rpartition("/")[2]: r.problem for r in docs.select("path", "problem").collect()}
    assert problems["manifest.yaml"] is None and problems["broken.yml"].startswith("not-yaml")
    got = readers.manifest_fields(docs.filter("problem IS NULL"), {"title": ("$.core.title", "string"), "version": ("$.core.version", "int"), "none": ("$.core.none", "string")}).collect()
    assert [(r.title, r.version, r.problems) for r in got] == [("Titus", 3, ["missing none"])]


def test_documents_go_out_and_in(spark, tmp_path):
    """Exported word-processor files are read back paragraph by paragraph."""
    (tmp_path / "out").mkdir()
    rows = {r.book: r.content for r in writers.docx(book(spark)).collect()}
    assert rows == {r.book: r.content for r in writers.docx(book(spark)).collect()}
    (tmp_path / "out" / "GEN.docx").write_bytes(rows["GEN"])
    got = [(r.style, r.text) for r in readers.document_paragraphs(spark, str(tmp_path / "out")).orderBy("at").collect() if r.text]
    assert got == [("id", "GEN Test"), ("h", "Gen"), ("c", "1"), ("p", "1one & two2-3x <y>"), ("s1", "Head"), ("q1", "4four")]
