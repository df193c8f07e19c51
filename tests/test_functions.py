"""Hand-worked cases of the text, page, query and geometry functions, and of the store."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import pages as g
from foliant.functions import query as q
from foliant.functions import scoring as s
from foliant.functions import text as t
from foliant.functions.dialect import DUCK, SPARK
from foliant.operators.geometry import merge_rects
from foliant.sources import store


@pytest.fixture(params=["spark", "duck"])
def value(request, spark):
    import duckdb

    con = duckdb.connect()

    def of(function, *args):
        if request.param == "spark":
            return spark.sql("SELECT " + function(SPARK, *(a(SPARK) if callable(a) else SPARK.lit(a) for a in args))).first()[0]
        out = con.sql("SELECT " + function(DUCK, *(a(DUCK) if callable(a) else DUCK.lit(a) for a in args))).fetchall()[0][0]
        return out

    return of


def words(*items):
    return lambda d: d.words(items) if items else d.none()


@pytest.mark.parametrize(("x", "want"), [("policies", "policy"), ("processes", "process"), ("does", "doe"), ("rules", "rul"), ("is", "is"), ("gas", "gas"), ("cats", "cat")])
def test_stem(value, x, want):
    assert value(t.stem, x) == want


def test_sentences_and_statements(value):
    assert value(t.sentences, " One. two; Three: Four  five:six! ") == ["One", "two", "Three", "Four five:six!"]
    assert value(t.statements, "Too short. This one is long enough; and this one too") == ["This one is long enough", "and this one too"]
    assert value(t.sentences, "") == []


def test_cells_and_bullets(value):
    assert value(t.table_cells, "a | - | : b -|==|") == ["a", "b"]
    assert value(t.table_cells, "one  two   three four") == ["one", "two", "three four"]
    assert value(t.bullets, "- first \nno\n  • second") == ["first", "second"]


def test_points(value):
    assert value(t.point, "3.1 Manager: approve the request today. Then rest") == "Manager: approve the request today"
    assert value(t.point, "Manager: Approve it") == "Manager"
    assert value(lambda d, x: t.point(d, x, 3), "one two three four five") == "one two three..."


def test_predicates(value):
    assert value(t.is_useful, "Approve the request") and not value(t.is_useful, "short") and not value(t.is_useful, "see the workflow -> there")
    assert not value(t.is_useful, "1234567890 ---- 12") and not value(t.is_useful, "Estimation time in total: 5 minutes")
    assert value(g.is_contents, "x\n toc \ny") and value(g.is_contents, "A ..... 12\nb") and not value(g.is_contents, "tocs")
    assert value(g.is_front_matter, "Author: x. Approved by y") and value(g.is_front_matter, "owner, effective date, document status")
    assert not value(g.is_front_matter, "owner and status" + " x" * 1300)
    assert value(g.is_version_history, "Version, update, description") and not value(g.is_version_history, "version only")


def test_sections(value):
    page = "Intro 1.1 Adding Users NO ACTION do it\n2.3 Other Part  Estimation time in total: 4 rest v3.4 Not This NO ACTION"
    assert value(g.sections, page) == ["1.1 Adding Users NO ACTION do it", "2.3 Other Part  Estimation time in total: 4 rest v3.4 Not This NO ACTION"]
    assert value(g.section_title, "1.1 Adding Users NO ACTION do it") == "1.1 Adding Users"
    assert value(g.contents_entries, "Contents\n1.1 One .... 3\n1.2 Two  b .. 5\n2 Chapter\n2.1 Three ... 7") == ["1.1\tOne\t3", "2.1\tThree\t7"]
    assert value(g.headings, "1.1 Top\ntext\n1.1  top\n1.1 Top \n2.2 Next") == ["1.1 Top", "2.2 Next"]
    assert value(g.without_header, "Head\nA\nB\nbody Head\nbody") == "body"
    assert value(g.without_header, "two\nlines") == "two\nlines"


def test_query(value):
    assert value(q.terms, "How does the resource process?") == ["doe", "resource", "proces"]
    assert value(q.terms, "how to") == ["how", "to"]
    assert value(q.phrases, "Add new record now") == ["add new record now", "add new record", "new record now", "add new", "new record", "record now"]
    assert value(q.expand, words("record")) == ["record", "rr"]
    assert value(q.action, words("remove", "edit")) == "edit"


def test_scores(value):
    terms = words("add", "record")
    assert value(s.dominance, "Adding records: add", terms) == 16 + 22
    assert value(s.phrase_match, "we add record here", terms, words("add record")) == 12
    assert value(s.phrase_match, "we add record here", terms, words()) == 8
    assert value(s.intent_penalty, words("after", "delete", "add"), words("edit")) == 8 + 3 + 12
    assert value(s.title_boost, "1.2.3 Add record", terms) == 2 * 4 + 6 + 2 * 2


def test_rectangles(spark):
    boxes = [(0, 0, 10, 10), (22, 3, 30, 12), (43, 0, 50, 10), (0, 40, 5, 50)]
    df = spark.createDataFrame([(1, *map(float, b)) for b in boxes], "k int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in merge_rects(df, ["k"]).collect()) == [(0, 0, 30, 12), (0, 40, 5, 50), (43, 0, 50, 10)]


def test_estimates_over_line_ends(value):
    assert value(t.without_estimates, "Do it.\nEstimation time\n: 5 min\nThen rest.") == "Do it.\n\nThen rest."
    assert value(t.without_estimates, "Estimation time in\ntotal :\n9 min\nThen rest.") == "Then rest."


def test_store(spark, tmp_path):
    table = str(tmp_path / "kb")
    assert not store.has_documents(spark, table, "a")
    files = tmp_path / "in"
    files.mkdir()
    (files / "x.md").write_text("hello")
    (files / "y.PDF").write_bytes(b"one|two")
    pages = store.load(spark, str(files), "a", lambda body: body.decode().split("|"))
    store.replace_workspaces(pages.unionByName(pages.withColumn("workspace_id", F.lit("b"))), table)
    assert sorted((r.source, r.page, r.text) for r in store.fetch_source(spark, table, "a", "y.PDF").collect()) == [("y.PDF", 0, "one"), ("y.PDF", 1, "two")]
    store.replace_workspaces(pages.where("source = 'x.md'"), table)
    assert spark.read.parquet(table).groupBy("workspace_id").count().orderBy("workspace_id").collect() == [("a", 1), ("b", 3)]
    assert store.clear_workspace(spark, table, "a") and not store.has_documents(spark, table, "a") and store.has_documents(spark, table, "b")
    (files / "z.exe").write_bytes(b"")
    with pytest.raises(Exception, match="Unsupported file type"):
        store.load(spark, str(files), "a").count()
