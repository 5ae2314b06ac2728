import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheetspark.operators.schema import Field, Schema
from sheetspark.plans.reader import read, read_bytes, read_sheets
from sheetspark.plans.writer import SKIP, Handler, Workbook, save, workbooks, write
from sheetspark.sinks import xlsx as out
from sheetspark.sinks.template import Template, append
from sheetspark.sources import csv, decode, xlsx
from sheetspark.streaming import directory, listeners


def test_cells_of_all_kinds():
    book = out.Workbook()
    sheet = book.sheet("a b", out.Options(widths={0: 20}, freeze=(1, 0)))
    sheet.write_row(["id"], out.HEAD_STYLE)
    sheet.write_row([1, "x & <y> _x0041_ \x01", True, dt.datetime(2020, 1, 1, 1, 1, 1), out.Link("http://a/b?c&d", "t"), out.Formula("A1+1", 3), out.Note("n", "hello"), out.RichText((("a", out.Style(bold=True)), ("b", None))), out.Image(b"\x89PNGx", "img"), 2**60, 0.1 + 0.2], row=3)
    sheet.merge(0, 0, 0, 1)
    package = xlsx.Package(book.finish())
    rows = dict(package.rows(0))
    assert [c.raw for c in rows[3]] == ["1", "x & <y> _x0041_ \x01", "1", "43831.0423726852", "t", "3", "n", "ab", "img", str(2**60), "0.3"]
    assert rows[3][5].formula == "A1+1" and package.formats[rows[3][3].style] == "yyyy-mm-dd hh:mm:ss" and package.last_row(0) == 3
    assert list(package.extras(0)) == [("MERGE", None, 0, 0, 0, 1), ("HYPERLINK", "http://a/b?c&d", 3, 3, 4, 4), ("COMMENT", "hello", 3, 3, 6, 6)]
    with pytest.raises(xlsx.Unsupported):
        out.Workbook(password="x")
    with pytest.raises(xlsx.FormatError):
        xlsx.Package(b"PK not a zip")
    with pytest.raises(xlsx.Unsupported):
        xlsx.Package(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")


def test_shared_strings_in_memory_and_on_disk():
    book = out.Workbook(shared_strings=True)
    for i in range(50):
        book.sheet("s").write_row([f"é{i % 7}"])
    for mode in ("memory", "disk"):
        package = xlsx.Package(book.finish(), mode)
        assert [c[0].raw for _, c in package.rows(0)] == [f"é{i % 7}" for i in range(50)] and package.strings.on_disk == (mode == "disk")
        with pytest.raises(xlsx.FormatError):
            package.strings[7]


def test_references_and_names():
    assert xlsx.parse_reference("$xfd$1048576") == (1048575, 16383) and xlsx.letters(16383) == "XFD"
    for bad in ("A0", "XFE1", "1A", "A1048577"):
        with pytest.raises(xlsx.FormatError):
            xlsx.parse_reference(bad)
    assert [decode.format_of_name(n) for n in ("a.XLSX", "b.xls", "c", "d.csv", "e.xlsm")] == ["xlsx", "xls", "csv", "csv", "xlsx"]
    with pytest.raises(xlsx.FormatError):
        decode.format_of_name("x.pdf")


def test_csv_records():
    data = 'a,b\r\n"x\ny","q""r"\r\n\r\nshort\r\n1,2,3\r\n'.encode("utf-8-sig")
    assert list(csv.records(data)) == [(0, ["a", "b"]), (1, ["x\ny", 'q"r']), (2, []), (3, ["short"]), (4, ["1", "2", "3"])][:2] + [(3, ["short"]), (4, ["1", "2", "3"])]
    assert csv.decode("中".encode("gbk"), "GBK") == "中" and csv.byte_order_mark("gbk") == b"" and csv.byte_order_mark("utf-16le") == b"\xff\xfe"
    with pytest.raises(ValueError):
        csv.charset_name("no-such")


def test_read_options(spark):
    text = " Name ,Age\n\t ann ,1\n,\n bob,x\ncy,3\n"
    schema = Schema([Field("name", heads=("Name",)), Field("age", "int", ("Age",))])
    reader = read_bytes(spark, text.encode()).schema(schema)
    assert [tuple(r) for r in reader.on_error("DROPMALFORMED").load(("_row",)).collect()] == [(1, "ann", 1), (4, "cy", 3)]
    kept = reader.on_error("PERMISSIVE").load().collect()
    assert [r["name"] for r in kept] == ["ann", "bob", "cy"] and kept[1]["_error"]["field"] == "age" and kept[1]["_error"]["value"] == "x"
    with pytest.raises(Exception, match="not a int"):
        reader.load().collect()
    assert [r["name"] for r in reader.on_error("DROPMALFORMED").rows(2, 4).load().collect()] == ["cy"]
    assert reader.option(ignore_empty=False).on_error("PERMISSIVE").load().count() == 4
    with pytest.raises(ValueError):
        reader.rows(4, 2)
    with pytest.raises(Exception, match="no such sheet"):
        read_bytes(spark, out.Workbook().finish()).sheet("nope").raw().collect()


def test_handlers_and_layout(spark):
    class Mine(Handler):
        def cell(self, value, row, col, is_head):
            return SKIP if value == "b" and not is_head else value

    df = spark.createDataFrame([(i, "b" if i == 1 else "c", dt.date(2020, 1, 1 + i)) for i in range(4)], "id int, v string, d date")
    content = write(df, ["id"], auto_width=True, freeze_head=True, loop_merges=[(2, 1, 1)], handlers=[Mine()], content_styles=[out.Style(bold=True), out.Style()]).to_xlsx()
    package = xlsx.Package(content)
    assert [c.raw for c in dict(package.rows(0))[2]] == ["1", "43832.0"]
    xml = package.read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in xml and '<col min="3"' in xml and [e[2:] for e in package.extras(0)] == [(1, 2, 1, 1), (3, 4, 1, 1)]
    assert [tuple(r) for r in read_bytes(spark, content).schema(Schema([Field("d", "date"), Field("v")])).load().collect()] == [(dt.date(2020, 1, 1 + i), None if i == 1 else "c") for i in range(4)]


def test_many_workbooks_and_save(spark, tmp_path):
    df = spark.range(30).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    made = workbooks(df, "k", ["n"]).collect()
    assert sorted(r["key"] for r in made) == ["0", "1", "2"]
    for r in made:
        save(spark, f"{tmp_path}/in/{r['key']}.xlsx", iter([bytes(r["content"])]))
    schema = Schema([Field("n", "long")])
    assert sorted(r.n for r in read(spark, f"{tmp_path}/in").schema(schema).load().collect()) == list(range(30))
    write(df, ["n"]).save_csv(f"{tmp_path}/in/x.csv")
    stream = directory.read_stream(spark, f"{tmp_path}/in", schema)
    seen = []
    query = directory.for_each_batch(stream, lambda b, i: seen.extend(r.n for r in b.collect()), f"{tmp_path}/cp")
    query.awaitTermination()
    assert sorted(seen) == sorted([*range(30), *range(30)])


def test_listeners(spark):
    content = write(spark.range(10).select(F.col("id").cast("int").alias("id")), ["id"]).to_csv()
    reader = read_bytes(spark, content).schema(Schema([Field("id", "int")]))
    got, pages = listeners.Collect(), []
    listeners.listen(reader, listeners.Several(got, listeners.Pages(4, lambda rows, n: pages.append((n, len(rows))))))
    assert [r.id for r in got.rows] == list(range(10)) and pages == [(0, 4), (1, 4), (2, 2)]

    class Stops(listeners.Collect):
        def has_next(self, context):
            return len(self.rows) < 3

    stops = Stops()
    listeners.listen(reader, stops)
    assert len(stops.rows) == 3

    class Fails(listeners.IgnoreErrors):
        def row(self, row, context):
            raise ValueError(context["row"])

    listeners.listen(reader, Fails())
    with pytest.raises(ValueError):
        listeners.listen(reader, type("F", (listeners.Listener,), {"row": Fails.row})())


def test_template(spark):
    book = out.Workbook()
    sheet = book.sheet("t")
    sheet.write_row(["{title} of {n}", "{n}", "\\{n\\}", "{other}"], out.Style(bold=True))
    sheet.write_row(["{.a}", "x{.b}", "{p.a}"])
    sheet.write_row(["below", out.Formula("A2+A3", 1)])
    sheet.merge(2, 2, 0, 1)
    data = [{"a": i, "b": f"v{i}"} for i in range(3)]
    content = Template(book.finish()).fill({"title": "List", "n": 5}).fill_list(data, force_new_row=True).fill_list([{"a": "P"}], prefix="p").write_rows([["end", 1]]).finish()
    package = xlsx.Package(content)
    rows = {r: [c.raw for c in cells] for r, cells in package.rows(0)}
    assert rows == {0: ["List of 5", "5", "{n}", "{other}"], 1: ["0", "xv0", "P"], 2: ["1", "xv1"], 3: ["2", "xv2"], 4: ["below", "1"], 5: ["end", "1"]}
    assert dict(package.rows(0))[4][1].formula == "A2+A5" and list(package.extras(0))[0][2:] == (4, 4, 0, 1)
    wide = Template(book.finish()).fill_list(data, horizontal=True).finish()
    assert [c.raw for c in dict(xlsx.Package(wide).rows(0))[1]][:4] == ["0", "xv0", "xv1", "xv2"]
    more = append(content, spark.createDataFrame([("z", 9)], "a string, b int"), ["a"])
    assert [c.raw for c in dict(xlsx.Package(more).rows(0))[6]] == ["z", "9"]


def test_multi_sheet_and_errors(spark):
    nation, region = spark.createDataFrame([(1, "a")], "k int, n string"), spark.createDataFrame([("r",)], "n string")
    with Workbook() as book:
        book.write(write(nation, ["k"], sheet="one")).write(write(region, ["n"], sheet="two"))
    content = book.finish()
    with pytest.raises(ValueError):
        book.write(write(nation, ["k"], sheet="three"))
    both = read_sheets(read_bytes(spark, content), {"one": Schema([Field("k", "int"), Field("n")]), 1: Schema([Field("n")])})
    assert sorted((r.sheet_no, r.n) for r in both.collect()) == [(0, "a"), (1, "r")]


def test_data_source(spark, tmp_path):
    from sheetspark.sources.datasource import register

    register(spark)
    spark.range(20).selectExpr("id", "concat('v', id) as v").repartition(2).write.format("sheet").mode("append").save(f"{tmp_path}/books")
    rows = spark.read.format("sheet").load(f"{tmp_path}/books")
    assert sorted(r[0] for r in rows.select("cells").collect() for r in [[r["cells"][1]["s"]]]) == sorted(f"v{i}" for i in range(20))
    assert rows.where("_row between 2 and 3").count() == 4
    assert spark.read.format("sheet").option("startRow", 2).option("endRow", 3).load(f"{tmp_path}/books").count() == 4


def test_plain_and_parsed_rows_agree():
    import random

    rng, book = random.Random(4), out.Workbook()
    sheet = book.sheet("s")
    for i in range(3000):
        sheet.write_row([rng.choice([None, i, -i / 7, True, "a & <b>", "_x0041_ é\U0001f600", "x\ny", out.Formula("A1<2", "r"), out.Formula("1+1", 2.5)]) for _ in range(6)], row=sheet.next_row + rng.choice([0, 0, 2]))
    rich = out.Workbook()
    rich.sheet("s").write_row(["plain"])
    rich.sheet("s").write_row([out.RichText((("a", None), ("b", out.Style(bold=True))))])
    rich.sheet("s").write_row([1])
    for b in (book, rich):
        package = xlsx.Package(b.finish())
        parsed = list(package._parsed_rows(0))
        assert list(package.rows(0)) == parsed and len(parsed) >= 3
    plain = list(xlsx.Package(book.finish())._plain_rows(0))
    assert all(cells is not None for _, cells in plain) and len(plain) == 3000
    assert list(xlsx.Package(rich.finish())._plain_rows(0))[-1] == (0, None)
