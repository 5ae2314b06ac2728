import pytest
from pyspark.sql import functions as F

from sheetspark.operators import images
from sheetspark.plans import exchange
from sheetspark.sinks import xls as xls_sink
from sheetspark.sources import xls, xlsx


def test_download_and_failure():
    head, body = exchange.download(b"x", "表 1")
    assert head["Content-Disposition"].endswith("%E8%A1%A8%201.xlsx") and body == b"x"
    assert exchange.failure(xlsx.Unsupported("p"))[0] == 415 and exchange.failure(xlsx.FormatError("f"))[0] == 400
    assert exchange.rows_of_upload(b"a,b\n1,2\n") == [["1", "2"]]


def test_utf16_places():
    assert [exchange.utf16_to_index("a\U0001f600b", i) for i in (0, 1, 3, 4)] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        exchange.utf16_to_index("a\U0001f600b", 2)


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    df = spark.createDataFrame([("x/a.png",), ("none",)], "p string")
    got = {r.p: r for r in images.from_files(df, "p", str(tmp_path)).withColumn("c", images.checked(F.col("image"))).collect()}
    assert bytes(got["x/a.png"].image).startswith(b"\x89PNG") and got["x/a.png"].c.type == "png" and got["none"].image is None
    assert spark.range(1).select(images.from_urls(F.lit("no address"))).first()[0] is None


def test_append_to_a_legacy_workbook():
    book = xls_sink.Book()
    book.sheet("s").write_row(["a", 1.5], [None, "0.00"])
    book.sheet("s").merge(0, 0, 0, 1)
    read = xls.Book(xls_sink.append(book.finish(), [["b", True]]))
    assert [[c.raw for c in cells] for _, cells in read.rows(0)] == [["a", "1.5"], ["b", "1"]]
    assert read.merges(0) == [(0, 0, 0, 1)] and read.formats[dict(read.rows(0))[0][1].style] == "0.00"
