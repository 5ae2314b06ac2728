import pytest

from sheetspark.sinks import xls as out
from sheetspark.sources import xls


@pytest.mark.parametrize("text", ["z" * 32_768, "\U0001f600" * 16_384])
def test_text_beyond_a_legacy_cell_is_refused(text):
    book = out.Book()
    book.sheet("a").write_row([text])
    with pytest.raises(ValueError):
        book.finish()


def test_longest_text_of_a_legacy_cell():
    book = out.Book()
    book.sheet("a").write_row(["z" * 32_767])
    assert [c.raw for _, cells in xls.Book(book.finish()).rows(0) for c in cells] == ["z" * 32_767]
