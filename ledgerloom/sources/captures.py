"""Web captures: archive records and listing pages."""

from __future__ import annotations

import gzip
import zlib
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def record_body(record: bytes | None) -> bytes | None:
    """The page in a gzipped archive record: record headers, HTTP headers, body (de-chunked, unzipped)."""
    if record is None:
        return None
    try:
        data = gzip.decompress(record)
    except (OSError, EOFError, zlib.error):
        return None
    _, _, rest = data.partition(b"\r\n\r\n")
    head, found, body = rest.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = head.lower()
    if b"transfer-encoding: chunked" in headers:
        body = _dechunk(body)
    if b"content-encoding: gzip" in headers:
        try:
            body = gzip.decompress(body.rstrip(b"\r\n"))
        except (OSError, EOFError, zlib.error):
            return None
    return body


@F.udf(BinaryType(), useArrow=True)
def archive_body(record):
    return record_body(record)


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], str | None]] = []
        self.cells: list[str] | None = None
        self.link: str | None = None
        self.inside = False

    def _close(self) -> None:
        if self.cells:
            self.rows.append(([" ".join(c.split()) for c in self.cells], self.link))
        self.cells, self.link, self.inside = None, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
            self.inside = True
        elif tag == "a" and self.inside and self.link is None:
            self.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False
        elif tag in ("tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.inside and self.cells:
            self.cells[-1] += data


def table_rows(markup: str) -> list[tuple[list[str], str | None]]:
    """Cells and first link of every table row."""
    parser = _Rows()
    parser.feed(markup)
    parser.close()
    parser._close()
    return parser.rows


@F.udtf(returnType=StructType().add("row_no", IntegerType()).add("cells", ArrayType(StringType())).add("link", StringType()))
class ListingRows:
    """``SELECT * FROM pages, LATERAL listing_rows(html)`` once registered: a row for each row of a page's tables."""

    def eval(self, markup: str):
        for i, (cells, link) in enumerate(table_rows(markup or "")):
            yield i, cells, link
