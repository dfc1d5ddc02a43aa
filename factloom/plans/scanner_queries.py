"""One query over all documents, with two scanners."""

from __future__ import annotations

from ..sources import scanners
from .adapters import table


def _scanned(spark, sf_dir, name, handler):
    return scanners.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), scanners.register(spark, name, handler, scanners.ITEMS), "text")


def scan_lines(spark, sf_dir):
    return _scanned(spark, sf_dir, "lines_of_text", scanners.Lines)


def scan_numbers(spark, sf_dir):
    return _scanned(spark, sf_dir, "numbers_of_text", scanners.Numbers)


QUERIES = {f.__name__: f for f in (scan_lines, scan_numbers)}
FEEDS = "feeds AS (SELECT r, doc_id, i::INT AS line, l[i] AS t FROM (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i))"
SQL = {
    "scan_lines": f"WITH {FEEDS}, s AS (SELECT *, trim(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS item FROM feeds) SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY line) - 1)::INT AS ord, line, item, length(item)::INT AS size FROM s WHERE item <> ''",
    "scan_numbers": f"WITH {FEEDS}, s AS (SELECT r, doc_id, line, j, n[j] AS item FROM (SELECT *, regexp_extract_all(t, '[0-9]+') AS n FROM feeds), unnest(range(1, len(n) + 1)) AS u(j)) SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY line, j) - 1)::INT AS ord, line, item, length(item)::INT AS size FROM s",
}
