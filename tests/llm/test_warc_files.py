"""WARC files, plain and compressed, their derivatives against a plain version, and pages that used to take quadratic time."""

from __future__ import annotations

import gzip
import html
import re
import time

import pytest

from edgeloom.llm import warc


def _plain(text: str) -> str:
    """The rules of warc.plain by backtracking patterns, for well-formed pages."""
    text = re.sub(r"<!--.*?-->|<(script|style|noscript|template|head|title)\b[^>]*>.*?</\1\s*>", " ", text, flags=re.S | re.I)
    text = re.sub(r"<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|main|blockquote|pre|title))\b[^>]*>", "\n", text, flags=re.I)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub("<[^<>]*>", "", text)).split("\n"))
    return "\n".join(x for x in lines if x)


def test_plain_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: (r.url or "", r.html or "") for r in pages.collect()}
    made = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(made) == 2 * len(source)
    for page, (url, text) in source.items():
        conversion, metadata = made[page, "conversion"], made[page, "metadata"]
        assert bytes(conversion.block).decode() == _plain(text) and conversion.target_uri == url
        links = len(re.findall(r"""<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", text, re.I))
        facts = bytes(metadata.block).decode()
        assert f"outlinks: {links}\r\n" in facts and f"plain-text-length: {len(_plain(text))}\r\n" in facts and conversion.record_id in facts


@pytest.mark.parametrize("piece", ["<!--", "<script>", "<script", "<p", "<a ", "<title>", "</script", "<"])
def test_unclosed_markup_takes_linear_time(piece):
    began = time.time()
    warc.plain(piece * 30_000), warc.title(piece * 30_000), warc._LINK.findall(piece * 30_000)
    assert time.time() - began < 5


def test_unclosed_and_nested_markup():
    assert warc.plain("a<!-- b <script>c</script> d") == "a<!-- b d"
    assert warc.plain("x<script>1</SCRIPT >y<!--z-->w") == "x y w"
    assert warc.title("<title>a <b>\n&amp;</title>") == "a <b> &" and warc.title("<title>open") == ""


def test_files_of_both_kinds(spark, tmp_path):
    records = [warc.response(k, f"http://h/{k}", f"<p>page {k}</p>" * (k + 1)) for k in range(5)]
    other = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:x>")], b"software: none\r\n")
    (tmp_path / "a.warc").write_bytes(other + b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [other, *records])))
    (tmp_path / "c.warc").write_bytes(records[0] + records[1][:-20])  # cut off
    (tmp_path / "d.warc").write_bytes(b"")
    found = warc.read_files(spark, f"{tmp_path}/*")
    by_file: dict[str, list] = {}
    for r in found.collect():
        by_file.setdefault(r.page_id.rsplit("/", 1)[1].split("#")[0], []).append((int(r.page_id.split("#")[1]), bytes(r.warc)))
    assert {k: [x for _, x in sorted(v)] for k, v in by_file.items()} == {"a.warc": [other, *records], "b.warc.gz": [other, *records], "c.warc": records[:1]}
    made = warc.derive(found).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in made} == {"metadata": 11, "conversion": 11}
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
