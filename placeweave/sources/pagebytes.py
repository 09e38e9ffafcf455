"""Captured pages as the bytes that were fetched.

A page says how it is encoded, if at all, in its first bytes: by a byte order
mark, or by a ``charset`` in a ``meta`` or ``xml`` declaration.  Without either
it is UTF-8 if it can be, else ``fallback``.  Names are read as browsers read
them (``gb2312`` is GB 18030's subset GBK, ``iso-8859-1`` is Windows-1252).

Bytes come from any table with a binary column, or from loose files through
Spark's own binary reader, so any file system that Spark knows will do; files
are listed and read by the tasks.  One narrow Arrow pass, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.arrow import map_column

#: How far a declaration is looked for, as in browsers.
PRESCAN = 1024
# Byte order marks, and names that mean another encoding.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
ALIASES = {
    "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf-16": "utf-8", "utf-16le": "utf-8", "utf-16be": "utf-8",
    "iso-8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252",
    "gb2312": "gbk", "gb_2312-80": "gbk", "x-gbk": "gbk", "chinese": "gbk",
    "shift-jis": "cp932", "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms_kanji": "cp932",
    "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "x-x-big5": "big5hkscs", "cn-big5": "big5hkscs",
    "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "ksc5601": "cp949", "korean": "cp949", "windows-949": "cp949",
    "x-euc-jp": "euc-jp", "iso-8859-9": "windows-1254", "iso-8859-11": "windows-874", "tis-620": "windows-874",
}
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)
_META = re.compile(rb"<meta[\s/][^>]*", re.I)
_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([^\s"'/>;]+)""", re.I)
_XML = re.compile(rb"""\A\s*<\?xml[^>]*?encoding\s*=\s*["']([^"']+)["']""", re.I)


def _codec(name: str) -> str | None:
    label = name.strip().lower()
    label = ALIASES.get(label, label)
    try:
        "".encode(label)
    except (LookupError, ValueError):
        return None
    return label


def declared_charset(data: bytes) -> str | None:
    """What the first bytes say about the encoding."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    head = _COMMENT.sub(b"", data[:PRESCAN])
    for tag in _META.finditer(head):
        said = _CHARSET.search(tag[0])
        if said and (codec := _codec(said[1].decode("ascii", "replace"))):
            return codec
    said = _XML.match(head)
    return _codec(said[1].decode("ascii", "replace")) if said else None


def decode_page(data: bytes | None, fallback: str = "windows-1252") -> tuple[str | None, str | None]:
    """(text, encoding) of a page; bytes that are none in it become U+FFFD."""
    if data is None:
        return None, None
    name = declared_charset(data)
    if name is None:
        try:
            return data.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            name = fallback
    text = data.decode(name, "replace")
    return text.removeprefix("﻿"), name


def decode_pages(pages: DataFrame, content: str = "content", fallback: str = "windows-1252") -> DataFrame:
    """All columns of ``pages`` but ``content``, with ``html`` and ``charset``
    (null for a null page)."""
    return map_column(pages, content, lambda d: decode_page(d, fallback), {"html": "string", "charset": "string"})


def read_page_files(spark: SparkSession, path: str, pattern: str = "*", fallback: str = "windows-1252") -> DataFrame:
    """``(page_id, url, html, charset)`` of a folder of loose page files, one
    page per file, numbered by file path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    raw = files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content")
    return decode_pages(raw, fallback=fallback)
