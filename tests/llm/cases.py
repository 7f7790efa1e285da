"""Rows that every operator on documents must take, and helpers for small tables."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

ODD = [
    (-1, None),
    (-2, ""),
    (-3, " "),
    (-4, "a  b\n\n c <|endoftext|> d<|endoftext|>e it's we'll  x y　z 12ab ½ ²"),
    (-5, "  lead and trail  "),
    (-6, "日本語 テキスト ไทย emoji \U0001f600\U0001f600 x"),
    (-7, "\x1c a \x1f b\x85c \x0b d"),
    (-8, "the same words again and again " * 400),
    (-9, "the same words again and again " * 400),
    (-9, "the same words again and again " * 400),
    (None, "a row without an id"),
    (None, None),
]


def documents(spark, rows=None, name="documents"):
    """The smallest documents and the odd rows, with columns whose names clash with the operators' own."""
    odd = spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string")
    docs = odd if rows is not None else spark.read.parquet(f"{SF}/{name}.parquet").select("doc_id", "text").unionByName(odd)
    return docs.selectExpr(
        "doc_id", "text", "'en' AS lang", "'src' AS source", "length(text) AS n_chars", "1 AS `row`", "2 AS key", "3 AS node", "4 AS block", "'f' AS found", "5 AS value", "6 AS word", "7 AS ids"
    )


def key(value):
    """Sortable text of an id that may be null."""
    return "null" if value is None or value != value else str(int(value))
