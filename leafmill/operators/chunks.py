"""Embedding chunks of documents: windows of text that break at spaces, led by the title."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, the least window, and how far back a chunk may break.
CHUNK, LEAST, BREAK = 1200, 200, 0.6
_space = re.compile(r"\s").match


def chunk(title: str | None, content: str | None, size: int = CHUNK, most: int | None = None) -> list[str]:
    """Pieces of the content, each after the title's line, of ``size`` characters at most; the title alone if there is none."""
    title, content = title or "", content or ""
    prefix = title + "\n" if title else ""
    window, at, out = max(LEAST, size - len(prefix)), 0, []
    while at < len(content) and (most is None or len(out) < most):
        end = min(len(content), at + window)
        if end < len(content):
            space = content.rfind(" ", 0, end + 1)
            if space > at + window * BREAK:
                end = space
        piece = content[at:end].strip()
        if piece:
            out.append((prefix + piece)[:size])
        at = end
        while at < len(content) and _space(content[at]):
            at += 1
    return out or ([title[:size]] if title else [])


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", title_col: str | None = None, content_col: str = "text", size: int = CHUNK, most: int | None = None, with_title: bool = False) -> DataFrame:
    """One row per chunk: the document's id, idx, content, and with ``with_title`` the document's title as _title."""
    title = F.lit("") if title_col is None else F.col(title_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "idx", "content", *(["_title"] if with_title else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                places, idx, texts = [], [], []
                for k, (t, c) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for i, piece in enumerate(chunk(t, c, size, most)):
                        places.append(k)
                        idx.append(i)
                        texts.append(piece)
                ids = part.column(0).take(pa.array(places, pa.int64()))
                titles = [part.column(1).take(pa.array(places, pa.int64()))] if with_title else []
                yield pa.RecordBatch.from_arrays([ids, pa.array(idx, pa.int32()), pa.array(texts, pa.string()), *titles], names=names)

    out = docs.select(F.col(id_col).alias("_id"), title.alias("_t"), F.col(content_col).alias("_c")).mapInArrow(run, f"_id {kind}, idx int, content string" + (", _title string" if with_title else ""))
    return out.withColumnRenamed("_id", id_col)


def document_text(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Passages' texts, and tables' rows as cells joined by spaces, joined by lines in order; blanks dropped."""
    rows = F.transform("table_rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), " "))
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.array("text")).when(F.col("type") == "table", rows).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x != "")
    ordered = F.sort_array(F.collect_list(F.struct("pos", own.alias("lines"))))
    return passages.groupBy(id_col).agg(F.array_join(F.flatten(F.transform(ordered, lambda p: p["lines"])), "\n").alias("text"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored vectors (doc_id, idx, vector) by ordinal; chunks beyond the stored ones have none."""
    return chunks.join(vectors, ["doc_id", "idx"], "left")
