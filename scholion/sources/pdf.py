"""Text blocks of PDF files; needs a PDF library, which is looked for only when the source is used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_pdf_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, page, block, text, font_size)`` of the PDF files under a folder."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs the PyMuPDF library") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = []
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc):
                        for i, block in enumerate(page.get_text("dict")["blocks"]):
                            spans = [s for line in block.get("lines", []) for s in line["spans"]]
                            if spans:
                                rows.append((p, n + 1, i, " ".join(s["text"] for s in spans), max(s["size"] for s in spans)))
                yield pd.DataFrame(rows, columns=["path", "page", "block", "text", "font_size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, block int, text string, font_size double")
