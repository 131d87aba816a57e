"""Pages of binary documents; the reader of the format is given, for none comes with the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_texts(files: DataFrame, reader: Callable[[bytes], list]) -> DataFrame:
    """path, page_num (from 1), text ("" where a page has none) of files (path, content); reader: bytes -> a text per page."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, i + 1, t or "") for p, c in zip(f["path"], f["content"]) for i, t in enumerate(reader(c))]
            yield pd.DataFrame(rows, columns=["path", "page_num", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string")


def page_images(files: DataFrame, render: Callable[[bytes, int, int], bytes], dpi: int = 150, strict: bool = True) -> DataFrame:
    """Files (path, content, page_num) with image; render: (content, page, dpi) -> bytes. Unless strict, an error gives null."""

    def one(content, page):
        try:
            return render(content, page, dpi)
        except Exception:
            if strict:
                raise
            return None

    def run(frames):
        for f in frames:
            yield f[["path", "page_num"]].assign(image=[one(c, int(p)) for c, p in zip(f["content"], f["page_num"])])

    return files.select("path", F.col("page_num").cast("int"), "content").mapInPandas(run, "path string, page_num int, image binary")
