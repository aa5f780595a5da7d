"""HTML extraction: the main text of pages by a recurrent block labeller.

A page is cut into leaf blocks (texts between block-level tags, in page order,
character references decoded, white space inside a block made one space). A
numpy bidirectional LSTM reads the sequence of hashed tag paths (with class,
id and role words) and hashed words of the whole page, and classifies every
block with that context. Blocks it calls main are joined by one space.

The labeller is trained here, on pages made from a seed with known main
blocks; weights are about 30,000 numbers and travel in the task.

Scale: map-only; a page is on its own. Very long pages are read in
stretches of blocks, and both directions hand their states on from one to the
next, so every block is labelled in the context of the whole page; no text is
dropped or capped.

Defined results: null and empty pages, and pages without main blocks, give an
empty text of 0 characters; equal rows give equal results; null ids and urls
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table
from ravelin.llm.html_blocks import blocks
from ravelin.llm.html_model import Labeller, label, trained, vectors

PAGES_AT_ONCE = 128


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    marks = label(model, [vectors(b) for b in found])
    return [" ".join(b.text for b, m in zip(bs, ms.tolist(), strict=True) if m) for bs, ms in zip(found, marks, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    model = model or trained()

    def run(batches):
        for rb in batches:
            texts: list[str] = []
            own = rb.column(2)
            for s in range(0, rb.num_rows, PAGES_AT_ONCE):
                texts += main_texts(model, [x or "" for x in own.slice(s, PAGES_AT_ONCE).to_pylist()])
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
