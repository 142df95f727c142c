"""Providers: callables that render pages or recognise text; errors stay with their page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructType

from leafmill.cluster import ship

#: From image bytes to text, confidence and warnings.
Provider = Callable[[bytes], tuple[str, float, list[str]]]
#: From a document's bytes and a page number to that page's image.
Renderer = Callable[[bytes, int], bytes]


def recognise(images: DataFrame, keys: list[str], provider: Provider) -> DataFrame:
    """keys, text, confidence, warnings and error of images (keys, content). An exception becomes its page's error."""
    ship(images.sparkSession)
    kept = images.select(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for content in x.pop("content"):
                try:
                    text, confidence, warnings = provider(bytes(content))
                    rows.append((text, float(confidence), list(warnings), None))
                except Exception as e:  # whatever a provider raises belongs to its page
                    rows.append(("", 0.0, [str(e)], str(e)))
            yield x.assign(**dict(zip(("text", "confidence", "warnings", "error"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in ("text", "confidence", "warnings", "error")})

    schema = StructType(list(kept.schema.fields)).add("text", StringType()).add("confidence", DoubleType()).add("warnings", ArrayType(StringType())).add("error", StringType())
    return images.select(*keys, "content").mapInPandas(run, schema)


def render(pages: DataFrame, keys: list[str], renderer: Renderer) -> DataFrame:
    """keys, content and error of pages (keys, page, content: the document's bytes): content is then the page's image, null with an error."""
    ship(pages.sparkSession)
    kept = pages.select(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for page, content in zip(x.pop("__page"), x.pop("content"), strict=True):
                try:
                    out.append((renderer(bytes(content), int(page)), None))
                except Exception as e:  # whatever a renderer raises belongs to its page
                    out.append((None, str(e)))
            yield x.assign(content=[c for c, _ in out], error=[e for _, e in out])

    schema = StructType(list(kept.schema.fields)).add("content", BinaryType()).add("error", StringType())
    return pages.select(*keys, pages["page"].alias("__page"), "content").mapInPandas(run, schema)
