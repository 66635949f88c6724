"""Main text of web pages, by a wrapper inferred for each host from all its pages.

Every task aligns the pages it reads, host by host, and passes on one wrapper for
each; these are aligned in two rounds, so a host with a third of all pages is many
small pieces of work. Wrappers depend on a host's kinds of layout and not on its
number of pages. They meet the pages in a plain join, which Spark makes a broadcast
if they are small, and splits where a host is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm import wrappers as w
from fleetbooks.llm.common import text_or_empty, written

# Hosts and layouts that a task remembers at once.
REMEMBERED = 5_000
PIECES = 32


def host(url: Column) -> Column:
    """Host of an address in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[w.Item]] = {}

    def done() -> pa.RecordBatch:
        made = [pa.array(list(known), pa.string()), pa.array([w.dumped(x) for x in known.values()], pa.string())]
        known.clear()
        return pa.RecordBatch.from_arrays(made, ["host", "wrapper"])

    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("html")
        for k, name in enumerate(hosts):
            own = [item for item, _ in w.squashed(w.stream(pages[k].as_py()))]
            known[name] = w.merged(known[name], own) if name in known else own
        if len(known) > REMEMBERED:
            yield done()
    yield done()


def _aligned(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole: list[w.Item] | None = None
        for text in sorted(rows["wrapper"]):
            whole = w.loaded(text) if whole is None else w.merged(whole, w.loaded(text))
        return rows[keys].head(1).assign(wrapper=w.dumped(whole))

    return run


def infer(pages: DataFrame) -> DataFrame:
    """A wrapper for each host of ``pages`` (columns ``host`` and ``html``)."""
    parts = pages.select("host", "html").mapInArrow(_inferred, "host string, wrapper string")
    parts = parts.withColumn("piece", F.pmod(F.xxhash64("wrapper"), F.lit(PIECES)).cast("int"))
    kind = "host string, piece int, wrapper string"
    parts = parts.groupBy("host", "piece").applyInPandas(_aligned(["host", "piece"]), kind)
    return parts.groupBy("host").applyInPandas(_aligned(["host"]), "host string, wrapper string")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, tuple[list[w.Item], set]] = {}
    layouts: dict[tuple, list[bool]] = {}
    for batch in batches:
        pages, told = batch.column("html"), batch.column("wrapper").to_pylist()
        texts = []
        for k, wrapper in enumerate(told):
            page = w.squashed(w.stream(pages[k].as_py()))
            if wrapper not in loaded:
                if len(loaded) > REMEMBERED:
                    loaded.clear()
                items = w.loaded(wrapper or "[]")
                loaded[wrapper] = items, {x.text for x in items if w.hosts_own(x)}
            items, own = loaded[wrapper]
            # Of the texts, only those that are the host's own tell what is kept.
            layout = (wrapper, tuple((x.token, x.text if x.text in own else None) for x, _ in page))
            keep = layouts.get(layout)
            if keep is None:
                if len(layouts) > REMEMBERED:
                    layouts.clear()
                keep = layouts[layout] = w.kept(items, page)
            texts.append(w.main_text(page, keep))
        keys = [c for c in batch.schema.names if c not in ("html", "wrapper")]
        made = [*(batch.column(c) for c in keys), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(made, [*keys, "text"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: ``id``, ``url`` and ``text``, the blocks of its main text by line.

    A null or empty page has an empty text. Pages without a host (a null or other
    address) share one wrapper. Every row gives one row, copies too; columns besides
    these three take no part. A slot outside of ``article`` and ``main`` whose text is the
    same on all pages of a host, three at least, is the host's and no main text, if other
    slots differ.
    """
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), text_or_empty(html).alias("html")
    )
    found = rows.join(written(infer(rows), "wrappers"), "host", "left").drop("host")
    kind = f"id {found.schema['id'].dataType.simpleString()}, url {found.schema['url'].dataType.simpleString()}, text string"
    found = found.mapInArrow(_extracted, kind)
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text")
