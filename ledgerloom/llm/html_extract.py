"""HTML extraction by consensus: pages vote for the path of their main container, hosts decide, pages are read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, materialise, text_of
from .html_tree import Page
from .url_filters import url_host

#: A host keeps the paths with this share of its pages' votes, so at most fifty, the winner first. A page without text
#: under any of them keeps its own vote.
PATH_SHARE = 0.02
#: Up to this many hosts their paths are broadcast; beyond it they are joined to the pages.
BROADCAST_HOSTS = 20_000


def page_vote(source: str) -> tuple[str, float]:
    """The generalised path of a page's best container and its score; empty without one."""
    page = Page(source)
    node, score = page.best()
    return (page.path(node), score) if node is not None else ("", 0.0)


def extract(source: str, paths: list[str]) -> tuple[str, str]:
    """(text, path) under the first of ``paths`` that the page has with text, else under the page's own best container."""
    page = Page(source)
    for path in paths:
        chosen = page.at(path)
        blocks = page.text_under(chosen) if chosen else []
        if blocks:
            return "\n\n".join(blocks), path
    node, _ = page.best()
    return ("\n\n".join(page.text_under([node])), page.path(node)) if node is not None else ("", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """host, n_pages and the host's paths, most voted first. ``pages`` has host and html.

    Votes are added up per host and path before the shuffle, so a host with very many pages costs no more than others.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [page_vote(source) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], names=["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, score double").groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.log1p("score")).alias("weight"))
    sizes = votes.groupBy("host").agg(F.sum("pages").alias("n_pages"))
    votes = votes.join(sizes, "host")
    kept = (F.col("path") != "") & (F.col("pages") >= PATH_SHARE * F.col("n_pages"))
    named = F.sort_array(F.collect_list(F.when(kept, F.struct((-F.col("weight")).alias("order"), "path"))))
    return votes.groupBy("host", "n_pages").agg(named.alias("named")).select("host", "n_pages", F.col("named.path").alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path.

    A null or empty html gives an empty text; a null url belongs to the empty host, which votes like any other.
    Repeated rows are extracted alike; an empty table gives no rows; further columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), text_of(html_col).alias("html"))
    winners = materialise(host_paths(rows), "host-paths")
    if winners.count() <= BROADCAST_HOSTS:
        known = rows.join(F.broadcast(winners.select("host", "paths")), "host")
    else:
        known = lookup_join(rows, winners, "host", "n_pages")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(source, paths or []) for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            text = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([f[1] for f in found], pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    kind = dict(pages.dtypes)[id_col]
    return known.select("page_id", "url", "html", "paths").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long, path string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
