"""Main text of pages by site template removal.

Every container element of a page (all but prose such as paragraphs, headings and list items) is a subtree with a hash
of its markup and text.  Hashes are counted per host: a subtree belongs to the site's template if at least ``MIN_PAGES``
different pages of its host have it, and at least one in ``SHARE`` of them.  Pages are different if the texts of their
articles are (of the whole pages, where they have none), so a page that is crawled again, or copied under other urls and
menus, counts once and loses nothing.  Template subtrees are deleted from each page, unless they hold over half of its text.

Of what is left, the article (or main) element with most text is the main text if it has a quarter of the page's; in a
main, an article that has half of it.  A page without such an element gives all that is left.  Elements that HTML itself
marks as no content (menus, headers, footers, asides, forms, and so on) never count, as a host with few pages cannot tell
these by counting; a class or id alone takes no element out (``_html``).

Pages are read once and travel once, as compressed blocks, by a key of the row; only (host, hash) pairs are shuffled to
be counted, with partial sums before.

Defined cases: null html is empty and gives an empty text; a null url has the empty host; null ids are carried along;
repeated rows count as one page and give equal rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._blocks import partitions, squeeze, unsqueeze
from sedgewood.llm._html import CONTAINER, MAIN, SUSPECT, read
from sedgewood.llm.url_filters import host_of

MIN_PAGES, SHARE = 4, 100
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("key", pa.int64()), ("content", pa.int64()), ("hashes", pa.list_(pa.int64())), ("payload", pa.binary())])
_OUT = "page_id long, url string, text string, n_chars long"


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def left_over(blocks: list[str], elements: list, gone: set[int]) -> list[int]:
    """The numbers of the blocks that lie in no deleted element; one that holds over half of the text is not deleted."""
    before = [0]
    for b in blocks:
        before.append(before[-1] + len(b))
    step = [0] * (len(blocks) + 1)
    for a, b, kind, h in elements:
        if kind == CONTAINER and h in gone and 2 * (before[b] - before[a]) <= before[-1]:
            step[a] += 1
            step[b] -= 1
    depth, out = 0, []
    for i, b in enumerate(blocks):
        depth += step[i]
        if not depth and b:
            out.append(i)
    return out


def main_text(blocks: list[str], elements: list, gone: set[int]) -> str:
    """The text of a page without the elements whose hashes are ``gone``."""
    alive = left_over(blocks, elements, gone)

    def weights() -> list[int]:
        have, total = set(alive), [0]
        for i, b in enumerate(blocks):
            total.append(total[-1] + (len(b) if i in have else 0))
        return total

    w = weights()
    # an article whose labels speak against it goes, unless it is most of the page
    step, depth = [0] * (len(blocks) + 1), 0
    for a, b, kind, _ in elements:
        if kind == SUSPECT and 2 * (w[b] - w[a]) < w[-1]:
            step[a] += 1
            step[b] -= 1
    inside = []
    for x in step:
        depth += x
        inside.append(depth)
    alive = [i for i in alive if not inside[i]]
    w = weights()
    mains = [(w[b] - w[a], -a, b, kind) for a, b, kind, _ in elements if kind != CONTAINER and w[b] > w[a]]
    if mains:
        weight, start, stop, kind = max(mains)
        inner = [x for x in mains if x[3] != MAIN and x[1] <= start and x[2] <= stop]
        if kind == MAIN and inner and 2 * max(inner)[0] >= weight:
            weight, start, stop, _ = max(inner)
        if 4 * weight >= w[-1]:
            alive = [i for i in alive if -start <= i < stop]
    return "\n".join(blocks[i] for i in alive)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, key (of the row), content (hash of its text), hashes of its subtrees, and blocks and elements as payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for page_id, url, host, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page = read(html or "")
                    blocks = [_clean(b) for b in page.blocks]
                    content = _hash("\n".join(blocks) if not any(e[2] != CONTAINER for e in page.elements) else main_text(blocks, page.elements, set()))
                    payload = squeeze(json.dumps([blocks, page.elements], ensure_ascii=False).encode("utf-8", "surrogatepass"))
                    out.append({"page_id": page_id, "url": url, "host": host, "key": base, "content": content, "hashes": list({e[3] for e in page.elements if e[2] == CONTAINER}), "payload": payload})
                    base += 1
                yield pa.RecordBatch.from_pylist(out, _READ)

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, host string, key long, content long, hashes array<long>, payload binary")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, share: int = SHARE) -> DataFrame:
    """(host, hash) of the subtrees(host, content, hash) that belong to a template; every page has a row with hash 0."""
    counted = subtrees.groupBy("host", "hash").agg(F.count_distinct("content").alias("n")).where(f"hash = 0 or n >= {min_pages}")
    whole = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    return counted.where("hash <> 0").join(whole, "host").where(f"{share} * n >= pages").select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: int = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    # all that follows reads this one exchange, with all its columns, so that pages are read once
    found = parsed(pages, id_col, url_col, html_col).repartition(partitions(pages.sparkSession), "key")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["key", "host", "content", "hashes"])

    listed = found.mapInArrow(split, "key long, host string, content long, hashes array<long>")
    subtrees = listed.select("key", "host", "content", F.explode(F.concat(F.array(F.lit(0)), "hashes")).alias("hash"))
    hits = subtrees.where("hash <> 0").select("key", "host", "hash").join(templates(subtrees, min_pages, share), ["host", "hash"], "left_semi").groupBy("key").agg(F.collect_set("hash").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(*json.loads(unsqueeze(x.as_py())), set(gone or ())) for x, gone in zip(batch.column("payload"), batch.column("gone").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return found.join(hits, "key", "left").mapInArrow(run, _OUT)
