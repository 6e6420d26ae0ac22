"""Text of sites cut and packed into token-bounded chunks.

Tokens are estimated as a third of the characters. A page over the limit is cut at the last
paragraph, line or word that fits; pieces of a site are then packed in order, each chunk as
full as the order allows. Pieces joined again give the page unchanged.

A site is one crawl: its pages are bounded in number (the caller sees to that), so its marked
text is one row and its packing one sequential fold over lengths, which streams without the
texts. What grows with the input is the number of sites, and they are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import CHARS_PER_TOKEN, EFFECTIVE_MAX_TOKENS, token_estimate
from quarrymill.operators.text_lines import preprocess
from quarrymill.staging import staged

# Page markers, separator, shortest useful chunk, urls kept of a chunk, hard limit.
START, END, JOINER = "--- PAGE START: ", "--- PAGE END ---", "\n\n"
MIN_CHUNK_CHARS, SOURCE_URLS, MAX_CHUNK_TOKENS = 500, 5, 20000


def marked_documents(pages: DataFrame, site: str) -> DataFrame:
    """site, text: a site's pages (pos, url, text) in order of pos, each between markers."""
    page = F.concat(F.lit(START), "url", F.lit(" ---\n"), "text", F.lit("\n" + END))
    grouped = pages.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("pos", page.alias("p")))).alias("ps"))
    return grouped.select(site, F.array_join(F.transform("ps", lambda p: p["p"]), JOINER).alias("text"))


def split_marked(docs: DataFrame, site: str) -> DataFrame:
    """Back from marked texts: site, pos, url, page. A blank part before the first marker goes."""
    parts = docs.select(site, F.posexplode(F.split("text", f"(?={START})", -1)).alias("pos", "page"))
    url = F.regexp_extract("page", START + r"([^\n]+?)(?: ---)?(?:\n|$)", 1)
    return parts.where(F.trim("page") != "").select(site, "pos", url.alias("url"), "page")


def split_text(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters that join to the text; cut after the last paragraph, line or
    space in the second half of a piece, or else inside a word."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = 0
        for mark in ("\n\n", "\n", " "):
            found = text.rfind(mark, at + limit // 2, at + limit)
            if found >= 0:
                cut = min(found + len(mark), at + limit)
                break
        cut = cut or at + limit
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def split_pages(pages: DataFrame, site: str, max_tokens: int = EFFECTIVE_MAX_TOKENS) -> DataFrame:
    """site, pos, part, url, text: pages over the limit as several rows."""
    limit = max_tokens * CHARS_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, texts = [], [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                for part, piece in enumerate(split_text(text or "", limit)):
                    rows.append(row)
                    parts.append(part)
                    texts.append(piece)
            picked = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(parts, pa.int32()), pa.array(texts, pa.string())], [site, "pos", "url", "part", "text"])

    kinds = dict(pages.dtypes)
    schema = f"{site} {kinds[site]}, pos {kinds['pos']}, url string, part int, text string"
    return pages.select(site, "pos", "url", "text").mapInArrow(run, schema)


def greedy_chunks(pieces: DataFrame, site: str, sizes: str, limit: int, joiner: int = 0) -> DataFrame:
    """``site``, pos, part, chunk_index (from 1): consecutive pieces share a chunk while their sizes,
    and ``joiner`` between them, stay within the limit."""
    kinds = dict(pieces.dtypes)
    ordered = pieces.select(site, "pos", "part", F.col(sizes).cast("long").alias("n")).repartition(site).sortWithinPartitions(site, "pos", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, index = object(), 0, 0
        for batch in batches:
            out = []
            for own, n in zip(batch[site], batch["n"]):
                if own != current:
                    current, used, index = own, n, 1
                elif used + joiner + n > limit:
                    used, index = n, index + 1
                else:
                    used += joiner + n
                out.append(index)
            yield batch[[site, "pos", "part"]].assign(chunk_index=pd.Series(out, dtype="int32"))

    return ordered.mapInPandas(run, f"{site} {kinds[site]}, pos {kinds['pos']}, part int, chunk_index int")


def chunk_pages(pages: DataFrame, site: str, max_tokens: int = EFFECTIVE_MAX_TOKENS) -> DataFrame:
    """site, chunk_index, total_chunks, content, tokens, page_source: pages (pos, url, text) in chunks.

    No chunk is over the limit, and nothing of a page is lost. page_source lists the first five urls.
    """
    # Written once: sizes and texts would each prepare and cut the pages again.
    pieces = staged(split_pages(pages, site, max_tokens), "pieces")
    sized = pieces.withColumn("n", F.char_length("text"))
    # floor(characters / 3) stays within the limit up to two characters more.
    index = greedy_chunks(sized, site, "n", max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, len(JOINER))
    totals = index.groupBy(site).agg(F.max("chunk_index").alias("total_chunks"))  # chunks are numbered from 1 without gaps
    placed = pieces.join(index.join(totals, site), [site, "pos", "part"])
    item = F.struct("pos", "part", "text", "url")
    chunks = placed.groupBy(site, "chunk_index", "total_chunks").agg(F.array_sort(F.collect_list(item)).alias("items"))
    shaped = chunks.select(
        site,
        "chunk_index",
        "total_chunks",
        F.array_join(F.transform("items", lambda i: i["text"]), JOINER).alias("content"),
        F.array_join(F.slice(F.array_distinct(F.transform("items", lambda i: i["url"])), 1, SOURCE_URLS), ",").alias("page_source"),
    )
    return shaped.select(site, "chunk_index", "total_chunks", "content", token_estimate(F.col("content")).alias("tokens"), "page_source")


def validated_chunks(chunks: DataFrame, site: str, max_tokens: int = EFFECTIVE_MAX_TOKENS) -> DataFrame:
    """site, chunk_index, total_chunks, content, tokens, page_source, issues: chunks over the limit split, all numbered anew.

    Chunks may come from anywhere. Good ones stay in the JVM; one over the limit becomes several
    with its sources, of which blank ones go, and nothing else is lost. Indices count on over
    the pieces of earlier chunks of the site. ``issues`` is what is still wrong, such as a chunk
    too short.
    """
    names = [site, "chunk_index", "part", "content", "page_source"]
    sized = chunks.select(site, "chunk_index", F.lit(0).alias("part"), F.coalesce("content", F.lit("")).alias("content"), "page_source")
    is_over = token_estimate(F.col("content")) > max_tokens
    kinds = dict(sized.dtypes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [[p for p in split_text(text, max_tokens * CHARS_PER_TOKEN) if p.strip()] for text in batch.column(3).to_pylist()]
            rows = pa.array([row for row, found in enumerate(pieces) for _ in found], pa.int64())
            part = pa.array([n for found in pieces for n in range(len(found))], pa.int32())
            text = pa.array([p for found in pieces for p in found], pa.string())
            taken = [batch.column(c).take(rows) for c in (0, 1, 4)]
            yield pa.RecordBatch.from_arrays([*taken[:2], part, text, taken[2]], names)

    cut = sized.where(is_over).mapInArrow(split, ", ".join(f"{name} {kinds[name]}" for name in names))
    whole = sized.where(~is_over).unionByName(cut)
    of_site = Window.partitionBy(site)  # a site is one crawl
    numbered = whole.withColumn("total_chunks", F.count("*").over(of_site).cast("int")).withColumn("chunk_index", F.row_number().over(of_site.orderBy("chunk_index", "part")))
    tokens = token_estimate(F.col("content"))
    return numbered.select(site, "chunk_index", "total_chunks", "content", tokens.alias("tokens"), "page_source", chunk_issues(tokens, F.col("content")).alias("issues"))


def process_content(docs: DataFrame, site: str, max_tokens: int = EFFECTIVE_MAX_TOKENS) -> DataFrame:
    """From the raw marked text of each site (site, text) to valid chunks: repeated lines and loose white space go, pages are packed, chunks validated."""
    clean = preprocess(docs.select(F.col(site).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).select(F.col("doc_id").alias(site), "text")
    pages = split_marked(clean, site).withColumnRenamed("page", "text")
    return validated_chunks(chunk_pages(pages, site, max_tokens), site, max_tokens)


def chunk_issues(tokens: Column, content: Column) -> Column:
    """What is wrong with a chunk, comma-joined; empty for a good one."""
    stripped = F.trim(F.coalesce(content, F.lit("")))
    issues = F.array(
        F.when(tokens > EFFECTIVE_MAX_TOKENS, "over_effective"),
        F.when(tokens > MAX_CHUNK_TOKENS, "over_max"),
        F.when(stripped == "", "empty"),
        F.when(F.char_length(stripped) < MIN_CHUNK_CHARS, "short"),
    )
    return F.array_join(F.array_compact(issues), ",")
