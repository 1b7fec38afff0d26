"""Documents from files: parsed by suffix into titles and sections, and source code of repositories.

Files are read as binaries by Spark, each by one task, so folders of any size are spread
over the cluster. Defined cases: bytes that are no UTF-8 are replaced; unknown suffixes
give one section; files without text give no section; a PDF without a reader is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators.extract import html_sections, html_title, markdown_sections, markdown_title

# Suffixes of each kind of document.
KINDS = {".md": "markdown", ".markdown": "markdown", ".txt": "markdown", ".html": "html", ".htm": "html", ".pdf": "pdf"}
#: A reader of PDF files takes their bytes and gives the text of each page.
PdfReader = Callable[[bytes], list[str]]


def parse_document(path: str, data: bytes, pdf_pages: PdfReader | None = None) -> tuple[str, list[tuple[str, int, str, int | None]], str]:
    """(title, sections (heading, level, text, page), full text) of one file."""
    name = PurePosixPath(path)
    kind = KINDS.get(name.suffix.lower(), "other")
    if kind == "pdf":
        if pdf_pages is None:
            raise RuntimeError("reading PDF files needs a reader: pass pdf_pages")
        pages = pdf_pages(data)
        found = [(f"Page {i}", 1, t.strip(), i) for i, t in enumerate(pages, 1) if t.strip()]
        title = next((l.strip()[:100] for _, _, t, _ in found for l in t.split("\n") if l.strip()), name.stem)
        return title, found, "\n\n".join(t for _, _, t, _ in found)
    text = data.decode("utf-8", "replace")
    if kind == "markdown":
        return markdown_title(text) or name.stem, [(*s, None) for s in markdown_sections(text)], text
    if kind == "html":
        return html_title(text) or name.stem, [(*s, None) for s in html_sections(text)], text
    return name.stem, [("Full Text", 1, text, None)] if text.strip() else [], text


def read_documents(spark: SparkSession, path: str, pdf_pages: PdfReader | None = None, suffixes: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(doc_id, title, full_text, sections) of the files of a folder, or of one file; doc_id is the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    files = files.filter(wanted) if suffixes else files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_document(p, bytes(c), pdf_pages) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({
                "doc_id": b["path"], "title": [g[0] for g in got], "full_text": [g[2] for g in got],
                "sections": [[{"sec_no": i, "heading": h, "level": n, "text": t, "page": p} for i, (h, n, t, p) in enumerate(g[1], 1)] for g in got],
            })

    schema = "doc_id string, title string, full_text string, sections array<struct<sec_no:int,heading:string,level:int,text:string,page:int>>"
    return files.mapInPandas(run, schema)


def sections_table(documents: DataFrame, least_chars: int = 0) -> DataFrame:
    """(doc_id, sec_no, heading, level, text, page); sections of fewer than least_chars characters without white space at the ends are left out."""
    s = documents.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")
    return s.filter(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= least_chars) if least_chars else s


def source_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(repo, path, source) of the Python files of a repository; include and exclude are paths or folders within it."""
    base = PurePosixPath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    rel = F.expr(f"substring(path, instr(path, '{base.as_posix()}/') + {len(base.as_posix()) + 1})")
    out = files.select(F.lit(base.name).alias("repo"), rel.alias("path"), F.decode("content", "UTF-8").alias("source"))

    def within(paths: list[str]):
        hit = F.lit(False)
        for p in paths:
            hit = hit | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
        return hit

    if include:
        out = out.filter(within(include))
    return out.filter(~within(exclude)) if exclude else out
