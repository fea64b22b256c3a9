"""Files of a directory tree as documents: text, CSV, JSON, DOCX, PPTX, and PDF where a parser is installed."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by loader.
TEXT_EXTENSIONS = (".txt", ".md", ".py", ".js", ".ts", ".java", ".yaml", ".yml", ".xml", ".properties")
LOADERS = {e: "TextLoader" for e in TEXT_EXTENSIONS} | {
    ".pdf": "PDFLoader", ".docx": "DocxLoader", ".pptx": "PptxLoader", ".csv": "CSVLoader", ".json": "JSONLoader",
}
SCHEMA = "file_path string, file_name string, extension string, loader_type string, page_number int, content string, error string"


def decode(raw: bytes) -> str:
    """UTF-8, or Latin-1 where that fails."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _paragraph_texts(xml: bytes, paragraph: str, run: str) -> list[str]:
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if local(p) == paragraph:
            out.append("".join(t.text or "" for t in p.iter() if local(t) == run))
    return [t for t in out if t.strip()]


def docx_pages(raw: bytes) -> list[tuple[int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(None, "\n".join(_paragraph_texts(z.read("word/document.xml"), "p", "t")))]


def pptx_pages(raw: bytes) -> list[tuple[int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted(
            (n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n.rpartition("/")[2]))
        )
        return [(k + 1, "\n".join(_paragraph_texts(z.read(n), "p", "t"))) for k, n in enumerate(slides)]


def pdf_pages(raw: bytes) -> list[tuple[int | None, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF parser is installed") from e
    return [(k + 1, p.extract_text() or "") for k, p in enumerate(PdfReader(io.BytesIO(raw)).pages)]


def csv_pages(raw: bytes) -> list[tuple[int | None, str]]:
    return [(None, pd.read_csv(io.BytesIO(raw)).to_string(index=False))]


def json_pages(raw: bytes) -> list[tuple[int | None, str]]:
    return [(None, json.dumps(json.loads(decode(raw)), indent=2, ensure_ascii=False))]


_PAGES = {
    "TextLoader": lambda raw: [(None, decode(raw))], "PDFLoader": pdf_pages, "DocxLoader": docx_pages, "PptxLoader": pptx_pages,
    "CSVLoader": csv_pages, "JSONLoader": json_pages,
}


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, name, ext, raw in zip(pdf["file_path"], pdf["file_name"], pdf["extension"], pdf["raw"]):
            kind = LOADERS[ext]
            try:
                for page, text in _PAGES[kind](bytes(raw)):
                    if text.strip():
                        out.append((path, name, ext, kind, page, text.strip(), None))
            except Exception as e:  # a broken file is reported in its row and doesn't stop the scan
                out.append((path, name, ext, kind, None, None, f"{type(e).__name__}: {e}"[:500]))
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        yield frame.astype({"page_number": "Int32"})


def load_directory(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all files below root but those whose name starts with a dot or whose extension is unknown.

    file_name is the path relative to root with forward slashes. PDF and PPTX give a row per page or
    slide; empty texts give none; a file that can't be read gives a row with error and null content.
    """
    base = "file:" + root if root.startswith("/") else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = F.regexp_replace(F.substring(F.col("p"), F.lit(len(re.sub("^file:/+", "/", base).rstrip("/")) + 2), F.length("p")), "\\\\", "/")
    own = files.select(path.alias("p"), F.col("content").alias("raw")).select(F.col("p").alias("file_path"), rel.alias("file_name"), "raw")
    own = own.withColumn("extension", F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1)))
    own = own.where(~F.element_at(F.split("file_name", "/"), -1).startswith(".") & F.col("extension").isin(*LOADERS))
    return own.mapInPandas(_load, SCHEMA)


def with_document_id(docs: DataFrame) -> DataFrame:
    """docs with an id that is the same whenever the same page of the same file is loaded."""
    return docs.withColumn("id", F.sha2(F.concat_ws("\x01", "file_name", F.coalesce("page_number", F.lit(0)).cast("string")), 256))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line of JSON; blank lines are passed over."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, sorted_keys: bool = False, nulls: bool = True) -> None:
    """Lines of JSON, in schema order or with sorted keys; null fields are written unless nulls is false."""
    own = df.select(*sorted(df.columns)) if sorted_keys else df
    own.select(F.to_json(F.struct(*own.columns), {"ignoreNullFields": str(not nulls).lower()}).alias("value")).write.mode("overwrite").text(path)


def write_results(df: DataFrame, folder: str, name: str) -> None:
    """A bounded table of results as JSON lines, CSV with a header, and a Markdown table (one file each)."""
    flat = df.select(*(F.to_json(F.col(c)).alias(c) if k[:3] in ("arr", "map", "str") and k != "string" else F.col(c) for c, k in df.dtypes)).coalesce(1)
    write_jsonl(df.coalesce(1), f"{folder}/{name}.jsonl")
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in flat.columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(flat.columns) + " |"), (1, "|" + "---|" * len(flat.columns))], "n long, value string")
    body = flat.select((F.monotonically_increasing_id() + 2).alias("n"), line.alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(f"{folder}/{name}.md")
