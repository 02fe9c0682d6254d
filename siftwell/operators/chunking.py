"""Documents to chunks: word windows, Markdown sections with breadcrumbs, OpenAPI units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import windows

#: Fixed values.
MAX_WORDS, OVERLAP_WORDS, DIGEST_CHARS = 220, 40, 12
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "trace")
OPERATION_KEYS = ("summary", "description", "operationId", "tags", "parameters", "requestBody", "responses")


def chunk_id(document_id: Column, ordinal: Column, text: Column) -> Column:
    number = F.when(ordinal < 10000, F.lpad(ordinal.cast("string"), 4, "0")).otherwise(ordinal.cast("string"))
    return F.concat_ws("::", document_id, number, F.substring(F.sha2(text, 256), 1, DIGEST_CHARS))


def window_chunks(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """(document_id, heading, text) to one row for each window; the chunk's text begins with the heading's line."""
    cut = docs.select("document_id", "heading", F.posexplode(windows(F.col("text"), max_words, overlap)).alias("ordinal", "window"))
    text = F.concat_ws("\n", "heading", "window")
    return cut.select("document_id", "heading", "ordinal", text.alias("text")).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("ordinal"), F.col("text")))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def headings(docs: DataFrame) -> DataFrame:
    """(document_id, line, level, title) of every heading line; code fences are not looked at."""
    at = docs.select("document_id", F.posexplode(lines(F.col("text"))).alias("line", "value"))
    at = at.where(F.col("value").rlike(HEADING))
    return at.select("document_id", "line", F.length(F.regexp_extract("value", HEADING, 1)).alias("level"), F.regexp_extract("value", HEADING, 2).alias("title"))


def breadcrumbs(found: Column) -> Column:
    """Array of (line, level, title) in order to an array of (line, breadcrumb); a stack by position, not level."""
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<line:int,breadcrumb:string>>").alias("out"))

    def push(acc, h):
        stack = F.concat(F.slice(acc["stack"], 1, h["level"] - 1), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["line"].cast("int").alias("line"), F.array_join(stack, " > ").alias("breadcrumb")))).alias("out"))

    return F.aggregate(found, empty, push)["out"]


def heading_paths(docs: DataFrame) -> DataFrame:
    """(document_id, line, breadcrumb) of every heading."""
    by_doc = headings(docs).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("line", "level", "title"))).alias("found"))
    return by_doc.select("document_id", F.inline(breadcrumbs(F.col("found"))))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(document_id, section, heading, body): text between headings, stripped; empty sections are left out.

    docs: document_id, stem (heading of what stands before the first heading), text.
    """
    rows = docs.select("document_id", F.regexp_replace("stem", "-", " ").alias("stem"), F.posexplode(lines(F.col("text"))).alias("line", "value"))
    rows = rows.join(heading_paths(docs), ["document_id", "line"], "left")
    section = F.count("breadcrumb").over(W.partitionBy("document_id").orderBy("line"))
    rows = rows.withColumn("section", section)
    head = F.coalesce(F.max("breadcrumb"), F.max("stem"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("breadcrumb").isNull(), F.struct("line", "value")))), lambda x: x["value"]), "\n")
    out = rows.groupBy("document_id", "section").agg(head.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return out.where("body <> ''")


def _numbered(parts: DataFrame, max_words: int, overlap: int) -> DataFrame:
    """(document_id, section, heading, body) to chunks whose ordinals run through the document."""
    cut = parts.select("document_id", "section", "heading", F.posexplode(windows(F.col("body"), max_words, overlap)).alias("w", "window"))
    order = F.row_number().over(W.partitionBy("document_id").orderBy("section", "w")) - 1
    cut = cut.select("document_id", "heading", order.alias("ordinal"), F.regexp_replace(F.concat_ws("\n", "heading", "window"), r"^\s+|\s+$", "").alias("text"))
    return cut.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("ordinal"), F.col("text")))


def chunk_markdown(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    return _numbered(markdown_sections(docs), max_words, overlap)


def openapi_units(text: str) -> list[tuple[str, str]]:
    """(heading, body) of the info, every operation by path and verb, every component by type and name."""
    import yaml

    def dump(x) -> str:
        return yaml.safe_dump(x, sort_keys=True, allow_unicode=True)

    root = yaml.safe_load(text)
    if not isinstance(root, dict):
        raise ValueError("an OpenAPI document is a mapping")
    info, paths, components = (root.get(k, {}) for k in ("info", "paths", "components"))
    if not isinstance(paths, dict):
        raise ValueError("paths is a mapping")
    out = [("API information", dump(info))] if isinstance(info, dict) else []
    operations = ((path, verb, op) for path in sorted(paths) if isinstance(paths[path], dict) for verb, op in sorted(paths[path].items()) if verb.lower() in HTTP_METHODS)
    for path, verb, op in operations:
        if isinstance(op, dict):
            name = f"{verb.upper()} {path}"
            out.append((name, f"{name}\n{dump({k: op[k] for k in OPERATION_KEYS if k in op})}"))
    if isinstance(components, dict):
        out += [(f"components > {kind} > {name}", dump(group[name])) for kind, group in sorted(components.items()) if isinstance(group, dict) for name in sorted(group)]
    return out


def _openapi_batches(batches):
    import pandas as pd

    for b in batches:
        rows = [(d, k, h, body) for d, t in zip(b["document_id"], b["text"]) for k, (h, body) in enumerate(openapi_units(t))]
        yield pd.DataFrame(rows, columns=["document_id", "section", "heading", "body"])


def chunk_openapi(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """YAML needs a Python parser; the windows are cut by Spark."""
    units = docs.select("document_id", "text").mapInPandas(_openapi_batches, "document_id string, section long, heading string, body string")
    return _numbered(units, max_words, overlap)


def chunk_documents(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """By the suffix of source_path: YAML as OpenAPI, all else as Markdown. docs: document_id, source_path, text."""
    yaml_file = F.lower("source_path").rlike(r"\.ya?ml$")
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    markdown = chunk_markdown(docs.where(~yaml_file).withColumn("stem", stem), max_words, overlap).withColumn("kind", F.lit("markdown"))
    return markdown.unionByName(chunk_openapi(docs.where(yaml_file), max_words, overlap).withColumn("kind", F.lit("openapi")))
