"""Reading a corpus and manifests, and the sinks: hashes, allow-lists, JSON lines, reports, caches."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import matches_any

#: Groups of a report in their order.
GROUPS = ("all", "dev", "test", "language:en", "language:pt-BR")
MAX_FILE_BYTES = 10 << 20


def load_source_manifest(path: str) -> dict:
    """A YAML manifest; its sources have ids, pinned revisions and at least one include pattern."""
    import re

    import yaml

    spec = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    ids = [s["id"] for s in spec["sources"]]
    if len(set(ids)) < len(ids):
        raise ValueError("source ids are unique")
    for s in spec["sources"]:
        if not re.fullmatch("[0-9a-f]{40}", s["revision"]) or not s.get("include"):
            raise ValueError(f"source {s['id']}: a pinned revision and an include pattern are needed")
    if not 0 < spec["max_file_bytes"] <= MAX_FILE_BYTES:
        raise ValueError("max_file_bytes is out of bounds")
    return spec


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), bytes, sha256, content of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def selected(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    return matches_any(path, include) & ~matches_any(path, exclude)


def file_violations(files: DataFrame, extensions: Sequence[str], max_bytes: int) -> DataFrame:
    """(path, rule) of files whose extension or size is not allowed."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rules = F.array_compact(F.array(F.when(~ext.isin(*extensions), F.lit("extension")), F.when(F.col("bytes") > max_bytes, F.lit("size"))))
    return files.select("path", F.explode(rules).alias("rule"))


def check_links(root: str) -> None:
    """Raise if a local folder holds symbolic links."""
    for folder, folders, names in os.walk(root.removeprefix("file://")):
        for name in (*folders, *names):
            if os.path.islink(os.path.join(folder, name)):
                raise ValueError(f"symlink is not allowed in corpus: {os.path.join(folder, name)}")


def checkout(source: dict, folder: str) -> None:
    """One pinned revision of a source's repository, without its history."""
    for args in (["init", "--quiet"], ["remote", "add", "origin", source["repository"]], ["fetch", "--quiet", "--depth", "1", "origin", source["revision"]], ["checkout", "--quiet", "--detach", "FETCH_HEAD"]):
        subprocess.run(["git", "-C", folder, *args], check=True)


def collect_source(spark: SparkSession, source: dict, root: str, extensions: Sequence[str], max_bytes: int) -> DataFrame:
    """The allowed files below root with document_id, source_id, source_path, revision, authority, license; raise on any breach."""
    if "://" not in root or root.startswith("file://"):
        check_links(root)
    files = read_files(spark, root).where(~F.col("path").rlike(r"(^|/)\.git/"))
    files = files.where(selected(F.col("path"), source["include"], source.get("exclude", ())))
    if bad := file_violations(files, extensions, max_bytes).take(1):
        raise ValueError(f"{bad[0]['rule']} is not allowed: {source['id']}/{bad[0]['path']}")
    if files.isEmpty():
        raise ValueError(f"allowlist selected zero files for source {source['id']}")
    known = [F.lit(source.get(k)).cast("string").alias(k) for k in ("revision", "authority", "license")]
    return files.select(F.concat(F.lit(source["id"] + "/"), "path").alias("document_id"), F.lit(source["id"]).alias("source_id"), F.col("path").alias("source_path"), *known, "bytes", "sha256", "content")


def acquire(spark: SparkSession, manifest: str, out: str, force: bool = False, folders: dict[str, str] | None = None) -> dict:
    """Collect all sources of a manifest (from ``folders`` by id, else by git) into a Parquet corpus; returns the derived manifest.

    An existing corpus is only replaced with force, and only if it is a folder that this function has written.
    """
    spec = load_source_manifest(manifest)
    mark = Path(out.removeprefix("file://")) / "_SUCCESS"
    if mark.parent.exists():
        if not force:
            raise FileExistsError(f"{out} exists; use force to rebuild it")
        if not mark.exists():
            raise ValueError(f"refusing to replace {out}: it is no corpus")
    with tempfile.TemporaryDirectory(prefix="siftwell-sources-") as top:
        found = None
        for source in spec["sources"]:
            root = (folders or {}).get(source["id"])
            if root is None:
                root = os.path.join(top, source["id"])
                os.mkdir(root)
                checkout(source, root)
            part = collect_source(spark, source, root, spec["allowed_extensions"], spec["max_file_bytes"])
            found = part if found is None else found.unionByName(part)
        write_corpus(found, out, force)
    rows = spark.read.parquet(out).drop("content").orderBy("document_id")
    documents = [r.asDict() for r in rows.toLocalIterator()]  # one manifest line for each file
    sources = [{k: s.get(k) for k in ("id", "repository", "revision", "license", "authority")} for s in spec["sources"]]
    return {"schema_version": spec.get("schema_version"), "sources": sources, "document_count": len(documents), "documents": documents}


def write_corpus(files: DataFrame, out: str, force: bool = False) -> None:
    files.write.mode("overwrite" if force else "errorifexists").parquet(out)


def build_index(manifest: DataFrame, files: DataFrame, out: str, max_words: int = 220, overlap: int = 40) -> DataFrame:
    """Verify every document of the manifest (document_id, source_path, sha256), chunk all, write and read the chunks.

    files: path, sha256, content. A document that is missing or has another hash raises.
    """
    from siftwell.operators.chunking import chunk_documents

    rows = manifest.join(files.select(F.col("path").alias("source_path"), F.col("sha256").alias("found"), "content"), "source_path", "left")
    if bad := rows.where(F.col("found").isNull() | (F.col("found") != F.col("sha256"))).select("document_id").take(1):
        raise ValueError(f"document {bad[0][0]} is missing or has changed")
    docs = rows.select("document_id", "source_path", F.decode("content", "UTF-8").alias("text"))
    chunk_documents(docs, max_words, overlap).write.mode("overwrite").parquet(out)
    return manifest.sparkSession.read.parquet(out)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Typed JSON lines; blank lines are skipped, a line that doesn't parse and a repeated key raise."""
    rows = spark.read.text(path).where(F.btrim("value") != "")

    def place(value: str) -> str:  # the files are read whole only to say where the fault is
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
        at = lines.where(F.regexp_replace("line", "\r$", "") == value).agg(F.min("n")).first()[0]
        return "" if at is None else f"line {at + 1}: "

    parsed = rows.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = parsed.where("r._bad is not null or r is null").select("value").take(1)
    if bad:
        raise ValueError(f"{place(bad[0][0])}not a record: {bad[0][0][:200]}")
    out = parsed.select("r.*").drop("_bad")
    if again := out.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"{key} {again[0][0]} is repeated")
    return out


def write_jsonl(rows: DataFrame, out: str, once: bool = False) -> None:
    rows.write.mode("ignore" if once else "overwrite").option("ignoreNullFields", "false").json(out)


def embed_with_cache(chunks: DataFrame, cache: str, embedder) -> DataFrame:
    """chunk_id, embedding of all chunks: what the Parquet cache lacks is embedded and appended, so a broken run is resumed.

    ``embedder`` maps pandas batches of (chunk_id, text) to (chunk_id, embedding).
    """
    spark = chunks.sparkSession
    schema = "chunk_id string, embedding array<float>"
    try:
        held = spark.read.schema(schema).parquet(cache)
        todo = chunks.join(held, "chunk_id", "left_anti")
    except AnalysisException:  # no cache yet
        todo = chunks
    todo.select("chunk_id", "text").dropDuplicates(["chunk_id"]).mapInPandas(embedder, schema).write.mode("append").parquet(cache)
    held = spark.read.schema(schema).parquet(cache).dropDuplicates(["chunk_id"])
    return chunks.select("chunk_id").join(held, "chunk_id")


def replace_index(chunks: DataFrame, index_id: str, dimensions: int, out: str) -> None:
    """Overwrite one index's partition; every chunk has one embedding of the given length."""
    if again := chunks.groupBy("chunk_id").count().where("count > 1").take(1):
        raise ValueError(f"chunk {again[0][0]} has several embeddings")
    if chunks.where(F.col("embedding").isNull() | (F.size("embedding") != dimensions)).take(1):
        raise ValueError(f"every chunk needs an embedding of {dimensions} numbers")
    rows = chunks.withColumn("index_id", F.lit(index_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_id").parquet(out)


class ResultCache:
    """Results by key for one fingerprint; another fingerprint starts empty. The file is replaced atomically."""

    def __init__(self, path: str, fingerprint: dict):
        self.path, self.fingerprint = Path(path), fingerprint
        old = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}
        self.entries: dict = old.get("entries", {}) if old.get("fingerprint") == fingerprint else {}

    def get(self, key: str):
        return self.entries.get(key)

    def put(self, key: str, value) -> None:
        self.entries[key] = value
        temporary = self.path.with_suffix(self.path.suffix + ".tmp")
        temporary.write_text(json.dumps({"fingerprint": self.fingerprint, "entries": self.entries}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        os.replace(temporary, self.path)


def seal(path: str, hashes: dict[str, str]) -> None:
    Path(path).write_text(json.dumps(hashes, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def verify_seal(path: str, hashes: dict[str, str]) -> None:
    """Raise unless the seal exists and holds the same hashes."""
    if not Path(path).exists():
        raise ValueError("calibration is not sealed")
    if json.loads(Path(path).read_text(encoding="utf-8")) != hashes:
        raise ValueError("the seal doesn't match")


def inside(root: str, relative: str) -> Path:
    """The path below root; raise if it leads out."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if base != path and base not in path.parents:
        raise ValueError(f"{relative} leads out of {root}")
    return path


def markdown_rows(summary: DataFrame, columns: Sequence[str], signed: bool = False) -> DataFrame:
    """(place, line): table lines of the groups that exist, in the report's order, three decimals."""
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group")).cast("int")
    shape = "%+.3f" if signed else "%.3f"
    cells = [F.format_string(shape, F.col(c)) for c in columns]
    return summary.where(place > 0).select(place.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", "group", F.col("case_count").cast("string"), *cells), F.lit(" |")).alias("line"))


def table_lines(head: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    """A Markdown table; numbers are set to the right, floats with three decimals, None as a dash."""
    def cell(x) -> str:
        return "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)

    right = [all(isinstance(r[i], (int, float)) or r[i] is None for r in rows) for i in range(len(head))]
    return [f"| {' | '.join(head)} |", f"|{'|'.join('---:' if x else '---' for x in right)}|", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]


def render(title: str, notes: Sequence[str], tables: Sequence[tuple[str, Sequence[str], Sequence[Sequence[object]]]], again: Sequence[str] = ()) -> list[str]:
    """Lines of a report: title, what it was run with, a section for each table, the commands that repeat it."""
    out = [f"# {title}", "", *(f"- {n}" for n in notes)]
    for name, head, rows in tables:
        out += ["", f"## {name}", "", *table_lines(head, rows)]
    return [*out, "", "## Repeat", "", "```", *again, "```"] if again else out


def write_report(report: dict, lines: Sequence[str], json_path: str, markdown_path: str) -> None:
    for path, body in ((json_path, json.dumps(report, ensure_ascii=False, indent=2)), (markdown_path, "\n".join(lines))):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(body + "\n", encoding="utf-8")
