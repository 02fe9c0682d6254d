"""Quality gates: policy checks against metric facts, and provenance by normalised hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passes(operator: Column, observed: Column, threshold: Column) -> Column:
    """gte and lte; any other operator raises."""
    return F.when(operator == "gte", observed >= threshold).when(operator == "lte", observed <= threshold).otherwise(F.raise_error(F.concat(F.lit("unknown operator: "), operator)).cast("boolean"))


def evaluate_policy(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """id, observed, threshold, passed. checks: id, artifact, path, operator, threshold; facts: artifact, path, value.

    A check whose metric is missing or is no number raises when the rows are read.
    """
    rows = checks.join(facts, ["artifact", "path"], "left")
    value = F.coalesce("value", F.raise_error(F.concat(F.lit("missing or not numeric: "), "path")).cast("double"))
    rows = rows.withColumn("observed", value)
    return rows.select("id", "observed", "threshold", passes(F.col("operator"), F.col("observed"), F.col("threshold")).alias("passed"))


def configuration_sha256(configuration: dict) -> str:
    """Hash of a configuration's canonical form: keys sorted, no spaces."""
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def facts_from_json(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """artifact, path, value: dotted paths looked up in JSON documents (artifact, body); true and false are no numbers."""
    rows = documents.join(paths, "artifact")
    text = F.expr("get_json_object(body, concat('$.', path))")
    return rows.select("artifact", "path", F.when(~text.isin("true", "false"), text.try_cast("double")).alias("value"))


def normalised_hashes(content: Column) -> Column:
    """(raw, lf, crlf) SHA-256 of a text whose line ends may have been changed."""
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.struct(F.sha2(content, 256).alias("raw"), F.sha2(lf, 256).alias("lf"), F.sha2(F.replace(lf, F.lit("\n"), F.lit("\r\n")), 256).alias("crlf"))


def provenance(artifacts: DataFrame) -> DataFrame:
    """id, matched (raw, lf, crlf or null), passed; local data paths are left out. artifacts: id, path, content, expected."""
    h = normalised_hashes(F.col("content"))
    rows = artifacts.where(~F.startswith("path", F.lit(".data/"))).withColumn("h", h)
    matched = F.when(F.col("h.raw") == F.col("expected"), "raw").when(F.col("h.lf") == F.col("expected"), "lf").when(F.col("h.crlf") == F.col("expected"), "crlf")
    return rows.select("id", matched.alias("matched"), matched.isNotNull().alias("passed"))
