"""Files at the edge: JSON, JSON Lines, raw volumes, and the model endpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`file, line` of every line that isn't valid: the diagnosis after a failed read."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select(F.col("_metadata.file_path").alias("file"), parsed["_bad"].alias("line")).where("line is not null")


def read_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An empty table where there is no file."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_jsonl(spark, path, schema)


def write_jsonl(df: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """JSON Lines in the order of the columns given: files sort as their rows do; `single` is for small tables."""
    rows = df.coalesce(1).sortWithinPartitions(*order) if single else df.orderBy(*order)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """One small document as a single file, two blanks of indent, written as it is spelt; folders are made and an old file is replaced."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray((json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """`path, text` of whole UTF-8 files, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))


def find_volume(spark: SparkSession, folder: str, volume: int) -> str:
    """The first file by name that holds the two-digit number of the volume."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    names = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = names.where(F.col("name").contains(f"{volume:02d}")).orderBy("name").first()
    if found is None:
        raise FileNotFoundError(f"no file of volume {volume:02d} in {folder}")
    return found.path


def log_path(path: Column, base: str = "") -> Column:
    """Forward slashes, relative to the base where it lies below it."""
    p = F.translate(path, "\\", "/")
    return F.when(p.startswith(base + "/"), F.substring(p, F.lit(len(base) + 2), F.length(p))).otherwise(p) if base else p


ANSWER = "request_id string, model string, raw string, error string"


def probe(host: str, model: str, prompt: str, timeout: int = 60) -> str:
    """One answer in one piece, to see that the endpoint is there; errors are raised."""
    body = {"model": model, "prompt": prompt, "stream": False}
    request = urllib.request.Request(f"{host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())["response"]


def generate(requests: DataFrame, host: str, timeout: int = 1800, temperature: float = 0.0, num_predict: int = 2048) -> DataFrame:
    """Answers of a model endpoint to `request_id, model, prompt`, one connection per request.

    An error becomes a row with `error`, so the run goes on. Store the result: a replay
    join then answers every later run. timeout 0 waits without limit.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for rid, model, prompt in zip(rows.request_id, rows.model, rows.prompt):
                body = {"model": model, "prompt": prompt, "stream": True, "think": False, "options": {"temperature": temperature, "num_predict": num_predict}}
                request = urllib.request.Request(f"{host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
                raw, error = "", None
                try:
                    with urllib.request.urlopen(request, timeout=timeout or None) as answer:
                        for line in answer:
                            part = json.loads(line) if line.strip() else {}
                            if part.get("error"):
                                raise RuntimeError(part["error"])
                            raw += part.get("response", "")
                            if part.get("done"):
                                break
                except (OSError, ValueError, RuntimeError) as e:
                    raw, error = None, f"{type(e).__name__}: {e}"
                out.append((rid, model, raw, error))
            yield pd.DataFrame(out, columns=["request_id", "model", "raw", "error"])

    return requests.select("request_id", "model", "prompt").mapInPandas(ask, ANSWER)
