"""Commands: preprocess, prompts, discover, annotate, annotate-v2, rebuild-memory, run-volume; every table is read and written as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxloom.plans import pipeline, reading, structured
from voxloom.session import DEFAULTS
from voxloom.sources import files


def weights(values: list[str]) -> list[tuple[str, float]]:
    """MODEL or MODEL=WEIGHT."""
    out = []
    for v in values:
        model, _, w = v.rpartition("=") if "=" in v else (v, "", "1")
        try:
            out.append((model, float(w)))
        except ValueError:
            raise SystemExit(f"not a weight: {v}") from None
        if not model:
            raise SystemExit(f"no model: {v}")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxloom", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("preprocess", help="raw volumes to paragraphs, dialogues, chapters, scenes")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--context", type=int, default=3)
    a.add_argument("--scene-cap", type=int, default=80)
    for verb, text in (("prompts", "write the requests of a run"), ("annotate", "stored answers and rules to speakers")):
        a = sub.add_parser(verb, help=text)
        a.add_argument("--tables", required=True)
        a.add_argument("--cards", required=True)
        a.add_argument("--output", required=True)
        a.add_argument("--model", action="append", required=True)
        a.add_argument("--memories")
        a.add_argument("--mysteries")
        if verb == "annotate":
            a.add_argument("--responses", required=True)
            a.add_argument("--structured", action="store_true")
    for verb, text in (("discover", "stored answers of scenes to characters, mysteries and memories"), ("annotate-v2", "stored answers of the second reader")):
        a = sub.add_parser(verb, help=text)
        a.add_argument("--tables", required=True)
        a.add_argument("--responses", required=True)
        a.add_argument("--output", required=True)
        a.add_argument("--model", required=True)
        if verb == "annotate-v2":
            a.add_argument("--start-chunk", type=int, default=0)
            a.add_argument("--chunk-limit", type=int)
    a = sub.add_parser("rebuild-memory", help="the character store again from stored answers")
    a.add_argument("--responses", required=True)
    a.add_argument("--output", required=True)
    a = sub.add_parser("run-volume", help="preprocess and discover in one run")
    a.add_argument("--input", required=True)
    a.add_argument("--responses", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--model", required=True)
    a.add_argument("--context", type=int, default=3)
    a.add_argument("--scene-cap", type=int, default=80)
    args = p.parse_args(argv)
    b = SparkSession.builder.appName("voxloom")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if args.verb in ("preprocess", "run-volume"):
        v = files.read_volumes(spark, args.input)
        number = F.regexp_extract("path", "([0-9]+)[^/0-9]*$", 1)
        padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)  # lpad also cuts
        out = pipeline.preprocess(v.select(F.concat(F.lit("volume_"), padded).alias("volume_id"), "text"), args.context, args.scene_cap)
        if args.verb == "run-volume":
            out |= pipeline.discovery(out["paragraphs"], out["dialogues"], spark.read.parquet(args.responses), args.model)
    elif args.verb == "rebuild-memory":
        out = {"characters": pipeline.discover(spark.read.parquet(args.responses))}
    elif args.verb in ("discover", "annotate-v2"):
        paragraphs, dialogues = (spark.read.parquet(f"{args.tables}/{n}") for n in ("paragraphs", "dialogues"))
        responses = spark.read.parquet(args.responses)
        if args.verb == "discover":
            out = pipeline.discovery(paragraphs, dialogues, responses, args.model)
        else:
            out = reading.annotate(paragraphs, dialogues, responses, args.model, args.start_chunk, args.chunk_limit)
    else:
        tables = {n: spark.read.parquet(f"{args.tables}/{n}") for n in ("dialogues", "paragraphs")}
        cards, models = spark.read.parquet(args.cards), spark.createDataFrame(weights(args.model), "model string, weight double")
        memories, mysteries = (spark.read.parquet(x) if x else None for x in (args.memories, args.mysteries))
        if args.verb == "prompts":
            out = {"requests": pipeline.requests(tables["dialogues"], cards, models, tables["paragraphs"], memories, mysteries)[0]}
        else:
            given = (tables["dialogues"], tables["paragraphs"], cards)
            responses = spark.read.parquet(args.responses)
            if args.structured:
                roles = models.withColumn("role", F.explode(F.array(*map(F.lit, structured.ROLES[:3]))))
                out = structured.annotate(*given, roles, responses, memories, mysteries)
            else:
                out = pipeline.annotate(*given, models, responses, True, memories, mysteries)
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{args.output}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
