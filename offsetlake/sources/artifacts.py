"""Benchmark result files: JSON with options, improvements, observations and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.operators.benchmarks import best_against_baseline, merge_observations

RESULT = "run string, mode string, workload string, ordering string, seq bigint, messages bigint, tps double, p99_ms double, final_lag bigint, final_gaps bigint, observations array<struct<elapsed_sec double, lag bigint, gap_count bigint>>"


def write_results(results: DataFrame, path: str, options: dict[str, str]) -> None:
    """One JSON object a file, of one benchmark's results (a few rows: an artifact is a report): options, performance_improvements (best runs against the best
    baseline), metrics_observations (of all runs) and results."""
    fields = [c for c in results.columns]
    one = results.agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in fields if c != "seq"]))).alias("results"))
    better = best_against_baseline(results)
    better = better.agg(F.array_sort(F.collect_list(F.struct(*better.columns))).alias("performance_improvements"))
    seen = merge_observations(results)
    seen = seen.agg(F.array_sort(F.collect_list(F.struct(*seen.columns))).alias("metrics_observations"))
    for table in (better, seen):  # each is one row
        one = one.withColumn("one", F.lit(1)).join(table.withColumn("one", F.lit(1)), "one").drop("one")
    shown = F.map_from_arrays(F.array(*[F.lit(k) for k in options]), F.array(*[F.lit(str(v)) for v in options.values()])) if options else F.lit(None).cast("map<string,string>")
    whole = F.struct(shown.alias("options"), "performance_improvements", "metrics_observations", "results")
    one.select(F.to_json(whole).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row a result, with the artifact's file; an artifact without a list of results raises an error."""
    raw = spark.read.schema(f"options map<string,string>, results array<struct<{RESULT.replace(' string', ':string').replace(' bigint', ':bigint').replace(' double', ':double').replace(' array', ':array')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = raw.select(F.input_file_name().alias("artifact"), F.when(F.col("results").isNotNull(), F.col("results")).otherwise(F.raise_error(F.lit("artifact without results"))).alias("results"))
    return checked.select("artifact", F.explode("results").alias("r")).select("artifact", "r.*")
