"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median of three warm runs each."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowloom import read_delimited, write_delimited
from rowloom.sources.storage import new_path

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{DIR}/lineitem.parquet")
    path = new_path(spark)
    write_delimited(lineitem, path)
    types = ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"]

    def done(df):
        df.write.format("noop").mode("overwrite").save()

    def q1(df):
        df = df.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        done(df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), F.count("*")))

    queries = {
        "export": lambda: write_delimited(lineitem, new_path(spark)),
        "read_inferred": lambda: done(read_delimited(spark, path)),
        "read_typed": lambda: done(read_delimited(spark, path, types=types)),
        "read_three_columns": lambda: done(read_delimited(spark, path, types=types, select=["l_orderkey", "l_quantity", "l_shipdate"])),
        "q1_delimited": lambda: q1(read_delimited(spark, path, types=types)),
        "q1_parquet": lambda: q1(lineitem),
    }
    took = {}
    for name, run in queries.items():
        run()
        times = []
        for _ in range(RUNS):
            began = time.time()
            run()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of medians of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
