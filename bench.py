"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyforge import catalog

SF, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, query in catalog.QUERIES.items():
        took = []
        for _ in range(3):
            began = time.time()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        out[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF}))


if __name__ == "__main__":
    main()
