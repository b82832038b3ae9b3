"""Seconds of the headline queries: median of three runs after a warm-up; and of one build of the index, cold."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from corvane import catalog
from corvane.operators.sparse import postings, write_index
from corvane.plans.sparse import chunks

HEADLINE = ["chk_2", "txt_1", "sp_1", "sp_2", "ev_1", "dn_2", "fu_2", "fu_6", "sel_1", "ing_1", "ing_5", "gr_1", "gr_5", "ltr_1", "chk_9", "lx_4"]


def built(spark: SparkSession, sf_dir: str) -> float:
    """Seconds to build the BM25 index that sp_2 and ev_1 then find."""
    own = chunks(spark, sf_dir)
    start = time.perf_counter()
    write_index(postings(own), own.select("chunk_id"), f"file://{tempfile.mkdtemp(prefix='bench-')}/index")
    return time.perf_counter() - start


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {"index_build": round(built(spark, sf_dir), 3)}
    for name in HEADLINE:
        seconds = []
        for _ in range(4):
            start = time.perf_counter()
            catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        found[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
