"""Times the headline queries: $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from keyloom.plans import catalog
from keyloom.session import local_session

NAMES = ["join_merge", "join_hash", "join_prehashed", "join_lookup_last", "join_lookup_first", "join_staircase", "hash_sort", "prehashed_sort", "masked_hash_sort", "uint_sort", "radix_partition_hist", "partition_offsets", "partitioned_table", "last_value_by_key", "distinct_keys", "u64_sum", "gen_strings"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(3):  # the first also compiles; the best is kept
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 4)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
