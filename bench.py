"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "nation_balances bgp_star bgp_chain bgp_cycle filter_compare filter_regex optional_filter union_bag bind_expr subselect_topk minus_set not_exists exists_theta "
    "agg_count_distinct agg_sum_avg agg_group_concat order_limit_offset distinct_rows fn_string path_seq path_plus graph_named construct_triples set_union "
    "quads_join_filter triple_term_match rdfs_closure shacl_core srl_recursion_negation "
    "path_in_graph exists_correlated relevant_subgraph node_expression_count owl_rl_closure shacl_report shacl_rules compatible_join exists_in_bind srl_group"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quadloom.more_queries import QUERIES

    QUERIES["bgp_chain"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # the JVM compiles
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline graph queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
