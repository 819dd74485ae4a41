"""Queries against their DuckDB oracles. ``PACKETLOOM_ALL=1`` runs every one of them."""

import os

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

# sf0.01 decides which columns these two have
FIXED_SCALE = {"preprocess_kdd"}
QUICK = [
    "scan_classifier", "horizontal_scan_60s", "flood_rate_per_target", "flood_alerts", "detections", "decision_chain", "dedupe_detections",
    "http_payload_documents", "shellcode_test", "bidirectional_flows", "connections", "flow_reset_60s", "rate_limit", "kdd_counts_2s",
    "features_47_reset", "cic_live_features", "alert_normalise", "packet_events", "cidr_join", "prediction_gate", "alert_gate",
    "label_distribution_cum", "suggested_cap", "clean_flows", "median_impute", "missing_counts", "duplicate_count", "one_hot_all", "type_ranges",
    "preprocess_flows", "classification_report", "roc_auc", "average_precision", "majority_fallback", "split_counts", "smote_counts",
    "knn_neighbours", "prefix_join", "scan_multi_format", "stream_flow_sessions", "stream_scan_classifier", "stream_alert_fusion",
]
NAMES = sorted(set(oracle_sql()) - FIXED_SCALE) if os.environ.get("PACKETLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, con, name):
    problems, rows = compare(queries()[name](spark, sf_dir), con, oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["scan_classifier", "vertical_scan_60s", "flood_rate_10s", "bidirectional_flows", "flow_running", "kdd_counts_2s", "alert_fusion", "roc_curve", "average_precision"])
def test_chunked_scan_gives_the_same(spark, sf_dir, con, small_chunks, name):
    problems, _ = compare(queries()[name](spark, sf_dir), con, oracle_sql()[name])
    assert not problems
