"""Registered queries against DuckDB on the smallest tables, as the driver compares them on larger ones."""

import duckdb
import pytest

from quillgraph import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Those that run an operator of their own; the comparisons of kinds and literals are tested value by value elsewhere.
NAMES = [
    "match_nodes_label_and_props", "match_edges_eq_float", "match_edges_weight_range", "get_edge_of_line", "neighbors_out", "neighbors_in", "all_edge_ids", "orphan_nodes_of_regions", "label_stats_order", "property_keys_order",
    "bfs_levels", "bfs_levels_cyclic", "bfs_order", "dfs_order", "shortest_distances", "shortest_path_nodes", "oplog_replay", "logged_nodes_binary", "reopened_edges_json", "compacted_nodes_json", "json_round_trip_nodes", "binary_round_trip_edges",
    "binary_round_trip_kinds", "session_answers", "session_errors", "session_metrics", "auto_compaction", "delete_node_cascade", "txn_visibility", "checksum_skips", "txn_deletes_last", "label_folder_scan", "typed_column_scan", "script",
    "server_answers", "shared_graph", "log_stream_counts", "plan_descriptions", "plug_in_traversal",
]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(float(r[k]), 6) if isinstance(r[k], float) or type(r[k]).__name__ == "Decimal" else r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    want = tables.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    expected = rows(want.fetchall(), columns)
    assert rows(df.collect(), df.columns) == expected and expected


def test_all_but_streams_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
