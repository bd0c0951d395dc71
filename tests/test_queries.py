"""Queries against their SQL in DuckDB, at the smallest scale; a few of each family, as each takes seconds."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = (
    "j1_gated_frame_gap", "j6_support_before_after", "j14_gap_proposals", "a9_video_summary", "w5_distance_rank", "t5_best_and_runner_up", "u3_agreement",
    "m4_edge_confusion", "m9_edge_auc", "m10_edge_fates", "l4_admissible_affinity", "e4_calibrated_fusion", "g11_components", "q6_drift_field_peak", "n2_detected_pairs",
    "r6_bridge_proposals", "r8_affinity_division_recovery", "s7_submission_round_trip", "z4_windowed_stream", "q22_run_states", "m20_prune_price", "m31_score_ceiling", "m32_operating_points", "q25_corpus_audit",
    "q6_drift_field", "q7_residual_explained", "r9_fork_rankings", "r12_safe_divisions", "w22_line_fitted", "m13_simplified_counts", "m30_resolved_after_shrinking", "p21_confirmed_centres",
    "n13_offset_target_and_loss", "q14_boundaries_explained", "loss_centre_contrastive", "loss_slack_row", "loss_sigreg", "z5_sessions", "z4_sliding_windows", "t6_hardest_unmatched",
    "r10_strict_proposals", "r11_gap_proposals", "r13_fork_geometry", "r14_cytokinesis_rescue", "p32_refined_centroids", "a28_second_moments", "n4_ratio_matched_windows", "p2_p3_voxels_and_radii", "p5_p15_normalised_and_floored",
    "s5_graph_stores", "s11_candidate_coverage", "q32_registered_places", "q32_registration", "r8_runner_up_daughters", "r8_stolen_daughters",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else (round(float(v), 9) if isinstance(v, (float, np.floating)) else (int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v)))
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "tp", "fp", "fn", "jaccard"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), tables.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_voxel_queries_take_every_frame(spark):
    from tracelace.sources.tracks import Tracks

    want = {tuple(r) for r in Tracks(spark, SF).nodes.select("dataset", "t").distinct().collect()}
    got = entry.queries()["p6_frame_normalisation"](spark, SF).collect()
    assert {(r.dataset, r.t) for r in got} == want and {tuple(r.shape) for r in got} == {(16, 52, 52)}
