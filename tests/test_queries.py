"""Registered queries against their SQL twins.

By default a cross-section runs; TESSELLA_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import check, duck

FAST = """b1_tokens b2_order b6_rename_plan b13_sparsemax b13_sparsemax_columns b15_residual b16_energy b19_channel_logits b24_class_normalise
c3_label_set_anti c7_knn c7_knn_blocks d2_tile_q90_hot d5_proto_sums d6_rollup d17_lower_median e3_avg_rank e5_ntile_bins h1_temporal_split h2_random_split
h4_lco_twins h6_protocol h7_dev_folds_singletons h13_even_sample i1_quantile_fallbacks i6_isotonic_blocks i4_argmax_f1_minmax i5_argmax_f1_probe j4_auroc_ties j5_ap
j6_fpr_at_tpr j10_bundle j11_openset j14_reliability k2_concordance l2_grid_tiles l6_corrupt l8_transforms m2_hybrid m7_sinkhorn m9_greedy_clusters a1_list_images a3_split_manifest a4_protocol a7_feature_store a9_unit_store a12_append_results a13_result_documents
a14_model_table a15_manifest_lines o20_prepare p1_stream_scores c10_mixup d3_attention_pool d3_attention_bags l3_random_tiles l4_background l5_flatten_divide o6_lco o10_openset j12_discovery j13_drift""".split()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


NAMES = list(entry.queries()) if os.environ.get("TESSELLA_ALL") else FAST


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    _, rows, issue, _ = check(spark, con, name, sf)
    assert issue is None, issue


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
