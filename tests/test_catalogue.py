import glob
import os

import duckdb
import pandas as pd
import pytest

from rasterlake import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_luma", "pt_chain", "pt_contrast", "pt_sepia_lineitem", "geo_rotate_left", "geo_translate_expand", "geo_resize_bilinear", "geo_rotate_any_nearest", "conv_custom5", "conv_blur_images", "agg_summed_volume", "chk_grid565", "chk_save_warnings", "codec_rgb24_core", "codec_rle4_eq_rgb4", "parse_rgb24_core", "validate_codes", "steg_roundtrip", "steg_remove", "agg_histogram", "rle_runs", "conv_custom5_tiles", "geo_resize_bicubic_tiles", "geo_rotate_any_bilinear_tiles", "geo_rotate_any_snap_tiles", "geo_skew_bicubic_tiles", "rle8_stream", "rle4_stream", "rle8_pixels", "rle4_pixels", "rle8_errors", "wu_cuts", "wu_collection", "wu_lineitem", "pipe_best_effort", "pipe_strict_status", "pipe_cached", "pipe_cached_failure", "pipe_cached_best_effort", "pipe_resumed", "pipe_resumed_best_effort", "pipe_embed_guard", "geo_resize_bicubic", "geo_rotate_any_bicubic", "geo_rotate_any_bilinear_2", "geo_skew_bicubic", "geo_skew_bilinear_1", "geo_rotate_any_snap", "geo_crop", "geo_mirror_v", "wu_palette", "parse_palette", "codec_rle8_info", "codec_rgb4_core", "codec_rgb1_core", "codec_rle8_bytes", "inspect_bytes", "inspect_report", "geo_scaled_sizes", "geo_crop_rect", "geo_crop_drag", "input_ranges", "parse_fixed_point", "chk_steg_survives", "steg_payload_view", "steg_capacity", "payload_embed", "payload_find", "payload_remove", "payload_none"]


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return v if isinstance(v, str) else float(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(repr([plain(v) for v in r]) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
