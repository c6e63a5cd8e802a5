"""Queries on volumes that the given tables don't hold: voxels brighter than the negative's zero, a last slice cut short."""

import duckdb
import harness
import pytest

from voxloom import registry


def volume(tmp_path, rows, bright):
    path = f"{tmp_path}/embeddings.parquet"
    value = "case when x > 0.25 then x * 2.5 else x end" if bright else "x"
    duckdb.sql(f"copy (select vec_id, list_transform(embedding, lambda x: cast({value} as float)) as embedding, label from '{harness.DATA}/sf0.001/embeddings.parquet' where vec_id < {rows}) to '{path}' (format parquet)")
    return str(tmp_path)


def test_detection_from_files_below_zero(spark, tmp_path):
    d = volume(tmp_path, 266, True)
    assert harness.compare(registry.QUERIES["detect_from_files"](spark, d), registry.ORACLE["detect_from_files"], harness.duck(d)) == ""


@pytest.mark.parametrize("name", ["flt_04_blocks", "flt_04_blocks_wide", "flt_14_gaussian_u16"])
def test_last_slice_cut_short(spark, tmp_path, name):
    d = volume(tmp_path, 466, False)
    assert harness.compare(registry.QUERIES[name](spark, d), registry.ORACLE[name], harness.duck(d)) == ""
