"""Queries that feed streams write their input in as many files as tasks have, not one a micro-batch."""

import glob

import pytest

from corvella.plans import governance_queries, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["status_stream", "ingestion_stream"])
def test_no_task_writes_a_whole_micro_batch(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(governance_queries, "scratch_dir", lambda *_: str(tmp_path / name))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for setting in settings.items():
        spark.conf.set(*setting)
    try:
        assert registry.queries()[name](spark, SF).count() > 0
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    assert len(glob.glob(f"{tmp_path}/{name}/in/**/part-*.parquet", recursive=True)) > 4
