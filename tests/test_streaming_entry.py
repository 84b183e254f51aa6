import pytest

import __spark_entry__ as E
from harrow.config import CurationConfig
from harrow.operators.dedupe import two_key_dedupe
from harrow.plans.curate import curate
from harrow.plans.registered import ORACLES, QUERIES
from harrow.plans.views import key_listings
from harrow.session import scratch_path
from harrow.sources.store import LISTING_STORE
from harrow.streaming.incremental import ingest_available, land_batch, run_rows


def test_two_batches_equal_one_run_and_replay_is_noop(spark):
    keys = key_listings(spark, "/root/testdata/sf0.001")
    landing, store = scratch_path(spark, "t-landing"), scratch_path(spark, "t-store")
    # The later batch is written first: the number decides, not the file time.
    land_batch(keys.where("ord >= 100"), landing, 2)
    land_batch(keys.where("ord < 100"), landing, 1)
    held = ingest_available(spark, landing, keys.schema, store)
    inc = sorted(r.ord for r in held.rows().collect())
    assert inc == sorted(r.ord for r in two_key_dedupe(keys).collect())
    # Landing the same rows again writes nothing new: the store is the state.
    land_batch(keys, landing, 3)
    ingest_available(spark, landing, keys.schema, store)
    assert sorted(r.ord for r in held.rows().collect()) == inc


def test_stream_runs_the_whole_pipeline(spark):
    rows = [(i, "S", f"AI Engineer {i % 7}", "python work " * 3, f"Co {i % 5}", "Remote", f"u{i}") for i in range(60)]
    rows.append((60, "S", "Chef", "cooking", "Co", "Remote", "u60"))
    cols = "ord long, source string, title string, description string, company string, location string, source_url string"
    df = spark.createDataFrame(rows, cols)
    cfg = CurationConfig(job_titles=("engineer",), keywords=("python",), max_jobs_per_source=None)
    landing, store = scratch_path(spark, "t-landing"), scratch_path(spark, "t-store")
    land_batch(df.where("ord < 30"), landing, 1)
    land_batch(df.where("ord >= 30"), landing, 2)
    held = ingest_available(spark, landing, df.schema, store, run_rows(cfg), LISTING_STORE)
    once = curate(df, cfg, settle=True)
    key = lambda r: (r.source_url, r.fingerprint, r.employment_type, r.experience_level, r.status)
    got = sorted(map(key, held.rows().collect()))
    assert got == sorted(map(key, once.written.collect())) and len(got) == 35
    land_batch(df, landing, 3)
    ingest_available(spark, landing, df.schema, store, run_rows(cfg), LISTING_STORE)
    assert held.rows().count() == 35


def test_unreadable_store_is_an_error(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("not parquet")
    keys = key_listings(spark, "/root/testdata/sf0.001")
    land_batch(keys, f"{tmp_path}/landing", 1)
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest_available(spark, f"{tmp_path}/landing", keys.schema, f"{tmp_path}/store")


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "fingerprint" in df.columns
    assert set(QUERIES) == set(ORACLES) <= set(E.oracle_sql()) <= set(E.queries())


def test_run_summary_invariants(spark):
    s = E.queries()["run_summary"](spark, "/root/testdata/sf0.001").first()
    assert s.found == s.filtered + s.passed_filters
    assert s.passed_filters == s.duplicates + s.written + s.errors
