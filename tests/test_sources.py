"""Case files, configurations, logs, tables and manifests from files on disk."""

import gzip
import hashlib
import json

import pytest

import grids
from gridloom.operators import quality
from gridloom.schemas import BOUNDARIES, EVIDENCE
from gridloom.operators import benchstats
from gridloom.sources import casefiles, configs, tables
from gridloom.streaming.runlog_stream import stream_run_log


def test_ring(spark, tmp_path):
    path = tmp_path / "ring5.m"
    path.write_text(grids.RING5)
    case = casefiles.read_case_text(spark, str(path))
    assert case.rejects.count() == 0
    bus = {r.bus_id: r for r in case.bus.collect()}
    assert [bus[i].demand_mw for i in (1, 2, 3, 4, 5)] == [60, 150, 210, 90, 30]
    assert bus[4].bus_type == 3 and len(bus) == 5
    gens = sorted(case.gen.collect(), key=lambda r: r.gen_pos)
    assert [g.parameters[0] for g in gens] == [22, 18, 35, 27, 12]
    assert [g.max_mw for g in gens] == [120, 160, 240, 300, 280]
    assert [g.generator_id for g in gens][0] == "gen_1" and gens[0].cost.model == 2
    branches = case.branch.collect()
    assert sorted(b.rate_mw for b in branches if b.rate_mw > 0) == [180, 320]
    meta = case.case_meta.first()
    assert (meta.name, meta.base_mva) == ("ring5", 100.0)
    assert meta.sha256 == hashlib.sha256(grids.RING5.encode()).hexdigest()
    assert quality.check_single_reference(case.bus).count() == 0


@pytest.mark.parametrize(
    ("old", "new", "reason"),
    [
        ("mpc.baseMVA = 100;", "", "base_mva"),
        ("\t5\t2\t30\t6", "\t5\t2\t30 ...\t6", "continuation"),
        ("\t5\t2\t30\t6", "\t5\t2\tPd\t6", "nonnumeric"),
        ("\t5\t2\t30\t6", "\t5.5\t2\t30\t6", "noninteger"),
        ("\t5\t2\t30\t6", "\t5\t2\tInf\t6", "nonfinite"),
        ("\t5\t2\t30\t6\t0\t0", "\t5\t2", "too_few_columns"),
        ("mpc.gencost", "mpc.costs", "missing_section"),
        ("\t2\t0\t0\t2\t12\t0;", "", "gencost_count"),
        ("\t2\t0\t0\t2\t12\t0;", "\t2\t0\t0\t3\t12\t0;", "parameter_count"),
        ("\t2\t0\t0\t2\t12\t0;", "\t4\t0\t0\t2\t12\t0;", "unsupported_model"),
    ],
)
def test_case_rejects(table, old, new, reason):
    text = grids.RING5.replace(old, new)
    assert text != grids.RING5
    case = casefiles.parse_case_text(table("path string, value string", [("x/a.m", text)]))
    assert reason in {r.reason for r in case.rejects.collect()}


def test_case_name_falls_back_to_the_file(table):
    found = casefiles.case_name(table("path string, value string", [("/d/grid.one.m", "mpc.x = 1;")]))
    assert found.first().name == "grid.one"


def test_configs(spark, tmp_path):
    for name, config in (("base", grids.BASE_CONFIG), ("two", grids.TWO_PERIODS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(config, indent=1))
    bad = {**grids.TWO_PERIODS, "load_multipliers": [1.0], "synthetic_extension": False}
    (tmp_path / "bad.json").write_text(json.dumps(bad, indent=1))
    (tmp_path / "broken.json").write_text('{"name": ')
    got = configs.read_operating_config(spark, str(tmp_path))
    assert got.config.count() == 2
    assert sorted(r.multiplier for r in got.period_profile.collect()) == [0.75, 1.0, 1.0]
    assert got.gen_ramp.count() == 10
    assert sorted(r.max_mw for r in got.renewable_profile.collect()) == [45.0, 70.0]
    store = got.storage.first()
    assert (store.initial_mwh, store.charge_eff, store.bus_id) == (60.0, 0.9, 1)
    assert quality.check_storage(got.storage).count() == 0
    why = {r.case_id.split("/")[-1]: set(r.reasons) for r in got.rejects.collect()}
    assert why["bad.json"] == {"load_multipliers", "unlabelled_extension"}
    assert "unreadable" in why["broken.json"]


def trajectory_record(**change):
    parts = {"primal_feasibility": 0.1, "box": 0.2, "stationarity": 0.3}
    residuals = {
        "kkt_combined_norm": 1.0,
        "normalized_combined_norm": 0.5,
        "paper_raw": parts,
        "paper_normalized": parts,
        "paper_stopping_satisfied": False,
    }
    record = {
        "record_type": "trajectory",
        "case": "c",
        "run": "r",
        "phase": "p",
        "iteration": 1,
        "inner_iteration": 1,
        "iteration_loop_elapsed_seconds": 0.1,
        "scaled_variable_objective": 1.0,
        "original_variable_objective": 2.0,
        "scaled_residuals": residuals,
        "original_residuals": residuals,
        "kkt_target_satisfied": False,
        "maximum_equality_solve_relative_residual": 0.0,
        "maximum_equality_solve_infinity_residual": 0.0,
        "minimum_original_inequality_multiplier": None,
        "sigma": 1.0,
        "restart_count": 0,
    }
    return {**record, **change}


def test_run_log_gzip_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [trajectory_record(), trajectory_record(iteration=2, sigma=0.0), {"record_type": "other"}]
    with gzip.open(log / "a.json.gz", "wt") as stream:
        stream.write("\n\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    rows, rejects = tables.read_run_log(spark, str(log))
    assert rows.count() == 3
    assert [r.record for r in rejects.collect()] == ["{broken"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_run_log(spark, str(log), out, state).awaitTermination()
    tagged = spark.read.parquet(out).collect()
    assert sorted(r.outcome for r in tagged) == ["rejected", "rejected", "rejected", "valid"]
    assert {tuple(r.reasons) for r in tagged} == {(), ("sigma",), ("record_type",), ("unreadable",)}
    with open(log / "b.json", "w") as stream:
        stream.write(json.dumps(trajectory_record(iteration=3)) + "\n")
    stream_run_log(spark, str(log), out, state).awaitTermination()
    assert spark.read.parquet(out).where("outcome = 'valid'").count() == 2


def test_csv_manifest_and_metadata(spark, table, tmp_path):
    df = table("name string, value double, n long", [('a "quoted", text', 1.5, 1), ("b", None, 2)])
    tables.write_table_csv(df, str(tmp_path / "csv"))
    back = tables.read_table_csv(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert tables.write_row_metadata(df, str(tmp_path / "rows")) == 2
    (tmp_path / "one.bin").write_bytes(b"abc")
    found = tables.file_manifest(spark, str(tmp_path / "one.bin")).first()
    assert (found.bytes, found.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def evidence_case(key, **change):
    track = {
        "timing_status": "COMPLETE",
        "correctness": {
            "status": "SUCCESS", "wall_seconds": 2.0, "iterations": 302, "restart_count": 3,
            "candidate": {"objective": 5.0, "residuals": {"kkt_combined_norm": 0.1}},
        },
        "statistics": {"count": 5, "median_seconds": 1.0},
    }
    limit = {"timing_status": "NOT_RUN", "correctness": {"status": "TIME_LIMIT", "wall_seconds": 3600.0}}
    case = {
        "key": key,
        "status": "PASS",
        "construction": {"dimensions": {"m": 10, "n": 5, "nnz_A": 150}},
        "structural_reconciliation": {"published_nnz": 200},
        "solver_tracks": {"gpu_fp64_sgs_hpr": track, "cpu_fp64_sgs_hpr": limit},
    }
    return {**case, **change}


def test_evidence_and_benchmark_table(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"stage": 7, "status": "PASS", "cases": [evidence_case("a:T4")]}, indent=1))
    (tmp_path / "list.json").write_text("not json at all")
    docs, rejects = tables.read_evidence_json(spark, str(tmp_path), EVIDENCE)
    assert rejects.count() == 1
    estimate = {"row_count": 1, "column_count": 2, "paper_nnz": 100, "exact_reconstructed_nnz": 90}
    (tmp_path / "more").mkdir()
    more = {"stage": 8, "cases": [{"key": "b:T16", "sequence": 6, "status": "MEMORY_BLOCKED", "resource_estimate": estimate}]}
    (tmp_path / "more" / "m.json").write_text(json.dumps(more))
    rest, _ = tables.read_evidence_json(spark, str(tmp_path / "more"), EVIDENCE)
    got = {r.case_key: r for r in benchstats.benchmark_table(docs, rest).collect()}
    first, second = got["a:T4"], got["b:T16"]
    assert first.nnz_difference_pct == -25.0 and first.full_lp_allocated is True
    assert (first.highs_status, first.cpu_status, first.gpu_status) == ("NOT_RUN", "TIME_LIMIT", "SUCCESS")
    assert (first.cpu_timeout_seconds, first.gpu_median_seconds, first.gpu_iterations) == (3600.0, 1.0, 302)
    assert (second.cpu_status, second.sequence, second.nnz_difference_pct) == ("SKIPPED_BY_APPROVED_SCOPE", "6", -10.0)


def test_timing_decomposition(spark, tmp_path):
    cells = {n: {"seconds": float(i), "status": "MEASURED", "method": "m"} for i, n in enumerate(benchstats.BOUNDARY_ORDER)}
    (tmp_path / "t.json").write_text(json.dumps({"timing_boundaries": {"boundaries": cells}}, indent=1))
    docs, _ = tables.read_evidence_json(spark, str(tmp_path), BOUNDARIES)
    rows = benchstats.timing_decomposition(docs).orderBy("position").collect()
    assert [r.boundary for r in rows] == list(benchstats.BOUNDARY_ORDER)
    assert [r.seconds for r in rows] == [float(i) for i in range(10)]
