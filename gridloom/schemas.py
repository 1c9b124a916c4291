"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

_D, _L, _S, _B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


COMPONENTS = _struct(primal_feasibility=_D, box=_D, stationarity=_D)
RESIDUALS = _struct(
    kkt_combined_norm=_D,
    normalized_combined_norm=_D,
    paper_raw=COMPONENTS,
    paper_normalized=COMPONENTS,
    paper_stopping_satisfied=_B,
)
SIGMA_UPDATE = _struct(
    attempted=_B,
    accepted=_B,
    reason=_S,
    delta_x=_D,
    delta_y=_D,
    primal_infeasibility=_D,
    dual_infeasibility=_D,
    infeasibility_ratio=_D,
    sigma_before=_D,
    sigma_after=_D,
)
_LABELS = dict(record_type=_S, case=_S, run=_S, phase=_S, iteration=_L, inner_iteration=_L)
TRAJECTORY = _struct(
    **_LABELS,
    iteration_loop_elapsed_seconds=_D,
    scaled_variable_objective=_D,
    original_variable_objective=_D,
    scaled_residuals=RESIDUALS,
    original_residuals=RESIDUALS,
    kkt_target_satisfied=_B,
    maximum_equality_solve_relative_residual=_D,
    maximum_equality_solve_infinity_residual=_D,
    minimum_original_inequality_multiplier=_D,
    sigma=_D,
    restart_count=_L,
)
POLICY_EVENT = _struct(
    **_LABELS,
    merit=_D,
    reference_merit=_D,
    previous_checkpoint_merit=_D,
    restart_reasons=T.ArrayType(_S),
    restarted=_B,
    restart_count=_L,
    sigma_update=SIGMA_UPDATE,
)
RUN_LOG = T.StructType(
    TRAJECTORY.fields + [f for f in POLICY_EVENT.fields if f.name not in TRAJECTORY.names]
)
OPERATING_CONFIG = _struct(
    name=_S,
    classification=_S,
    synthetic_extension=_B,
    periods=_L,
    interval_hours=_D,
    load_multipliers=T.ArrayType(_D),
    reserve_up_mw=T.ArrayType(_D),
    reserve_down_mw=T.ArrayType(_D),
    generator_ramp_up_mw_per_hour=T.ArrayType(_D),
    generator_ramp_down_mw_per_hour=T.ArrayType(_D),
    renewable_penalty_per_mwh=_D,
    storage_loss_penalty_per_mwh=_D,
    renewables=T.ArrayType(
        _struct(id=_S, bus_id=_L, minimum_mw=T.ArrayType(_D), maximum_mw=T.ArrayType(_D))
    ),
    storage=T.ArrayType(
        _struct(
            id=_S,
            bus_id=_L,
            initial_energy_mwh=_D,
            minimum_energy_mwh=_D,
            maximum_energy_mwh=_D,
            maximum_charge_mw=_D,
            maximum_discharge_mw=_D,
            charge_efficiency=_D,
            discharge_efficiency=_D,
        )
    ),
    cost_mode=_S,
    notes=T.ArrayType(_S),
)
STATISTICS = _struct(
    count=_L,
    median_seconds=_D,
    minimum_seconds=_D,
    maximum_seconds=_D,
    standard_deviation_seconds=_D,
    interquartile_range_seconds=_D,
    relative_range=_D,
)
TRACK = _struct(
    timing_status=_S,
    correctness=_struct(
        status=_S,
        wall_seconds=_D,
        iterations=_L,
        restart_count=_L,
        candidate=_struct(
            objective=_D,
            scaled_objective_gap_to_highs=_D,
            residuals=_struct(kkt_combined_norm=_D),
            physical_validation=_struct(maximum_violation=_D),
        ),
    ),
    statistics=STATISTICS,
)
EVIDENCE_CASE = _struct(
    key=_S,
    sequence=_L,
    status=_S,
    full_lp_allocation_attempted=_B,
    construction=_struct(dimensions=_struct(m=_L, n=_L, nnz_A=_L)),
    structural_reconciliation=_struct(published_nnz=_L),
    solver_tracks=T.MapType(_S, TRACK),
    resource_estimate=_struct(
        row_count=_L,
        column_count=_L,
        paper_nnz=_L,
        exact_reconstructed_nnz=_L,
        conservative_planning_nnz=_L,
        projected_unified_peak_bytes=_L,
    ),
)
EVIDENCE = _struct(stage=_L, status=_S, cases=T.ArrayType(EVIDENCE_CASE))
BOUNDARIES = _struct(
    timing_boundaries=_struct(
        boundaries=T.MapType(_S, _struct(seconds=_D, status=_S, method=_S))
    )
)
ANNOTATION = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("owner_key", _S, False),
        T.StructField("document_id", _S, False),
        T.StructField("section_id", _S, False),
        T.StructField("section_title", _S, False),
        T.StructField("selected_text", _S, False),
        T.StructField("start_offset", _L, False),
        T.StructField("end_offset", _L, False),
        T.StructField("prefix", _S, False),
        T.StructField("suffix", _S, False),
        T.StructField("comment", _S, False),
        T.StructField("status", _S, False),
        T.StructField("created_at", _S, False),
        T.StructField("updated_at", _S, False),
    ]
)


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The schema plus the column in which the JSON reader keeps what it cannot read."""
    return T.StructType(schema.fields + [T.StructField("_corrupt_record", _S, True)])
