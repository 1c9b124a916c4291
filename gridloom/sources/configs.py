"""Operating configurations: one JSON object per file, unfolded to long tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite, reason_list
from ..schemas import OPERATING_CONFIG, with_corrupt


class ConfigTables(NamedTuple):
    config: DataFrame
    period_profile: DataFrame
    gen_ramp: DataFrame
    renewable_profile: DataFrame
    storage: DataFrame
    rejects: DataFrame


def _vector_ok(values: Column, length: Column) -> Column:
    good = F.forall(values, lambda v: finite(v) & (v >= 0))
    return F.coalesce((F.size(values) == length) & good, F.lit(False))


def config_conditions() -> list[tuple[str, Column]]:
    t = F.col("periods")
    penalties = finite("renewable_penalty_per_mwh") & (F.col("renewable_penalty_per_mwh") >= 0)
    penalties = penalties & finite("storage_loss_penalty_per_mwh") & (F.col("storage_loss_penalty_per_mwh") >= 0)

    def bad(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    def profile_ok(r: Column) -> Column:
        ordered = F.forall(F.arrays_zip(r["minimum_mw"].alias("lo"), r["maximum_mw"].alias("hi")), lambda z: z["lo"] <= z["hi"])
        return _vector_ok(r["minimum_mw"], t) & _vector_ok(r["maximum_mw"], t) & ordered

    ids = F.transform("renewables", lambda r: r["id"])
    store_ids = F.transform("storage", lambda s: s["id"])
    added = (F.size("renewables") > 0) | (F.size("storage") > 0)
    return [
        ("unreadable", F.col("_corrupt_record").isNotNull()),
        ("periods", bad(t > 0)),
        ("interval_hours", bad(finite("interval_hours") & (F.col("interval_hours") > 0))),
        ("load_multipliers", ~_vector_ok(F.col("load_multipliers"), t)),
        ("reserve_up_mw", ~_vector_ok(F.col("reserve_up_mw"), t)),
        ("reserve_down_mw", ~_vector_ok(F.col("reserve_down_mw"), t)),
        ("generator_ramps", bad(F.size("generator_ramp_up_mw_per_hour") == F.size("generator_ramp_down_mw_per_hour"))),
        ("renewable_profile", F.exists("renewables", lambda r: ~F.coalesce(profile_ok(r), F.lit(False)))),
        ("duplicate_renewable", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("duplicate_storage", F.size(F.array_distinct(store_ids)) < F.size(store_ids)),
        ("penalties", bad(penalties)),
        ("unlabelled_extension", added & ~F.coalesce("synthetic_extension", F.lit(False))),
        ("cost_mode", F.col("cost_mode") != "matpower_exact_linear"),
    ]


def unfold_config(raw: DataFrame) -> ConfigTables:
    """Tables of parsed configurations ``(case_id, <schema>, _corrupt_record)``.

    Arrays belong to one file and are unfolded where they are; nothing is regrouped.
    Storage rows keep their bounds for ``quality.check_storage``.
    """
    filled = raw.withColumns(
        {
            "renewables": F.coalesce("renewables", F.array().cast(OPERATING_CONFIG["renewables"].dataType)),
            "storage": F.coalesce("storage", F.array().cast(OPERATING_CONFIG["storage"].dataType)),
            "renewable_penalty_per_mwh": F.coalesce("renewable_penalty_per_mwh", F.lit(0.0)),
            "storage_loss_penalty_per_mwh": F.coalesce("storage_loss_penalty_per_mwh", F.lit(0.0)),
            "cost_mode": F.coalesce("cost_mode", F.lit("matpower_exact_linear")),
        }
    )
    tagged = filled.withColumn("reasons", reason_list(config_conditions()))
    good = tagged.where(F.size("reasons") == 0)
    config = good.select(
        "case_id", "name", "classification", "synthetic_extension", "periods", "interval_hours",
        F.col("renewable_penalty_per_mwh").alias("renewable_penalty"),
        F.col("storage_loss_penalty_per_mwh").alias("storage_penalty"), "cost_mode", "notes",
    )
    profile = good.select(
        "case_id",
        F.posexplode(
            F.arrays_zip(
                F.col("load_multipliers").alias("multiplier"), F.col("reserve_up_mw").alias("reserve_up"),
                F.col("reserve_down_mw").alias("reserve_down"),
            )
        ).alias("_p", "v"),
    ).select("case_id", F.col("_p").cast("bigint").alias("period"), "v.*")
    ramp = good.select(
        "case_id",
        F.posexplode(
            F.arrays_zip(
                F.col("generator_ramp_up_mw_per_hour").alias("ramp_up"),
                F.col("generator_ramp_down_mw_per_hour").alias("ramp_down"),
            )
        ).alias("_p", "v"),
    ).select("case_id", F.col("_p").cast("bigint").alias("gen_pos"), "v.*")
    green = good.select("case_id", F.posexplode("renewables").alias("_i", "r")).select(
        "case_id",
        F.col("_i").cast("bigint").alias("pos"),
        F.col("r.id").alias("resource_id"),
        F.col("r.bus_id").alias("bus_id"),
        F.posexplode(F.arrays_zip(F.col("r.minimum_mw").alias("min_mw"), F.col("r.maximum_mw").alias("max_mw"))).alias("_p", "v"),
    ).select("case_id", "pos", "resource_id", "bus_id", F.col("_p").cast("bigint").alias("period"), "v.*")
    store = good.select("case_id", F.posexplode("storage").alias("_i", "s")).select(
        "case_id",
        F.col("_i").cast("bigint").alias("pos"),
        F.col("s.id").alias("resource_id"),
        F.col("s.bus_id").alias("bus_id"),
        F.col("s.initial_energy_mwh").alias("initial_mwh"),
        F.col("s.minimum_energy_mwh").alias("min_mwh"),
        F.col("s.maximum_energy_mwh").alias("max_mwh"),
        F.col("s.maximum_charge_mw").alias("max_charge"),
        F.col("s.maximum_discharge_mw").alias("max_discharge"),
        F.col("s.charge_efficiency").alias("charge_eff"),
        F.col("s.discharge_efficiency").alias("discharge_eff"),
    )
    rejects = tagged.where(F.size("reasons") > 0).select("case_id", "reasons")
    return ConfigTables(config, profile, ramp, green, store, rejects)


def read_operating_config(spark: SparkSession, paths: str | list[str]) -> ConfigTables:
    raw = spark.read.schema(with_corrupt(OPERATING_CONFIG)).json(paths, multiLine=True)
    return unfold_config(raw.withColumn("case_id", F.col("_metadata.file_path")))
