"""One registered query per operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.fixtures import DENSE_TOLERANCES, FLAT, GRID, N_MODELS, PEAKS, TOLERANCES, Fixtures, W, ap_ctes
from catalogue.registry import cut, query
from tidegrid.config import TRAIN_PEAKS, PeakConfig
from tidegrid.functions import rolling, scalar
from tidegrid.operators import (
    blocks,
    chunks,
    downsample,
    encoding,
    evaluation,
    features,
    flat_signal,
    labels,
    model,
    predictions,
    repeats,
    runs,
    series_index,
)
from tidegrid.plans import feature_table
from tidegrid.sources import stage_store, tables
from tidegrid.staging import stage

KEYS = ["series_id"]
LENGTH = GRID.night_rows


# --- scans and joins of small tables ---------------------------------------------------
@query(
    "scan_series",
    "series_id:s step:i timestamp:s anglez:f anglez_orig:f enmo:f",
    "select series_id, step, timestamp, abs(anglez) as anglez, anglez as anglez_orig, enmo from fx_series "
    "where series_id in (select series_id from fx_labels)",
)
def scan_series(fx: Fixtures) -> DataFrame:
    ids = tables.distinct_series(fx.labels)
    return tables.with_absolute_angle(tables.read_series(fx.spark, fx.series_path, ids))


@query(
    "scan_labels",
    "series_id:s night:i event:s step:i timestamp:s",
    "select * from fx_labels where step is not null",
)
def scan_labels(fx: Fixtures) -> DataFrame:
    return tables.drop_unlabelled(tables.read_labels(fx.spark, fx.labels_csv))


@query(
    "assign_fold",
    "series_id:s step:i fold:i",
    "select series_id, step, coalesce(fold, 0) as fold from fx_series left join fx_folds using (series_id)",
)
def assign_fold(fx: Fixtures) -> DataFrame:
    return tables.assign_fold(fx.series, fx.folds)


@query("distinct_series", "series_id:s", "select distinct series_id from fx_series")
def distinct_series(fx: Fixtures) -> DataFrame:
    return tables.distinct_series(fx.series)


# --- time -------------------------------------------------------------------------------
@query(
    "local_time_parts",
    "series_id:s step:i minute:i second:i hour:i day:i year:i weekday:i",
    "select series_id, step, minute(t) as minute, second(t) as second, hour(t) as hour, day(t) as day, "
    "year(t) as year, isodow(t) as weekday from fx_time",
)
def local_time_parts(fx: Fixtures) -> DataFrame:
    return scalar.with_time_parts(fx.series)


@query(
    "half_minute_slot",
    "event_id:i hminute:i",
    "select event_id, hour(ts)*120 + minute(ts)*2 + case when second(ts) >= 30 then 1 else 0 end as hminute from events",
)
def half_minute_slot(fx: Fixtures) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = scalar.with_time_parts(fx.table("events").withColumn("timestamp", ts))
    return rows.withColumn("hminute", scalar.half_minute(F.col("hour"), F.col("minute"), F.col("second")))


@query(
    "step_first",
    "series_id:s step_first:i",
    "select series_id, step_first from fx_const where step_first is not null",
)
def step_first(fx: Fixtures) -> DataFrame:
    return series_index.step_first(fx.series, GRID)


@query(
    "night_grid",
    "series_id:s step:i step_first:i rel_step:i night:i st_hour:i st_step:i",
    "select * from fx_grid",
)
def night_grid(fx: Fixtures) -> DataFrame:
    return scalar.with_night_grid(fx.anchored, GRID)


@query(
    "prediction_night",
    "series_id:s step:i model:i num_night:i",
    "select series_id, step * 2 as step, model, 1 + cast(floor((step * 2 - step_first) / 96) as bigint) as num_night "
    "from fx_raw join fx_const using (series_id)",
)
def prediction_night(fx: Fixtures) -> DataFrame:
    rows = fx.raw.join(fx.constants.select("series_id", "step_first"), "series_id")
    rows = rows.withColumn("step", F.col("step") * GRID.downsample)
    return rows.withColumn("num_night", scalar.prediction_night(F.col("step"), F.col("step_first"), GRID))


@query(
    "fill_features",
    "series_id:s step:i with_null:f with_nan:f",
    "select series_id, step, case when anglez > 0 then enmo else 0 end as with_null, "
    "case when anglez > 0 then anglez else 0 end as with_nan from fx_series",
)
def fill_features(fx: Fixtures) -> DataFrame:
    up = F.col("anglez") > 0
    rows = fx.series.withColumns(
        {"with_null": F.when(up, F.col("enmo")), "with_nan": F.when(up, F.col("anglez")).otherwise(float("nan"))}
    )
    return scalar.fill_zero(rows, ["with_null", "with_nan"])


# --- windows at full resolution ---------------------------------------------------------
@query(
    "rolling_std",
    "series_id:s step:i spread:f",
    f"select series_id, step, case when count(*) over c = 5 then stddev_samp(abs(anglez)) over c end as spread "
    f"from fx_series window c as ({W} rows between 2 preceding and 2 following)",
)
def rolling_std(fx: Fixtures) -> DataFrame:
    return blocks.over_blocks(
        fx.indexed, KEYS, GRID.block_rows, 2, 2,
        lambda d, w: d.withColumn("spread", rolling.rolling_std("anglez", w, -2, 2)),
    )


@query("rolling_quantile", "series_id:s step:i noise_floor:f", "select * from fx_floor")
def rolling_quantile(fx: Fixtures) -> DataFrame:
    return flat_signal.noise_floor(fx.indexed, FLAT, GRID.block_rows).withColumnRenamed("pos", "step")


@query("noise_floor_ratio", "series_id:s step:i ratio:f", "select * from fx_ratio")
def noise_floor_ratio(fx: Fixtures) -> DataFrame:
    floors = flat_signal.noise_floor(fx.indexed, FLAT, GRID.block_rows)
    return flat_signal.clipped_ratio(floors, FLAT).withColumnRenamed("pos", "step")


def _angle_runs(fx: Fixtures) -> DataFrame:
    return runs.with_runs(fx.indexed.select("series_id", "pos", "step", "anglez"), KEYS, "anglez", 0.0, GRID.block_rows)


@query("run_id", "series_id:s step:i run:i", "select * from ({runs:fx_angle:a:0})")
def run_id(fx: Fixtures) -> DataFrame:
    return _angle_runs(fx)


@query("run_length", "series_id:s step:i run_len:i", "select * from ({runs:fx_angle:a:0})")
def run_length(fx: Fixtures) -> DataFrame:
    return _angle_runs(fx)


def _flat(fx: Fixtures) -> DataFrame:
    return flat_signal.flat_rows(fx.indexed, fx.constants, GRID, FLAT)


@query("run_progress", "series_id:s step:i porc_step:f group_len_c_norm:f", "select * from fx_flatfeat")
def run_progress(fx: Fixtures) -> DataFrame:
    return flat_signal.run_progress(runs.with_runs(_flat(fx), KEYS, "flat", 0.1, GRID.block_rows), GRID).withColumnRenamed(
        "pos", "step"
    )


@query("flat_signal_flag", "series_id:s step:i flat:i", "select * from fx_flat")
def flat_signal_flag(fx: Fixtures) -> DataFrame:
    return _flat(fx).withColumnRenamed("pos", "step")


@query(
    "flat_signal_features",
    "series_id:s step:i fe__check_c:f porc_step:f group_len_c_norm:f",
    "select * from fx_flatfeat",
)
def flat_signal_features(fx: Fixtures) -> DataFrame:
    return flat_signal.flat_signal_features(fx.indexed, fx.constants, GRID, FLAT).withColumnRenamed("pos", "step")


@query(
    "zscore",
    "series_id:s step:i anglez:f enmo:f anglez_orig:f",
    "select series_id, step, (abs(anglez) - anglez_mean) / anglez_sd as anglez, (enmo - enmo_mean) / enmo_sd as enmo, "
    "(anglez - orig_mean) / orig_sd as anglez_orig from fx_series join fx_const using (series_id)",
)
def zscore(fx: Fixtures) -> DataFrame:
    return series_index.zscore(fx.absolute, fx.constants, GRID)


@query("repeat_noise", "series_id:s step:i repeat:i noise:i", "select * from fx_repeat")
def repeat_noise(fx: Fixtures) -> DataFrame:
    return repeats.with_repeat_flag(fx.anchored, GRID)


@query(
    "noise_removal",
    "series_id:s step:i noise:i noise_removal:i",
    "select * from fx_noise where noise = 1",
)
def noise_removal(fx: Fixtures) -> DataFrame:
    noisy = repeats.repeated_rows(fx.anchored, GRID).withColumn("noise", F.lit(1))
    return repeats.long_noise(noisy, FLAT.noise_run, GRID.block_rows)


@query(
    "drop_trailing_noise",
    "series_id:s step:i noise:i",
    "select series_id, step, noise from (select *, max(case when noise = 0 then step end) over (partition by series_id) "
    "as last_clean from fx_repeat) where step <= last_clean",
)
def drop_trailing_noise(fx: Fixtures) -> DataFrame:
    return repeats.drop_trailing_noise(repeats.with_repeat_flag(fx.anchored, GRID))


@query(
    "drop_noisy_nights",
    "series_id:s step:i night:i noise_removal:i",
    "select series_id, step, night, noise_removal from (select *, sum(noise_removal) over (partition by series_id, night) "
    "as s from fx_noise) where not (s > 96 * 0.2 and night > -1)",
)
def drop_noisy_nights(fx: Fixtures) -> DataFrame:
    rows = scalar.with_night_grid(fx.anchored, GRID)
    noisy = repeats.long_noise(repeats.repeated_rows(fx.anchored, GRID), FLAT.noise_run, GRID.block_rows)
    rows = rows.join(noisy.select("series_id", "step", "noise_removal"), ["series_id", "step"], "left")
    return repeats.drop_noisy_nights(rows.fillna(0, ["noise_removal"]), GRID.steps_per_day, 0.2)


# --- buckets ------------------------------------------------------------------------------
BUCKET_SQL = """
  select series_id, step // 2 as step, arg_min(timestamp, step) as timestamp, arg_min(night, step) as night,
         max(st_hour) as st_hour, max(st_step) as st_step, avg(za) as anglez, avg(ze) as enmo,
         stddev_samp(za) as anglez_std_norm, stddev_samp(zo) as anglez_std_norm_orig,
         stddev_samp(ze) as enmo_std_norm, max(fe__check_c) as fe__check_c, avg(porc_step) as porc_step,
         avg(group_len_c_norm) as group_len_c_norm, sum(noise) / 2.0::double as noise,
         sum(noise_removal) / 2.0::double as noise_removal, avg(abs(anglez)) as raw_anglez
  from (select n.*, (abs(anglez) - anglez_mean) / anglez_sd as za, (enmo - enmo_mean) / enmo_sd as ze,
               (anglez - orig_mean) / orig_sd as zo, fe__check_c, porc_step, group_len_c_norm
        from fx_noise n join fx_const using (series_id)
        join fx_flatfeat using (series_id, step))
  group by series_id, step // 2"""
BUCKET_COLUMNS = (
    "series_id:s step:i timestamp:s night:i st_hour:i st_step:i anglez:f enmo:f anglez_std_norm:f "
    "anglez_std_norm_orig:f enmo_std_norm:f fe__check_c:f porc_step:f group_len_c_norm:f noise:f noise_removal:f"
)


def _n_rows(fx: Fixtures) -> int:
    return fx.constants.agg(F.sum("n_rows")).first()[0]


def _full_rows(fx: Fixtures) -> DataFrame:
    """All features at full resolution.  The three parts meet in a number of tasks that follows the rows."""
    tasks, by = blocks.tasks_for(fx.spark, _n_rows(fx)), ["series_id", "pos"]
    rows = scalar.with_night_grid(repeats.with_repeat_flag(fx.anchored, GRID), GRID)
    noisy = repeats.long_noise(repeats.repeated_rows(fx.anchored, GRID), FLAT.noise_run, GRID.block_rows)
    flat = flat_signal.flat_signal_features(fx.indexed, fx.constants, GRID, FLAT)
    rows, noisy, flat = (d.repartition(tasks, *by) for d in (rows, noisy.select(*by, "noise_removal"), flat))
    rows = rows.join(noisy, by, "left").join(flat, by)
    return series_index.zscore(rows.fillna(0, ["noise_removal"]), fx.constants, GRID)


@query("downsample", BUCKET_COLUMNS, BUCKET_SQL)
def downsample_query(fx: Fixtures) -> DataFrame:
    return downsample.downsample(_full_rows(fx), GRID)


@query("stage_reuse", BUCKET_COLUMNS, BUCKET_SQL)
def stage_reuse(fx: Fixtures) -> DataFrame:
    """Buckets from a clustered stage that the second call finds written."""

    buckets = max(8, -(-_n_rows(fx) // blocks.TASK_ROWS))  # a file fits a task at any size

    def stored(build) -> DataFrame:
        recipe = {"series": fx.series_path, "flat": repr(FLAT)}
        return stage_store.reuse_or_build(fx.spark, f"{fx.series_path}-stage", recipe, build, GRID, buckets=buckets)

    def absent() -> DataFrame:
        raise AssertionError("the stage was not reused")

    stored(lambda: _full_rows(fx))
    return downsample.downsample(stored(absent), GRID)


@query(
    "bucket_table",
    BUCKET_COLUMNS,
    f"select * replace (substring(timestamp, 1, 19) as timestamp) from ({BUCKET_SQL})",
)
def bucket_table(fx: Fixtures) -> DataFrame:
    return feature_table.bucket_table(fx.series, GRID, FLAT)


@query(
    "day_equality",
    "series_id:s step:i anglez_equal1:i anglez_equal2:i",
    f"select series_id, step, case when anglez = lag(anglez, 48) over ({W}) then 1 else 0 end as anglez_equal1, "
    f"case when anglez = lead(anglez, 48) over ({W}) then 1 else 0 end as anglez_equal2 from fx_bkt",
)
def day_equality(fx: Fixtures) -> DataFrame:
    return features.day_equality(fx.buckets, GRID)


MEDIAN_SQL = (
    "select series_id, step, case when count(anglez_std_norm) over m = 15 then median(anglez_std_norm) over m end as {out} "
    f"from fx_bkt window m as ({W} rows between {{frame}})"
)


@query(
    "rolling_median_left",
    "series_id:s step:i std_q50_left:f",
    MEDIAN_SQL.format(out="std_q50_left", frame="14 preceding and current row"),
)
def rolling_median_left(fx: Fixtures) -> DataFrame:
    return features.day_equality(fx.buckets, GRID)


@query(
    "rolling_median_right",
    "series_id:s step:i std_q50_right:f",
    MEDIAN_SQL.format(out="std_q50_right", frame="current row and 14 following"),
)
def rolling_median_right(fx: Fixtures) -> DataFrame:
    return features.day_equality(fx.buckets, GRID)


@query(
    "time_of_day_profile",
    "series_id:s step:i mean_enmo:f",
    "select g.series_id, g.step, avg(enmo) over (partition by g.series_id, st_hour, st_step) as mean_enmo from fx_grid g",
)
def time_of_day_profile(fx: Fixtures) -> DataFrame:
    return features.time_of_day_profile(scalar.with_night_grid(fx.anchored, GRID), "enmo")


BURST_SIZES = (60, 30, 15, 6)
BURST_SQL = (
    "select series_id, step, "
    + ", ".join(
        f"case when count(s{n}) over r{n} = {n} then max(s{n}) over r{n} end as anglez_diff_last_halfhour{n}"
        for n in BURST_SIZES
    )
    + " from (select series_id, step, "
    + ", ".join(f"case when count(move) over r{n} = {n} then sum(move) over r{n} end as s{n}" for n in BURST_SIZES)
    + f" from (select series_id, step, abs(anglez - lag(anglez) over ({W})) as move from fx_bkt) window "
    + ", ".join(f"r{n} as ({W} rows between {n - 1} preceding and current row)" for n in BURST_SIZES)
    + ") window "
    + ", ".join(f"r{n} as ({W} rows between {n - 1} preceding and current row)" for n in BURST_SIZES)
)
BURST_COLUMNS = " ".join(f"anglez_diff_last_halfhour{n}:f" for n in BURST_SIZES)


@query("activity_burst", f"series_id:s step:i {BURST_COLUMNS}", BURST_SQL)
def activity_burst(fx: Fixtures) -> DataFrame:
    return features.activity_burst(fx.buckets, GRID)


SCALED = (
    "(x - quantile_cont(x, 0.5) over p) / case when quantile_cont(x, 0.75) over p = quantile_cont(x, 0.25) over p then 1 "
    "else quantile_cont(x, 0.75) over p - quantile_cont(x, 0.25) over p end"
)


@query(
    "robust_scale",
    "series_id:s step:i anglez:f enmo:f",
    "select series_id, step, "
    + SCALED.replace("x", "anglez")
    + " as anglez, "
    + SCALED.replace("x", "enmo")
    + " as enmo from fx_bkt window p as (partition by series_id)",
)
def robust_scale(fx: Fixtures) -> DataFrame:
    return features.robust_scale(fx.buckets, ["anglez", "enmo"])


@query(
    "feature_hook_scaled",
    "series_id:s step:i anglez_diff_last_halfhour6:f",
    "select series_id, step, "
    + SCALED.replace("x", "anglez_diff_last_halfhour6")
    + f" as anglez_diff_last_halfhour6 from ({BURST_SQL}) window p as (partition by series_id)",
)
def feature_hook_scaled(fx: Fixtures) -> DataFrame:
    out, _ = features.apply_hook(fx.buckets, lambda d: features.activity_burst(d, GRID))
    return out


# --- labels, folds, encodings ---------------------------------------------------------------
@query("label_targets", "series_id:s step:i onset:i wakeup:i", "select * from fx_target")
def label_targets(fx: Fixtures) -> DataFrame:
    return labels.label_targets(fx.buckets, fx.labels, GRID)


@query(
    "trim_unlabelled_tail",
    "series_id:s step:i max_night:i",
    "select series_id, step, max_night from fx_bkt join (select series_id, max(night) as max_night from fx_labels "
    "where step is not null group by series_id) using (series_id) where step <= max_night * 48",
)
def trim_unlabelled_tail(fx: Fixtures) -> DataFrame:
    return labels.trim_unlabelled_tail(fx.buckets, tables.drop_unlabelled(fx.labels), GRID)


@query(
    "fold_split_valid",
    "series_id:s step:i",
    "select series_id, step from fx_bkt where series_id in (select series_id from fx_folds where fold = 2)",
)
def fold_split_valid(fx: Fixtures) -> DataFrame:
    return labels.in_fold(fx.buckets, fx.folds, 2)


@query(
    "fold_split_train",
    "series_id:s step:i",
    "select series_id, step from fx_bkt where series_id not in (select series_id from fx_folds where fold = 2)",
)
def fold_split_train(fx: Fixtures) -> DataFrame:
    return labels.out_of_fold(fx.buckets, fx.folds, 2)


@query("label_frequency_lofo", "fold:i event:s hminute:i weight:f", "select * from fx_freq")
def label_frequency_lofo(fx: Fixtures) -> DataFrame:
    return encoding.label_frequency(fx.labels, fx.folds)


def _encoding(fx: Fixtures) -> DataFrame:
    return encoding.target_encoding(encoding.label_frequency(fx.labels, fx.folds))


@query("target_encoding", "hminute:i fold:i hmin_onset:f hmin_wakeup:f", "select * from fx_enc")
def target_encoding(fx: Fixtures) -> DataFrame:
    return _encoding(fx)


@query("read_encoding", "hminute:i fold:i hmin_onset:f hmin_wakeup:f", "select * from fx_enc")
def read_encoding(fx: Fixtures) -> DataFrame:
    path = f"{fx.series_path}-encoding-csv"
    tables.write_csv(_encoding(fx), path)
    return tables.read_encoding(fx.spark, path)


def _slots(fx: Fixtures) -> DataFrame:
    rows = scalar.with_time_parts(fx.buckets)
    return rows.withColumn("hminute", scalar.half_minute(F.col("hour"), F.col("minute"), F.col("second")))


@query(
    "hminute_join",
    "series_id:s step:i hminute:i fold:i hmin_onset:f hmin_wakeup:f",
    "select s.series_id, s.step, s.hminute, s.fold, e.hmin_onset, e.hmin_wakeup from "
    "(select fx_slot.*, coalesce(f.fold, 0) as fold from fx_slot left join fx_folds f using (series_id)) s "
    "left join fx_enc e on e.hminute = s.hminute and e.fold = s.fold",
)
def hminute_join(fx: Fixtures) -> DataFrame:
    return encoding.join_encoding(tables.assign_fold(_slots(fx), fx.folds), _encoding(fx))


@query(
    "hminute_join_mean",
    "series_id:s step:i hminute:i hmin_onset:f hmin_wakeup:f",
    "select series_id, step, hminute, o as hmin_onset, w as hmin_wakeup from fx_slot left join (select hminute, "
    "avg(cast(hmin_onset as double)) as o, avg(cast(hmin_wakeup as double)) as w from fx_enc group by hminute) using (hminute)",
)
def hminute_join_mean(fx: Fixtures) -> DataFrame:
    return encoding.join_mean_encoding(_slots(fx), _encoding(fx))


# --- chunks -----------------------------------------------------------------------------------
def _targets(fx: Fixtures) -> DataFrame:
    rows = labels.label_targets(fx.buckets, fx.labels, GRID)
    return rows.select("series_id", "step", "pos", "step_first", "anglez", "enmo", "onset", "wakeup")


def _chunks(fx: Fixtures) -> DataFrame:
    return chunks.night_chunks(_targets(fx), GRID)


@query(
    "pad_first_night",
    "series_id:s step:i anglez:f is_pad:i",
    "select series_id, step, anglez, 1 - mask as is_pad from fx_chunk",
)
def pad_first_night(fx: Fixtures) -> DataFrame:
    return chunks.pad_first_night(_targets(fx), LENGTH)


@query("night_chunks", "series_id:s chunk:i slot:i step:i mask:i anglez:f", "select * from fx_chunk")
def night_chunks(fx: Fixtures) -> DataFrame:
    return _chunks(fx)


@query(
    "labelled_chunks",
    "series_id:s chunk:i slot:i step:i",
    "select series_id, chunk, slot, step from fx_chunk where (series_id, chunk) in "
    "(select (series_id, chunk) from fx_chunk where onset + wakeup > 0)",
)
def labelled_chunks(fx: Fixtures) -> DataFrame:
    return chunks.labelled_only(_chunks(fx))


REVERSED_SQL = """
  select series_id, chunk, 0 as invert, slot, step, mask, anglez, onset, wakeup from fx_chunk
  union all
  select series_id, chunk, 1, 47 - slot, step, mask, anglez, wakeup, onset from fx_chunk"""


@query(
    "reverse_augment",
    "series_id:s chunk:i invert:i slot:i step:i mask:i anglez:f onset:i wakeup:i",
    REVERSED_SQL,
)
def reverse_augment(fx: Fixtures) -> DataFrame:
    return chunks.with_reversed(_chunks(fx), LENGTH)


def _soft_sql(rows: str, sharpness: int = 1) -> str:
    kernel = ", ".join(f"({o}, {w}::double)" for o, w in chunks.SOFT_KERNELS[sharpness].items())
    return f"""
      with c as materialized ({rows}),
           k as (select * from (values {kernel}) as t(shift, weight)),
           s as (select series_id, chunk, invert, slot + shift as slot, sum(coalesce(onset, 0) * weight) as o,
                        sum(coalesce(wakeup, 0) * weight) as w
                 from c, k where onset + wakeup > 0 group by all)
      select c.series_id, c.chunk, c.invert, c.slot,
             case when coalesce(o, 0) = 1 then 2.5::double else coalesce(o, 0) end / 2.5::double as onset,
             case when coalesce(w, 0) = 1 then 2.5::double else coalesce(w, 0) end / 2.5::double as wakeup
      from c left join s on s.series_id = c.series_id and s.chunk = c.chunk and s.invert = c.invert and s.slot = c.slot"""


@query("soft_targets", "series_id:s chunk:i invert:i slot:i onset:f wakeup:f", _soft_sql(REVERSED_SQL))
def soft_targets(fx: Fixtures) -> DataFrame:
    return chunks.soft_targets(chunks.with_reversed(_chunks(fx), LENGTH))


SOFT_COLUMNS = "series_id:s chunk:i invert:i slot:i onset:f wakeup:f"


@query("soft_targets_wide", SOFT_COLUMNS, _soft_sql(REVERSED_SQL, 0))
def soft_targets_wide(fx: Fixtures) -> DataFrame:
    return chunks.soft_targets(chunks.with_reversed(_chunks(fx), LENGTH), sharpness=0)


@query("soft_targets_sharp", SOFT_COLUMNS, _soft_sql(REVERSED_SQL, 2))
def soft_targets_sharp(fx: Fixtures) -> DataFrame:
    return chunks.soft_targets(chunks.with_reversed(_chunks(fx), LENGTH), sharpness=2)


def _exploded(arrays: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("features", "target", "mask", "time")
    rows = arrays.select(*[c for c in ("series_id", "chunk", "invert") if c in arrays.columns], F.posexplode(zipped).alias("slot", "r"))
    return rows.select(
        "*", F.col("r.mask").alias("mask"), F.col("r.time").alias("time"),
        *[F.col("r.features")[i].alias(n) for i, n in enumerate(("anglez", "enmo"))],
        *[F.col("r.target")[i].alias(n) for i, n in enumerate(("onset", "wakeup"))],
    )


ARRAY_COLUMNS = "series_id:s chunk:i invert:i slot:i mask:i time:i anglez:f enmo:f onset:f wakeup:f"
ARRAY_SQL = """
    with c as materialized (select * from fx_chunk),
         d as (select distinct series_id, chunk, i as slot from c, range(0, 48) as r(i))
    select d.series_id, d.chunk, v.invert, d.slot, coalesce(c.mask, 0) as mask, coalesce(t.step, 0) as time,
           coalesce(cast(c.anglez as float), 0) as anglez, coalesce(cast(c.enmo as float), 0) as enmo,
           coalesce(case when v.invert = 1 then c.wakeup else c.onset end, 0) as onset,
           coalesce(case when v.invert = 1 then c.onset else c.wakeup end, 0) as wakeup
    from d cross join (values (0), (1)) as v(invert)
    left join c on c.series_id = d.series_id and c.chunk = d.chunk
               and c.slot = case when v.invert = 1 then 47 - d.slot else d.slot end
    left join c as t on t.series_id = d.series_id and t.chunk = d.chunk and t.slot = d.slot"""


@query("chunk_arrays", ARRAY_COLUMNS, ARRAY_SQL)
def chunk_arrays(fx: Fixtures) -> DataFrame:
    both = chunks.with_reversed(_chunks(fx), LENGTH)
    return _exploded(chunks.chunk_arrays(both, ["anglez", "enmo"], LENGTH))


@query("chunk_store", ARRAY_COLUMNS, ARRAY_SQL)
def chunk_store(fx: Fixtures) -> DataFrame:
    """Arrays written with the features in another order, read back and put in this one by the stored names."""
    path = f"{fx.series_path}-chunks"
    names = ["enmo", "anglez"]
    tables.write_chunks(chunks.chunk_arrays(chunks.with_reversed(_chunks(fx), LENGTH), names, LENGTH), path, names)
    back, stored = tables.read_chunks(fx.spark, path)
    ordered = F.transform("features", lambda x: F.array(*[x[stored.index(n)] for n in ("anglez", "enmo")]))
    return _exploded(back.withColumn("features", ordered))


@query(
    "flatten_chunks",
    "series_id:s chunk:i slot:i step:i anglez:f enmo:f",
    "select series_id, chunk, slot, step, cast(anglez as float) as anglez, cast(enmo as float) as enmo "
    "from fx_chunk where mask = 1",
)
def flatten_chunks(fx: Fixtures) -> DataFrame:
    rows = chunks.flatten_chunks(chunks.chunk_arrays(_chunks(fx), ["anglez", "enmo"], LENGTH))
    return rows.withColumns({"anglez": F.col("features")[0], "enmo": F.col("features")[1]})


VARIANT_COLUMNS = "series_id:s chunk:i invert:i slot:i step:i anglez:f onset:i wakeup:i"


def _variant_sql(name: str) -> str:
    variant = feature_table.VARIANTS[name]
    kept = "select series_id, chunk, {invert} as invert, {slot} as slot, step, anglez, {labels} from c"
    if variant.clean:
        kept += " semi join k using (series_id, chunk)"
    parts = [kept.format(invert=0, slot="slot", labels="onset, wakeup")]
    if variant.invert:
        parts.append(kept.format(invert=1, slot="47 - slot", labels="wakeup as onset, onset as wakeup"))
    trimmed = "join n using (series_id) where fx_chunk.step <= max_night * 48" if variant.train else ""
    return f"""
    with n as (select series_id, max(night) as max_night from fx_labels group by series_id),
         c as materialized (select fx_chunk.* from fx_chunk {trimmed}),
         k as (select distinct series_id, chunk from c where onset + wakeup > 0)
    {" union all ".join(parts)}"""


def _variant(fx: Fixtures, name: str) -> DataFrame:
    return feature_table.build_dataset(_targets(fx), fx.labels, feature_table.VARIANTS[name], GRID)[0]


@query("dataset_variant_clean", VARIANT_COLUMNS, _variant_sql("clean_train"))
def dataset_variant_clean(fx: Fixtures) -> DataFrame:
    return _variant(fx, "clean_train")


@query("dataset_variant_basic", VARIANT_COLUMNS, _variant_sql("basic_train"))
def dataset_variant_basic(fx: Fixtures) -> DataFrame:
    return _variant(fx, "basic_train")


@query("dataset_variant_forward", VARIANT_COLUMNS, _variant_sql("no_inv_train"))
def dataset_variant_forward(fx: Fixtures) -> DataFrame:
    return _variant(fx, "no_inv_train")


@query("dataset_variant_test", VARIANT_COLUMNS, _variant_sql("basic_test"))
def dataset_variant_test(fx: Fixtures) -> DataFrame:
    return _variant(fx, "basic_test")


# --- predictions ---------------------------------------------------------------------------
@query("ensemble_scores", "series_id:s step:i onset:f wakeup:f", "select * from fx_ens")
def ensemble_scores(fx: Fixtures) -> DataFrame:
    return predictions.ensemble_scores(fx.raw, N_MODELS)


@query("scores_long", "series_id:s step:i event:s score:f", "select * from fx_long")
def scores_long(fx: Fixtures) -> DataFrame:
    return predictions.scores_long(ensemble_scores(fx), ["series_id", "step"])


@query(
    "scores_wide",
    "series_id:s step:f onset:f wakeup:f",
    "select series_id, step, max(case when event = 'onset' then score end) as onset, "
    "max(case when event = 'wakeup' then score end) as wakeup from fx_det group by all",
)
def scores_wide(fx: Fixtures) -> DataFrame:
    return predictions.scores_wide(fx.detections, ["series_id", "step"])


def _long_positions(fx: Fixtures) -> DataFrame:
    long = predictions.scores_long(ensemble_scores(fx), ["series_id", "step"])
    return long.withColumn("pos", F.col("step"))


@query("smooth_scores", "series_id:s event:s step:i prob:f", "select * from fx_smooth")
def smooth_scores(fx: Fixtures) -> DataFrame:
    return predictions.smooth(_long_positions(fx), predictions.KEYS, "score", "prob", PEAKS)


@query("nms_peaks", "series_id:s event:s rank:i step:i prob:f", "select * from fx_peaks6")
def nms_peaks(fx: Fixtures) -> DataFrame:
    smoothed = smooth_scores(fx).withColumn("prob", cut(F.col("prob")))
    peaks = predictions.nms_peaks(smoothed, PEAKS, "prob")
    return predictions.with_rank(peaks, PEAKS, "prob")


@query("nms_plateaus", "series_id:s event:s rank:i step:i prob:f", "select * from fx_peaks_s")
def nms_plateaus(fx: Fixtures) -> DataFrame:
    """Rows without a best neighbour for many blocks on end."""
    cfg = PeakConfig(block_rows=48)
    return predictions.with_rank(predictions.nms_peaks(fx.stretched, cfg, "prob"), cfg, "prob")


def _raw_long(fx: Fixtures) -> DataFrame:
    anchored = ensemble_scores(fx).join(fx.constants.select("series_id", F.col("step_first")), "series_id")
    rows = anchored.withColumn("step_first", scalar.floor_div("step_first", GRID.downsample))
    return predictions.raw_predictions(rows, GRID)


@query("peak_picking", "series_id:s event:s step:f time:f score:f", "select * from fx_picked")
def peak_picking(fx: Fixtures) -> DataFrame:
    return predictions.pick_peaks(_raw_long(fx), GRID, PEAKS)


# the settings of validation while training, in small blocks
VALID_PEAKS = replace(TRAIN_PEAKS, block_rows=PEAKS.block_rows)


@query("peak_picking_train", "series_id:s event:s step:f time:f score:f", "select * from fx_picked5")
def peak_picking_train(fx: Fixtures) -> DataFrame:
    return predictions.pick_peaks(_raw_long(fx), GRID, VALID_PEAKS)


@query(
    "submission",
    "row_id:i series_id:s step:f event:s score:f",
    "select row_number() over (order by series_id, step, event) - 1 as row_id, series_id, step, event, score from fx_det",
)
def submission(fx: Fixtures) -> DataFrame:
    return predictions.submission(fx.detections)


# --- evaluation --------------------------------------------------------------------------------
@query(
    "evaluation_groups",
    "event:s tolerance:f series_id:s step:f score:f",
    "select e.event, tolerance, s.series_id, d.step, d.score from (select distinct series_id from fx_labels) s, "
    "(values ('onset'), ('wakeup')) as e(event), fx_tol left join fx_det d on d.series_id = s.series_id and d.event = e.event",
)
def evaluation_groups(fx: Fixtures) -> DataFrame:
    return evaluation.evaluation_groups(fx.labels, fx.detections, TOLERANCES)


def _truths(fx: Fixtures) -> DataFrame:
    return tables.drop_unlabelled(fx.labels)


@query("match_detections", "event:s tolerance:f series_id:s step:f score:f matched:i", "select * from fx_matched")
def match_detections(fx: Fixtures) -> DataFrame:
    return evaluation.match_detections(_truths(fx), fx.detections, TOLERANCES, block_steps=384)


@query(
    "match_detections_dense",
    "event:s tolerance:f series_id:s step:f score:f matched:i",
    "select * from fx_dmatched",
)
def match_detections_dense(fx: Fixtures) -> DataFrame:
    return evaluation.match_detections(_truths(fx), fx.detections, DENSE_TOLERANCES, block_steps=960)


def _ap_sql(source: str) -> str:
    return f"select event, tolerance, sum(tp / p * (c_tp / c_n)) as ap from ({ap_ctes(source)}) group by event, tolerance"


@query("average_precision", "event:s tolerance:f ap:f", _ap_sql("fx_match"))
def average_precision(fx: Fixtures) -> DataFrame:
    return evaluation.average_precision(fx.matched, _truths(fx))


@query(
    "mean_ap",
    "mean_ap:f",
    f"select sum(ap) / 2 as mean_ap from (select event, avg(ap) as ap from ({_ap_sql('fx_match')}) group by event)",
)
def mean_ap(fx: Fixtures) -> DataFrame:
    return evaluation.mean_ap(average_precision(fx), _truths(fx))


@query(
    "pr_curve",
    "event:s tolerance:f threshold:f precision:f recall:f",
    f"""
    with l as materialized (select *, max(c_tp) over (partition by event, tolerance) as hits,
                                   max(score) over (partition by event, tolerance) as best from ({ap_ctes('fx_match')}))
    select event, tolerance, score as threshold, c_tp / c_n as precision, c_tp / p as recall from l
    where c_tp - tp < hits or score = best
    union all
    select distinct event, tolerance, null, 1, 0 from l""",
)
def pr_curve(fx: Fixtures) -> DataFrame:
    return evaluation.pr_curve(fx.matched, _truths(fx))


@query(
    "event_detection_ap",
    "mean_ap:f",
    f"select sum(ap) / 2 as mean_ap from (select event, avg(ap) as ap from ({_ap_sql('fx_matched')}) group by event)",
)
def event_detection_ap(fx: Fixtures) -> DataFrame:
    score, _ = evaluation.event_detection_ap(_truths(fx), fx.detections, TOLERANCES, block_steps=384)
    return score


# --- whole builds and models -----------------------------------------------------------------
FEATURE_COLUMNS = (
    "series_id:s step:i fold:i onset:i wakeup:i step_first:i hour:i minute:i noise_removal:f enmo_std_norm:f "
    "anglez_std_norm:f anglez_std_norm_orig:f anglez_equal1:i anglez_equal2:i fe__check_c:f porc_step:f "
    "group_len_c_norm:f hmin_onset:f hmin_wakeup:f std_q50_left:f std_q50_right:f"
)
FEATURE_SQL = f"""
  with b as materialized ({BUCKET_SQL}),
       n as (select series_id, max(night) as max_night from fx_labels group by series_id),
       t as (select b.*, s.hminute, s.hour, s.minute, s.step_first,
                    case when raw_anglez = lag(raw_anglez, 48) over w then 1 else 0 end as anglez_equal1,
                    case when raw_anglez = lead(raw_anglez, 48) over w then 1 else 0 end as anglez_equal2,
                    case when count(anglez_std_norm) over l = 15 then median(anglez_std_norm) over l end as std_q50_left,
                    case when count(anglez_std_norm) over r = 15 then median(anglez_std_norm) over r end as std_q50_right
             from b join (select series_id, step, hminute, hour, minute, step_first from fx_slot) s using (series_id, step)
             window w as ({W}), l as ({W} rows between 14 preceding and current row),
                    r as ({W} rows between current row and 14 following))
  select t.*, coalesce(f.fold, 0) as fold, g.onset, g.wakeup, e.hmin_onset, e.hmin_wakeup
  from t left join fx_folds f using (series_id)
  join fx_target g using (series_id, step)
  left join fx_enc e on e.hminute = t.hminute and e.fold = coalesce(f.fold, 0)
  join n using (series_id) where t.step <= max_night * 48"""


@query("feature_table", FEATURE_COLUMNS, FEATURE_SQL)
def training_table(fx: Fixtures) -> DataFrame:
    return feature_table.training_features(fx.series, fx.labels, fx.folds, _encoding(fx), GRID, FLAT)


@query("feature_table_counted", FEATURE_COLUMNS, FEATURE_SQL)
def training_table_counted(fx: Fixtures) -> DataFrame:
    """The same build without the promise of one row per step: rows are counted."""
    grid = replace(GRID, dense_steps=False)
    return feature_table.training_features(fx.series, fx.labels, fx.folds, _encoding(fx), grid, FLAT)


SCORING_COLUMNS = FEATURE_COLUMNS.replace(" fold:i", "") + " anglez:f enmo:f"


@query(
    "scoring_table",
    SCORING_COLUMNS,
    "select t.* exclude (hmin_onset, hmin_wakeup, onset, wakeup, step_first), 0 as onset, 0 as wakeup, m.hmin_onset, m.hmin_wakeup, "
    "case when count(*) over (partition by series_id) <= 40 then 0 else t.step_first end as step_first from ("
    + FEATURE_SQL.replace("join n using (series_id) where t.step <= max_night * 48", "")
    + ") t left join (select hminute, avg(cast(hmin_onset as double)) as hmin_onset, avg(cast(hmin_wakeup as double)) as hmin_wakeup "
    "from fx_enc group by hminute) m using (hminute)",
)
def scoring_table(fx: Fixtures) -> DataFrame:
    return feature_table.scoring_features(fx.series, _encoding(fx), GRID, FLAT)


SUBSET = features.FEATURE_SETS["gru_abs_new"]


@query(
    "feature_subset",
    "series_id:s step:i " + " ".join(f"{c}:f" for c in SUBSET),
    f"select series_id, step, {', '.join(f'coalesce({c}, 0) as {c}' for c in SUBSET)} from ({FEATURE_SQL})",
)
def feature_subset(fx: Fixtures) -> DataFrame:
    return features.select_features(training_table(fx), SUBSET, keep=["series_id", "step"])


# fixed values: weights of the linear scorer used in the check
WEIGHTS, BIAS = [[0.02, 3.0], [-0.01, 5.0]], [-1.0, 0.5]


@query(
    "score_linear",
    "series_id:s chunk:i slot:i step:i onset:f wakeup:f",
    "select series_id, chunk, slot, step, "
    + ", ".join(
        f"1 / (1 + exp(-({w[0]}::double * cast(cast(anglez as float) as double) "
        f"+ {w[1]}::double * cast(cast(enmo as float) as double) + {b}::double))) as {e}"
        for w, b, e in zip(WEIGHTS, BIAS, ("onset", "wakeup"), strict=True)
    )
    + " from fx_chunk where mask = 1",
)
def score_linear(fx: Fixtures) -> DataFrame:
    arrays = chunks.chunk_arrays(_chunks(fx), ["anglez", "enmo"], LENGTH)
    rows = chunks.flatten_chunks(model.score_chunks(arrays, model.logistic_scorer(WEIGHTS, BIAS)), ["scores"])
    return rows.withColumns({"onset": F.col("scores")[0], "wakeup": F.col("scores")[1]})


MODEL_FEATURES = features.FEATURE_SETS["gru_abs"]
ROUNDS, RIDGE = 6, 1.0


def _model_rows(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Training rows (trimmed, also reversed, soft targets) and validation rows of the feature set."""
    table = feature_table.training_features(fx.series, fx.labels, fx.folds, _encoding(fx), GRID, FLAT, trim=False)
    keep = ["series_id", "step", "pos", "step_first", "onset", "wakeup"]
    table = stage(table.select(*keep, *MODEL_FEATURES), "model-features")
    train, valid = (
        feature_table.build_dataset(table, fx.labels, feature_table.VARIANTS[v], GRID)[0] for v in ("basic_train", "basic_test")
    )
    return chunks.soft_targets(train), valid


# model rows: x holds the features and 1; fold is null for series in no fold
_X = ", ".join(f"coalesce({c}, 0)::double" for c in MODEL_FEATURES)
_PLACE = "step + case when step_first > 0 and step_first <= 48 then 48 - step_first else 0 end"
FIT_SQL = f"""
  feat as materialized (
    select series_id, step, {_PLACE} as place, onset, wakeup, [{_X}, 1.0::double] as x from ({FEATURE_SQL.replace("where t.step <= max_night * 48", "")})),
  part as materialized (
    select feat.series_id, place // 48 as chunk, place % 48 as slot, onset, wakeup, x
    from feat join (select series_id, max(night) as max_night from fx_labels group by series_id) using (series_id) where step <= max_night * 48),
  soft as materialized ({_soft_sql("""
    select series_id, chunk, 0 as invert, slot, onset, wakeup from part
    union all select series_id, chunk, 1, 47 - slot, wakeup, onset from part""")}),
  fit as materialized (
    select fold, x, unnest([{{'event': 'onset', 't': least(s.onset, 1)}}, {{'event': 'wakeup', 't': least(s.wakeup, 1)}}], recursive := true)
    from soft s join part p on p.series_id = s.series_id and p.chunk = s.chunk and s.slot = case when invert = 1 then 47 - p.slot else p.slot end
    left join fx_folds f on f.series_id = s.series_id)"""


def _newton_sql(held: str) -> str:
    """Newton steps of all models: sums per matrix element, then elimination column by column."""
    n = len(MODEL_FEATURES) + 1
    solved = f"""
      select round, held, event, w, list(line order by i) as m
      from (select round, held, event, w, i,
                   list(s + case when i = j and i < {n} then {RIDGE} when j = {n + 1} and i < {n} then -{RIDGE} * w[i] else 0 end order by j) as line
            from (select round, held, event, w, i, j, sum(case when j = {n + 1} then x[i] * (t - p) else x[i] * x[j] * p * (1 - p) end) as s
                  from (select it.*, x, t, 1 / (1 + exp(-list_inner_product(x, w))) as p
                        from it join fit on fit.event = it.event and (fold is null or fold <> held) where round < {ROUNDS}),
                       range(1, {n + 1}) as a(i), range(1, {n + 2}) as b(j) group by all) group by all) group by all"""
    for k in range(1, n + 1):
        solved = f"""select round, held, event, w, list_transform(m, lambda r, i:
          list_transform(r, lambda v, j: case when i = {k} then v / m[{k}][{k}] else v - r[{k}] / m[{k}][{k}] * m[{k}][j] end)) as m from ({solved})"""
    return f"""{FIT_SQL},
  it(round, held, event, w) as (
    select 1, h, e, list_transform(range(0, {n}), lambda i: 0.0::double) from (values {held}) as t(h), (values ('onset'), ('wakeup')) as u(e)
    union all
    select round + 1, held, event, list_transform(w, lambda v, i: v + m[i][{n + 1}]) from ({solved})),
  fitted as materialized (select * from it where round = {ROUNDS})"""


@query(
    "fit_detector",
    "fold:i event:s feature:s weight:f",
    f"""with recursive {_newton_sql("(-1), (0), (1), (2), (3), (4)")}
    select held as fold, event, unnest({[*MODEL_FEATURES, "intercept"]}) as feature, unnest(w) as weight from fitted""",
)
def fit_detector(fx: Fixtures) -> DataFrame:
    train, _ = _model_rows(fx)
    train = train.join(fx.folds, "series_id", "left")
    fitted = model.fit_detectors(train, MODEL_FEATURES, range(-1, 5), rounds=ROUNDS, ridge=RIDGE)
    return model.detector_weights(fx.spark, fitted, MODEL_FEATURES)


def _oof(fx: Fixtures) -> DataFrame:
    return model.out_of_fold_predictions(*_model_rows(fx), fx.folds, MODEL_FEATURES, rounds=ROUNDS, ridge=RIDGE)


@query(
    "oof_predictions",
    "series_id:s step:i fold:i onset:f wakeup:f",
    f"""with recursive {_newton_sql("(0), (1), (2), (3), (4)")}
    select series_id, step, fold, 1 / (1 + exp(-list_inner_product(x, o.w))) as onset, 1 / (1 + exp(-list_inner_product(x, k.w))) as wakeup
    from feat join fx_folds using (series_id) join fitted o on o.held = fold and o.event = 'onset' join fitted k on k.held = fold and k.event = 'wakeup'""",
)
def oof_predictions(fx: Fixtures) -> DataFrame:
    return _oof(fx)


@query("oof_score", "mean_ap:f")
def oof_score(fx: Fixtures) -> DataFrame:
    raw = predictions.raw_predictions(
        _oof(fx).select("series_id", "step", "step_first", "onset", "wakeup"), GRID
    )
    found = predictions.pick_peaks(raw, GRID, VALID_PEAKS)
    truths = labels.in_known_folds(_truths(fx), fx.folds)
    score, _ = evaluation.event_detection_ap(truths, found, TOLERANCES, block_steps=384)
    return score
