"""Sensor-style tables derived from ``events``, on a coarse grid.

Ten series, one row per 15 minutes, 48 buckets per night.  Each table has a Spark
builder here and a SQL twin in ``CTES``.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import FlatSignalConfig, GridConfig, PeakConfig
from tidegrid.functions.scalar import floor_div
from tidegrid.operators.blocks import with_positions
from tidegrid.operators.series_index import index_rows, series_constants
from tidegrid.sources.tables import with_absolute_angle, write_csv
from tidegrid.staging import shared_dir, stage

GRID = GridConfig(
    step_seconds=900,
    steps_per_hour=4,
    steps_per_day=96,
    downsample=2,
    dense_steps=True,
    block_rows=512,
    bucket_block_rows=256,
)
FLAT = FlatSignalConfig(
    std_rows=5,
    quantile_rows=18,
    ahead_rows=18,
    min_run=6,
    delay_rows=4,
    widen_rows=9,
    noise_run=2,
)
PEAKS = PeakConfig(block_rows=256)
TOLERANCES = {event: [1, 2, 3, 4, 5, 6, 8, 10, 11, 12] for event in ("onset", "wakeup")}
# wider than the distance of neighbouring labels, so truths compete in chains over many nights
DENSE_TOLERANCES = {event: [10, 45, 60, 100] for event in ("onset", "wakeup")}
N_MODELS = 3

START = "timestamp_ntz'2024-01-01 09:00:00'"


def stamp(step: str) -> F.Column:
    # minutes, since seconds leave the range of an integer after 68 years of steps
    t = f"timestampadd(MINUTE, cast({step} * 15 as int), {START})"
    return F.expr(f"concat(date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss\"), '-0400')")


class Fixtures:
    """Fixture tables of one scale, each written once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def series_path(self) -> str:
        events = self.table("events").select(
            (F.col("user_id") % 10).alias("sid"), "ts", "event_id", "value"
        )
        minute = floor_div(F.unix_micros(F.col("ts").cast("timestamp")), 60_000_000)
        rows = with_positions(events, ["sid"], ["ts", "event_id"], minute, "step")
        flat = floor_div("step", 64) % 5 == 3
        angle = F.when(flat, F.col("sid") * 7 - 20).otherwise(F.floor(F.col("value") * 7) % 181 - 90)
        series = rows.select(
            F.concat(F.lit("s"), F.col("sid").cast("string")).alias("series_id"),
            "step",
            stamp("step").alias("timestamp"),
            angle.cast("double").alias("anglez"),
            F.when(flat, 0.0).otherwise(F.col("value") / 1000).alias("enmo"),
        )
        path = f"{shared_dir(self.spark)}/tidegrid/fixtures/series-{uuid.uuid4().hex}"
        series.write.parquet(path)
        return path

    @cached_property
    def series(self) -> DataFrame:
        return self.spark.read.parquet(self.series_path)

    @cached_property
    def absolute(self) -> DataFrame:
        return with_absolute_angle(self.series)

    @cached_property
    def constants(self) -> DataFrame:
        return stage(series_constants(self.absolute, GRID), "constants")

    @property
    def indexed(self) -> DataFrame:
        return index_rows(self.absolute, GRID, self.constants)

    @property
    def anchored(self) -> DataFrame:
        return self.indexed.join(self.constants.select("series_id", "step_first"), "series_id")

    @cached_property
    def labels(self) -> DataFrame:
        sid = F.substring("series_id", 2, 10).cast("long")
        night = floor_div(F.col("step") - 32, 96)
        nights = (
            self.series.where("step >= 32").select("series_id", night.alias("n")).distinct().withColumn("sid", sid)
        )
        start = 32 + F.col("n") * 96
        spots = F.array(
            F.struct(F.lit("onset").alias("event"), (start + 16 + (F.col("n") * 7 + F.col("sid") * 3) % 12).alias("at")),
            F.struct(F.lit("wakeup").alias("event"), (start + 52 + (F.col("n") * 5 + F.col("sid")) % 12).alias("at")),
        )
        rows = nights.select("series_id", "n", "sid", F.inline(spots))
        step = F.when((F.col("n") + F.col("sid")) % 4 != 3, F.col("at"))
        rows = rows.select("series_id", (F.col("n") + 1).alias("night"), "event", step.alias("step"))
        return stage(rows.withColumn("timestamp", stamp("step")), "labels")

    @cached_property
    def labels_csv(self) -> str:
        path = f"{self.series_path}-labels-csv"
        write_csv(self.labels, path)
        return path

    @cached_property
    def folds(self) -> DataFrame:
        sid = F.substring("series_id", 2, 10).cast("long")
        rows = self.series.where("series_id <> 's9'").select("series_id", (sid % 5).cast("int").alias("fold"))
        return stage(rows.distinct(), "folds")

    @cached_property
    def raw(self) -> DataFrame:
        """Scores of three models per bucket."""
        keys = self.series.select("series_id", floor_div("step", 2).alias("step")).distinct()
        k = keys.withColumn("sid", F.substring("series_id", 2, 10).cast("long")).withColumn(
            "model", F.explode(F.array(*[F.lit(i) for i in range(N_MODELS)]))
        )
        s, sid, m = F.col("step"), F.col("sid"), F.col("model")
        onset = ((s * s * 37 + s * 13 + sid * 11 + m * 101) % 997).cast("double") / 997
        wakeup = ((s * s * 53 + s * 29 + sid * 17 + m * 71) % 991).cast("double") / 991
        return stage(k.select("series_id", "step", "model", onset.alias("onset"), wakeup.alias("wakeup")), "raw")

    @property
    def stretched(self) -> DataFrame:
        """Long form of made-up probabilities: plateaus of 150 rows, slopes and a saw, with ``pos``."""
        rows = self.raw.where("model = 0").select("series_id", "step", F.col("step").alias("pos"))
        s = F.col("step")
        onset = (floor_div(s, 150) * 5 % 3).cast("double") / 4
        wakeup = F.when(s % 400 < 300, s.cast("double")).otherwise((s * 7 % 40).cast("double")) / 100_000
        return rows.withColumns({"onset": onset, "wakeup": wakeup}).unpivot(["series_id", "step", "pos"], ["onset", "wakeup"], "event", "prob")

    @property
    def detections(self) -> DataFrame:
        rows = self.raw.where("model = 0")
        wide = rows.select("series_id", (F.col("step") * 2 - 0.5).alias("step"), "onset", "wakeup")
        return wide.unpivot(["series_id", "step"], ["onset", "wakeup"], "event", "score")

    @property
    def matched(self) -> DataFrame:
        """Detections with a made-up hit flag for each tolerance."""
        tol = F.explode(F.array(*[F.lit(float(t)) for t in TOLERANCES["onset"]]))
        rows = self.detections.withColumn("tolerance", tol)
        code = (F.col("step") + 0.5).cast("long") * 7 + F.col("tolerance").cast("long")
        return rows.withColumn("matched", F.when(code % 5 == 0, 1).otherwise(0))

    @cached_property
    def buckets(self) -> DataFrame:
        """A light bucket table: means, deviation, anchor, labels, position."""
        rows = self.anchored.withColumns({"_s": F.col("step"), "step": floor_div("step", 2)})
        out = rows.groupBy("series_id", "step").agg(
            F.min_by("timestamp", "_s").alias("timestamp"),
            F.avg("anglez").alias("anglez"),
            F.avg("enmo").alias("enmo"),
            F.stddev_samp("anglez").alias("anglez_std_norm"),
            floor_div(F.min("_s") - F.min("step_first"), 96).alias("night"),
            F.min("step_first").alias("step_first_full"),
        )
        out = out.withColumn("step_first", floor_div("step_first_full", 2)).withColumn("pos", F.col("step"))
        return stage(out, "light-buckets")


_cache: dict[tuple, Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = Fixtures(spark, sf_dir)
    return _cache[key]


# SQL twins of the tables above -------------------------------------------------------

STAMP = "concat(strftime(timestamp '2024-01-01 09:00:00' + to_seconds({s}*900), '%Y-%m-%dT%H:%M:%S'), '-0400')"
W = "partition by series_id order by step"

CTES: dict[str, str] = {
    "fx_series": f"""
      select concat('s', cast(sid as varchar)) as series_id, step, {STAMP.format(s='step')} as timestamp,
             cast(case when (step // 64) % 5 = 3 then sid * 7 - 20
                       else cast(floor(value * 7) as bigint) % 181 - 90 end as double) as anglez,
             case when (step // 64) % 5 = 3 then 0.0 else value / 1000 end as enmo
      from (select user_id % 10 as sid, event_id, value,
                   row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as step
            from events)""",
    "fx_labels": f"""
      select series_id, n + 1 as night, event, step,
             case when step is not null then {STAMP.format(s='step')} end as timestamp
      from (select series_id, n, event, case when (n + sid) % 4 = 3 then null else spot end as step
            from (select series_id, n, sid, 'onset' as event, 32 + n*96 + 16 + (n*7 + sid*3) % 12 as spot from fx_nights
                  union all
                  select series_id, n, sid, 'wakeup', 32 + n*96 + 52 + (n*5 + sid) % 12 from fx_nights))""",
    "fx_nights": """
      select distinct series_id, cast(substring(series_id, 2) as bigint) as sid,
             cast(floor((step - 32) / 96) as bigint) as n
      from fx_series where step >= 32""",
    "fx_folds": """
      select distinct series_id, cast(substring(series_id, 2) as bigint) % 5 as fold
      from fx_series where series_id <> 's9'""",
    "fx_raw": """
      select series_id, step, model,
             cast((step*step*37 + step*13 + sid*11 + model*101) % 997 as double) / 997 as onset,
             cast((step*step*53 + step*29 + sid*17 + model*71) % 991 as double) / 991 as wakeup
      from (select distinct series_id, cast(substring(series_id, 2) as bigint) as sid, step // 2 as step
            from fx_series), (values (0), (1), (2)) as m(model)""",
    "fx_det": """
      select series_id, step * 2 - 0.5::double as step, 'onset' as event, onset as score
      from fx_raw where model = 0
      union all
      select series_id, step * 2 - 0.5::double, 'wakeup', wakeup from fx_raw where model = 0""",
    "fx_tol": "select * from (values (1.0::double), (2.0), (3.0), (4.0), (5.0), (6.0), (8.0), (10.0), (11.0), (12.0)) as t(tolerance)",
    "fx_match": """
      select d.*, tolerance,
             case when (cast(step + 0.5 as bigint) * 7 + cast(tolerance as bigint)) % 5 = 0 then 1 else 0 end as matched
      from fx_det d, fx_tol""",
    "fx_angle": "select series_id, step, abs(anglez) as a from fx_series",
    "fx_time": """
      select *, strptime(substring(timestamp, 1, 19), '%Y-%m-%dT%H:%M:%S') as t from fx_series""",
    "fx_const": """
      select series_id, count(*) as n_rows,
             avg(abs(anglez)) as anglez_mean, stddev_samp(abs(anglez)) as anglez_sd,
             avg(anglez) as orig_mean, stddev_samp(anglez) as orig_sd,
             avg(enmo) as enmo_mean, stddev_samp(enmo) as enmo_sd,
             min(case when hour(t) = 17 and minute(t) = 0 then step end) as step_first
      from fx_time group by series_id""",
    "fx_grid": """
      select *, since // 4 as st_hour, since - since // 4 * 4 as st_step
      from (select *, case when rel_step >= 0 then rel_step - night * 96 else rel_step + 96 end as since
            from (select s.*, step_first, step - step_first as rel_step,
                         cast(floor((step - step_first) / 96) as bigint) as night
                  from fx_series s left join fx_const using (series_id)))""",
    "fx_floor": f"""
      select series_id, step, case when count(spread) over f = 18 then list_sort(list(spread) over f)[2] end as noise_floor
      from (select series_id, step, case when count(*) over c = 5 then stddev_samp(abs(anglez)) over c end as spread
            from fx_series window c as ({W} rows between 2 preceding and 2 following))
      window f as ({W} rows between 9 following and 26 following)""",
    "fx_ratio": """
      select series_id, step, noise_floor,
             case when noise_floor is not null and top <> 0
                  then least(greatest(noise_floor / top, 0.1::double), 1.0::double) end as ratio
      from (select *, max(noise_floor) over (partition by series_id) as top from fx_floor)""",
    "fx_stretch": """
      select series_id, step, ratio, case when ratio = 0.1::double and run_len > 6 then 1 else 0 end as at_floor
      from ({runs:fx_ratio:ratio:0})""",
    "fx_flat": f"""
      select series_id, step, case when count(late) over c = 9 then max(late) over c end as flat
      from (select *, lag(at_floor, 4) over ({W}) as late from fx_stretch)
      window c as ({W} rows between 4 preceding and 4 following)""",
    "fx_flatfeat": """
      select series_id, step, cast(coalesce(flat, 0) as double) as fe__check_c,
             case when coalesce(flat, 0) = 1 then run_pos / 48.0::double else -run_pos / 48.0::double end as porc_step,
             run_len / 96.0::double as group_len_c_norm
      from ({runs:fx_flat:flat:0.1})""",
    "fx_noise": """
      select *, case when noise = 1 and run_len > 2 then 1 else 0 end as noise_removal
      from ({runs:fx_repeat:noise:0})""",
    "fx_repeat": """
      select *, case when repeat > 1 then 1 else 0 end as noise
      from (select *, case when st_hour is not null then
                        count(*) over (partition by series_id, st_hour, st_step, abs(anglez)) end as repeat
            from fx_grid)""",
    "fx_bkt": """
      select series_id, step // 2 as step, arg_min(timestamp, step) as timestamp,
             avg(abs(anglez)) as anglez, avg(enmo) as enmo, stddev_samp(abs(anglez)) as anglez_std_norm,
             cast(floor((min(step) - min(step_first)) / 96) as bigint) as night, min(step_first) // 2 as step_first
      from fx_grid group by series_id, step // 2""",
    "fx_target": """
      select b.*, coalesce(onset, 0) as onset, coalesce(wakeup, 0) as wakeup
      from fx_bkt b left join (
        select series_id, step // 2 as step, max(case when event = 'onset' then 1 else 0 end) as onset,
               max(case when event = 'wakeup' then 1 else 0 end) as wakeup
        from fx_labels where step is not null group by series_id, step // 2) using (series_id, step)""",
    "fx_chunk": """
      select *, place // 48 as chunk, place % 48 as slot
      from (select *, step + case when step_first > 0 and step_first <= 48 then 48 - step_first else 0 end as place,
                   1 as mask
            from fx_target
            union all
            select series_id, step_first - 48 + i as step, null, null, null, null, null, null, null, null, i as place, 0
            from (select series_id, any_value(step_first) as step_first from fx_target group by series_id),
                 range(0, 48) as r(i)
            where step_first > 0 and i < 48 - step_first)""",
    "fx_freq": """
      select f.held as fold, event, hour(u)*120 + minute(u)*2 + case when second(u) >= 30 then 1 else 0 end as hminute,
             cast(count(*) as double) as weight
      from (select l.event, coalesce(fold, 0) as fold,
                   strptime(substring(l.timestamp, 1, 19), '%Y-%m-%dT%H:%M:%S') + to_seconds(o.off) as u
            from fx_labels l left join fx_folds using (series_id), (values (0), (-30)) as o(off)
            where step is not null), range(0, 5) as f(held)
      where fold <> f.held group by all""",
    "fx_enc": """
      select hminute, fold, cast(onset / max(onset) over () as float) as hmin_onset,
             cast(wakeup / max(wakeup) over () as float) as hmin_wakeup
      from (select hminute, fold, sum(case when event = 'onset' then weight else 0 end) as onset,
                   sum(case when event = 'wakeup' then weight else 0 end) as wakeup
            from fx_freq group by hminute, fold)""",
    "fx_slot": """
      select *, hour(t)*120 + minute(t)*2 + case when second(t) >= 30 then 1 else 0 end as hminute,
             hour(t) as hour, minute(t) as minute
      from (select *, strptime(substring(timestamp, 1, 19), '%Y-%m-%dT%H:%M:%S') as t from fx_bkt)""",
    "fx_ens": """
      select series_id, step, sum(onset / 3) + sum(case when onset > 0.1 then onset else 0 end) as onset,
             sum(wakeup / 3) + sum(case when wakeup > 0.1 then wakeup else 0 end) as wakeup
      from fx_raw group by series_id, step""",
    "fx_long": """
      select series_id, step, 'onset' as event, onset as score from fx_ens
      union all select series_id, step, 'wakeup', wakeup from fx_ens""",
    "fx_smooth": """
      select series_id, event, step,
             coalesce(case when count(once) over w = 7 then avg(once) over w end, 0) as prob
      from (select series_id, event, step,
                   coalesce(case when count(score) over v = 7 then avg(score) over v end, 0) as once
            from fx_long
            window v as (partition by series_id, event order by step rows between 3 preceding and 3 following))
      window w as (partition by series_id, event order by step rows between 3 preceding and 3 following)""",
    # greedy suppression, one pick per group and round
    "rec_pick": """
      select series_id, event, cast(-1 as bigint) as rank, cast([] as bigint[]) as kept from fx_smooth
      group by series_id, event
      union all
      select p.series_id, p.event, p.rank + 1,
             list_append(any_value(p.kept), arg_min(s.step, {'a': -s.prob, 'b': s.step}))
      from rec_pick p join fx_smooth s on p.series_id = s.series_id and p.event = s.event
      where len(list_filter(p.kept, lambda k: abs(k - s.step) <= 11)) = 0
      group by p.series_id, p.event, p.rank""",
    "fx_peaks": """
      select p.series_id, p.event, p.rank, s.step, s.prob
      from rec_pick p join fx_smooth s on p.series_id = s.series_id and p.event = s.event and s.step = p.kept[-1]
      where p.rank >= 0""",
    "fx_picked": """
      select series_id, event, step * 2 - 0.5::double as step, (step * 2 - 0.5::double) / (60 / 900.0::double) as time, prob as score
      from (select *, quantile_cont(prob, 0.87) over (partition by series_id, event) as lim from fx_peaks)
      where prob > lim""",
    "fx_ranked": """
      select event, tolerance, d.series_id, step, score,
             row_number() over (partition by event, tolerance, d.series_id order by score desc, step) as rn
      from fx_det d, fx_tol where d.series_id in (select series_id from fx_labels where step is not null)""",
    # greedy matching, one detection per group and round
    "rec_match": """
      select event, tolerance, series_id, cast(0 as bigint) as rn, cast(null as double) as step,
             cast(null as double) as score, cast([] as bigint[]) as used, cast(null as bigint) as hit
      from fx_ranked group by event, tolerance, series_id
      union all
      select event, tolerance, series_id, rn, step, score,
             case when hit is null then used else list_append(used, hit) end, hit
      from (select d.event, d.tolerance, d.series_id, d.rn, d.step, d.score, any_value(m.used) as used,
                   arg_min(t.step, {'a': abs(t.step - d.step), 'b': t.step})
                     filter (where abs(t.step - d.step) < d.tolerance and not list_contains(m.used, t.step)) as hit
            from rec_match m
            join fx_ranked d on d.event = m.event and d.tolerance = m.tolerance and d.series_id = m.series_id
                            and d.rn = m.rn + 1
            left join fx_labels t on t.event = d.event and t.series_id = d.series_id and t.step is not null
            group by d.event, d.tolerance, d.series_id, d.rn, d.step, d.score)""",
    "fx_matched": """
      select event, tolerance, series_id, step, score, case when hit is null then 0 else 1 end as matched
      from rec_match where rn > 0""",
}

# the same walk with tolerances that make neighbouring labels compete
CTES["fx_dtol"] = "select * from (values (10.0::double), (45.0), (60.0), (100.0)) as t(tolerance)"
for _name in ("fx_ranked", "rec_match", "fx_matched"):
    _sql = CTES[_name].replace("fx_tol", "fx_dtol").replace("rec_match", "rec_dmatch").replace("fx_ranked", "fx_dranked")
    CTES[_name.replace("_", "_d")] = _sql

# the same rounds on probabilities cut to six places, where near ties are ties
CTES["fx_smooth6"] = """
      select series_id, event, step, floor(prob * 1e6::double + 0.4142::double) / 1e6::double as prob from fx_smooth"""
# plateaus and slopes over many blocks
CTES["fx_stretched"] = """
      select series_id, 'onset' as event, step, cast(step // 150 * 5 % 3 as double) / 4 as prob from fx_raw where model = 0
      union all
      select series_id, 'wakeup', step, cast(case when step % 400 < 300 then step else step * 7 % 40 end as double) / 100000
      from fx_raw where model = 0"""
for _name in ("rec_pick", "fx_peaks"):
    CTES[f"{_name}_s"] = CTES[_name].replace("rec_pick", "rec_pick_s").replace("fx_smooth", "fx_stretched")
    CTES[f"{_name}6"] = CTES[_name].replace("rec_pick", "rec_pick6").replace("fx_smooth", "fx_smooth6")
    CTES[f"{_name}5"] = CTES[_name].replace("rec_pick", "rec_pick5").replace("fx_smooth", "fx_smooth5")
# the settings of validation while training: frames of five rows, a lower quantile
CTES["fx_smooth5"] = CTES["fx_smooth"].replace("= 7", "= 5").replace("3 preceding and 3 following", "2 preceding and 2 following")
CTES["fx_picked5"] = CTES["fx_picked"].replace("0.87", "0.85").replace("fx_peaks", "fx_peaks5")


def runs_sql(source: str, col: str, eps: str) -> str:
    return f"""
      select *, count(*) over (partition by series_id, run) as run_len,
             row_number() over (partition by series_id, run order by step) - 1 as run_pos
      from (select *, case when diff is null then 0
                           else sum(case when diff > {eps} then 1 else 0 end) over ({W} rows unbounded preceding)
                      end as run
            from (select *, abs({col} - lag({col}) over ({W})) as diff from {source}))"""


def ap_ctes(source: str) -> str:
    """Levels with running totals over a matched table."""
    return f"""
      select event, tolerance, score, tp, n, p,
             sum(tp) over w as c_tp, sum(n) over w as c_n
      from (select event, tolerance, score, sum(matched) as tp, count(*) as n from {source} group by all)
      join (select event, count(*) as p from fx_labels where step is not null group by event) using (event)
      window w as (partition by event, tolerance order by score desc)"""
