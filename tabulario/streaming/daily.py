"""Daily operating figures and quality checks over a growing call log.

The batch reports `operations.daily_kpis` and `calls.quality_dashboard` as
structured-streaming jobs: event time is the recorded start, late rows are
accepted up to the watermark, and state holds one row per open window and zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import equal, raw_seconds
from tabulario.functions.exact import ratio
from tabulario.operators.calls import quality_dashboard


def with_event_time(llamadas: DataFrame) -> DataFrame:
    """Start of the row as a timestamp, `inicio`."""
    return llamadas.withColumn("inicio", F.timestamp_add("SECOND", F.col("hora_inicio_seg"), F.col("fecha").cast("timestamp")))


def _zoned(llamadas: DataFrame, lateness: str) -> DataFrame:
    rows = with_event_time(llamadas).withWatermark("inicio", lateness)
    return rows.where(equal() & F.col("id_8T").isNotNull()).withColumn("seg", raw_seconds())


def daily_figures(llamadas: DataFrame, lateness: str = "1 day", slow: int = 120) -> DataFrame:
    """Operations, approximate callers and durations per zone and day.

    Exact distinct callers would need unbounded state, so they are estimated.
    """
    n = F.count(F.lit(1))
    return _zoned(llamadas, lateness).groupBy(F.window("inicio", "1 day").alias("w"), F.col("id_8T").alias("zona")).agg(
        n.alias("operaciones_totales"), F.approx_count_distinct("numero_entrada").alias("usuarios_aproximados"),
        ratio(F.sum("seg"), n, 1, 1).alias("tiempo_promedio_operacion_seg"), F.max("seg").alias("tiempo_maximo_operacion_seg"),
        F.count_if(F.col("seg") > slow).alias("operaciones_lentas"), ratio(F.count_if(F.col("seg") > slow), n, 1).alias("pct_operaciones_lentas"),
    ).select(F.to_date("w.start").alias("dia"), "*").drop("w")


def daily_peaks(llamadas: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Busiest hour per zone and day: hourly windows feeding daily ones."""
    hours = _zoned(llamadas, lateness).groupBy(F.window("inicio", "1 hour").alias("h"), F.col("id_8T").alias("zona")).agg(F.count("*").alias("n"))
    hours = hours.select(F.window_time("h").alias("t"), "zona", "n", F.hour("h.start").alias("hora"))
    best = F.max(F.struct(F.col("n"), (-F.col("hora")).alias("h")))
    return hours.groupBy(F.window("t", "1 day").alias("w"), "zona").agg(F.count("*").alias("horas_activas"), best.alias("b")).select(
        F.to_date("w.start").alias("dia"), "zona", "horas_activas", F.col("b.n").alias("pico_operaciones_hora"), (-F.col("b.h")).alias("hora_pico"))


def quality_writer(path: str, today: Callable[[], dt.date] = dt.date.today) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that stores the quality row of every micro-batch.

    A batch writes its own folder, so a batch replayed after a failure replaces
    its row instead of adding one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        quality_dashboard(batch, today()).withColumn("lote", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/lote={batch_id}")

    return write
