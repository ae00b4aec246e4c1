"""Streaming jobs against their batch reports."""

import datetime as dt

from pyspark.sql import functions as F

from tabulario.operators.calls import quality_dashboard
from tabulario.operators.operations import daily_kpis
from tabulario.operators.reports import daily_sessions
from tabulario.sources.fixtures import LOG_PERIODS
from tabulario.streaming.daily import daily_figures, daily_peaks, quality_writer
from tabulario.streaming.sessions import live_callers, live_sessions


def log(spark, tables, tmp_path):
    """The call log as files in date order, closed by a row far in the future that moves the watermark on."""
    folder = str(tmp_path / "log")
    df = tables.llamadas_por_trimestre
    closing = df.limit(1).withColumns({"fecha": F.lit(dt.date(2024, 3, 1)), "numero_digitado": F.lit("x"), "numero_entrada": F.lit("x"), "id_8T": F.lit("Z")})
    df.repartitionByRange(3, "fecha").write.parquet(folder)
    closing.coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(folder)


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return out


def test_daily_stream_equals_batch(spark, tables, tmp_path):
    batch, stream = log(spark, tables, tmp_path)
    want = {(r.dia, r.zona): r for r in daily_kpis(batch).collect()}
    got = spark.read.parquet(run(daily_figures(stream), tmp_path, "figures")).where(F.col("zona") != "Z").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[(r.dia, r.zona)]
        assert (r.operaciones_totales, r.tiempo_promedio_operacion_seg, r.tiempo_maximo_operacion_seg, r.operaciones_lentas) == (
            w.operaciones_totales, w.tiempo_promedio_operacion_seg, w.tiempo_maximo_operacion_seg, w.operaciones_lentas)


def test_peak_stream_equals_batch(spark, tables, tmp_path):
    batch, stream = log(spark, tables, tmp_path)
    want = {(r.dia, r.zona): (r.horas_activas, r.pico_operaciones_hora, r.hora_pico) for r in daily_kpis(batch).collect()}
    got = spark.read.parquet(run(daily_peaks(stream), tmp_path, "peaks")).where(F.col("zona") != "Z").collect()
    assert {(r.dia, r.zona): (r.horas_activas, r.pico_operaciones_hora, r.hora_pico) for r in got} == want


def test_quality_rows_per_batch(spark, tables, tmp_path):
    batch, stream = log(spark, tables, tmp_path)
    out, day = str(tmp_path / "quality"), dt.date(2024, 1, 31)
    write = quality_writer(out, lambda: day)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination(240)
    write(batch, 0)  # a replayed batch replaces its row
    rows = spark.read.parquet(f"{out}/lote=0").collect()
    assert [r.total_registros_sistema for r in rows] == [quality_dashboard(batch, day).first().total_registros_sistema]


def test_sessions_survive_a_restart(spark, tables, tmp_path):
    """The log in five pieces by date, a new query from the checkpoint after the third, late rows within the watermark."""
    folder, out = str(tmp_path / "log"), str(tmp_path / "sessions")
    df = tables.llamadas.where("idRe % 3 = 0")
    days = [r.fecha for r in df.select("fecha").distinct().orderBy("fecha").collect()]
    cuts = [days[len(days) * k // 5] for k in range(1, 5)]
    pieces = [df.where((F.lit(a is None) | (F.col("fecha") >= a)) & (F.lit(b is None) | (F.col("fecha") < b))) for a, b in zip([None, *cuts], [*cuts, None])]
    # A few rows of each piece come with the next one, hours late.
    late = [p.where((F.col("fecha") == c) & (F.col("idRe") % 2 == 0)) for p, c in zip(pieces, [dt.date.fromisoformat(str(c)) - dt.timedelta(days=1) for c in cuts])]

    def start():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = live_sessions(stream, LOG_PERIODS, "2 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(240)

    for k, piece in enumerate(pieces):
        own = piece if k == 4 else piece.join(late[k].select("idRe"), "idRe", "left_anti").select(df.columns)
        rows = own.unionByName(late[k - 1]) if k else own
        rows.coalesce(1).write.mode("append").parquet(folder)
        if k in (2, 4):
            start()
    got = spark.read.parquet(out)
    want = daily_sessions(df, LOG_PERIODS).select(got.columns)
    # Days that the watermark has not passed are still open.
    closed = F.col("fecha") < F.lit(days[-1] - dt.timedelta(days=3))
    assert sorted(map(tuple, got.where(closed).collect()), key=repr) == sorted(map(tuple, want.where(closed).collect()), key=repr)
    assert got.where(closed).count() > 100 and got.count() == got.dropDuplicates(["trimestre", "numero_entrada", "fecha", "tipo_llamada", "id_8T", "division", "area"]).count()


def test_sessions_by_gap(spark, calls_frame, tmp_path):
    folder = str(tmp_path / "log")
    times = [36000, 36300, 40000, 36600, 80000]
    df = calls_frame(*[dict(hora_inicio_seg=t, hora_fin_seg=t + 5) for t in times], dict(fecha="2024-01-09", numero_entrada="other"))
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = spark.read.parquet(run(live_sessions(stream.drop("trimestre"), LOG_PERIODS, "1 hour", gap="30 minutes"), tmp_path, "gaps")).where(F.col("numero_entrada") == "5550000000")
    assert sorted((r.primera_interaccion, r.total_interacciones) for r in got.collect()) == [(36000, 3), (40000, 1), (80000, 1)]


def test_live_callers_equal_batch(spark, tables, tmp_path):
    batch, stream = log(spark, tables, tmp_path)
    want = {(r.dia, r.zona): r.usuarios_unicos for r in daily_kpis(batch).collect()}
    got = spark.read.parquet(run(live_callers(stream), tmp_path, "callers")).where(F.col("zona") != "Z").collect()
    assert {(r.dia, r.zona): r.usuarios_unicos for r in got} == want
