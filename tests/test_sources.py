"""Periods, schemas, normalisation, readers and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulario.sources.calls import normalise, union_quarters
from tabulario.sources.periods import Periods
from tabulario.sources.readers import read_partitioned, read_quarters, read_table
from tabulario.sources.schemas import LLAMADAS_CRUDAS, VENTAS, conform
from tabulario.sources.sinks import as_view, write_bucketed, write_partitioned

PERIODS = Periods.of(("A", "2025-01-01", "2025-03-31"), ("B", "2025-04-01", "2025-06-30"))


def test_periods_are_checked():
    with pytest.raises(ValueError, match="overlap"):
        Periods.of(("A", "2025-01-01", "2025-03-31"), ("B", "2025-03-31", "2025-06-30"))
    with pytest.raises(ValueError, match="ends before"):
        Periods.of(("A", "2025-02-01", "2025-01-01"))
    with pytest.raises(ValueError, match="unique"):
        Periods.of(("A", "2025-01-01", "2025-01-31"), ("A", "2025-02-01", "2025-02-28"))
    with pytest.raises(ValueError, match="at least one"):
        Periods([])


def test_last_day_of_a_period(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 31, 0, 0),), (dt.datetime(2025, 3, 31, 0, 1),), (dt.datetime(2024, 12, 31, 0, 0),), (None,)], "t timestamp_ntz")
    assert [r.trimestre for r in PERIODS.tag(df, "t").collect()] == ["A"]
    assert [r.trimestre for r in PERIODS.tag(df, "t", inclusive_end=True).collect()] == ["A", "A"]
    days = df.select(F.to_date("t").alias("t"))
    assert [r.trimestre for r in PERIODS.tag(days, "t").collect()] == ["A", "A"]


def test_period_filter_reaches_the_files(spark, tmp_path):
    df = spark.sql("select date'2025-02-01' as fechaTabla, 123 as cIDR, 'c' as categoria, 'p' as producto_id")
    df.write.parquet(str(tmp_path / "v"))
    tagged = PERIODS.tag(read_table(spark, str(tmp_path / "v"), VENTAS), "fechaTabla").select("trimestre")
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fechaTabla,2025-01-01)" in plan and "ReadSchema: struct<fechaTabla:date>" in plan


def test_conform_reports_missing_columns(spark):
    with pytest.raises(ValueError, match="categoria, producto_id"):
        conform(spark.sql("select date'2025-01-01' as fechaTabla, 1 as cIDR"), VENTAS)


def raw(spark, **over):
    row = dict(idRe=17, numero_entrada="5550000001", numero_digitado="5550000002", menu="M", opcion="1", id_CTransferencia=None, fecha="01/07/2025",
               division="N", area="Q", hora_inicio="01/01/1900 20:15:40", hora_fin="01/01/1900 20:10:05", id_8T="Z1", etiquetas="", cIdentifica=None,
               fecha_inserta="02/07/2025 00:10:00", nidMQ=None) | over
    return spark.createDataFrame([tuple(row[f.name] for f in LLAMADAS_CRUDAS)], LLAMADAS_CRUDAS)


def test_normalise_reads_text_dates_and_times(spark):
    row = normalise(raw(spark)).first()
    assert (row.fecha, row.fecha_inserta, row.hora_inicio_seg, row.hora_fin_seg) == (dt.date(2025, 7, 1), dt.date(2025, 7, 2), 72940, 72605)
    bad = normalise(raw(spark, fecha="31/02/2025", hora_inicio="x", fecha_inserta=None)).first()
    assert (bad.fecha, bad.hora_inicio_seg, bad.fecha_inserta) == (None, None, None)


def test_quarters_read_as_one_and_skip_others(spark, tmp_path):
    for label, day in (("Q1", "2025-02-01"), ("Q2", "2025-05-01")):
        spark.sql(f"select date'{day}' as fechaTabla, 123 as cIDR, 'c' as categoria, 'p' as producto_id").write.parquet(str(tmp_path / label))
    df = read_quarters(spark, {q: str(tmp_path / q) for q in ("Q1", "Q2")}, VENTAS)
    assert {(r.trimestre, str(r.fechaTabla)) for r in df.collect()} == {("Q1", "2025-02-01"), ("Q2", "2025-05-01")}
    only = df.where(F.col("trimestre") == "Q2")._jdf.queryExecution().optimizedPlan().toString()
    assert only.count("Relation") == 1


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_file_formats(spark, tmp_path, fmt):
    df = spark.sql("select date'2025-02-01' as fechaTabla, 123 as cIDR, 'c' as categoria, 'p' as producto_id")
    writer = df.write.option("header", "true") if fmt == "csv" else df.write
    writer.format(fmt).save(str(tmp_path / fmt))
    assert read_table(spark, str(tmp_path / fmt), VENTAS, fmt).collect() == df.collect()


def test_text_formats_need_a_schema(spark):
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, "x", None, "csv")
    with pytest.raises(ValueError, match="unknown"):
        read_table(spark, "x", None, "xml")


def test_partitioned_output_is_pruned(spark, tmp_path):
    df = union_quarters({"Q1": spark.range(3), "Q2": spark.range(5)})
    write_partitioned(df, str(tmp_path / "out"))
    back = read_partitioned(spark, str(tmp_path / "out"), ["Q2"])
    assert back.count() == 5
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "trimestre" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_bucketed_sessions_need_no_shuffle(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id % 7 as string) as numero_entrada", "date_add(date'2024-01-01', cast(id % 3 as int)) as fecha")
    write_bucketed(df, "por_sesion", 4, path=str(tmp_path / "b"))
    grouped = spark.table("por_sesion").groupBy("numero_entrada", "fecha").count()
    assert grouped.count() == 21
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table por_sesion")


def test_view_and_catalog_table(spark):
    as_view(spark.range(2), "dos")
    assert read_table(spark, "dos", fmt="table").count() == 2


def test_whole_calendar_has_every_sale(tables):
    from tabulario.sources.fixtures import SALES_WHOLE

    days = tables.ventas
    assert days.where(SALES_WHOLE.label_of(days["fechaTabla"]).isNull()).count() == 0
    assert SALES_WHOLE.tag(days, "fechaTabla").count() == tables._read("lineitem").count()
    assert SALES_WHOLE.labels[0] == "Q01_95" and "Q01_00" in SALES_WHOLE.labels and SALES_WHOLE.labels[-1] == "Q04_01"
