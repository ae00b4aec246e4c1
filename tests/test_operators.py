"""Worked samples, methods that must agree, and properties of results."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tabulario.functions.calls import TRANSFER_MODES, seconds, start, transfer
from tabulario.operators import calls, digital, eda, journeys, labels, operations, reports, sales, transfers
from tabulario.sources.calls import normalise
from tabulario.sources.fixtures import LOG_PERIODS, SALES_PERIODS


def rows_of(df, *cols):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- worked samples -------------------------------------------------------------------------

# Every combination of what a number can be, on both sides.
SIDES = (None, "", " ", "7", " 7", "8")


def expected(mode, caller, dialled):
    """The truth table of a transfer, in words: known caller, and a dialled number that is another one."""
    if caller is None:
        return False
    if mode == "strict":
        return dialled is not None and caller != dialled
    if mode == "null_kept":
        return caller != (dialled or "")
    if mode == "explicit_null":
        return dialled is None or caller != dialled
    return caller.strip() != "" and caller.strip() != (dialled or "").strip()


@pytest.mark.parametrize("mode", TRANSFER_MODES)
def test_transfer_truth_table(calls_frame, mode):
    cases = list(itertools.product(SIDES, SIDES))
    df = calls_frame(*[dict(numero_entrada=a, numero_digitado=b) for a, b in cases])
    kept = {r.idRe for r in df.where(transfer(mode)).collect()}
    assert kept == {i for i, (a, b) in enumerate(cases, 1) if expected(mode, a, b)}


def test_unknown_transfer_mode():
    with pytest.raises(ValueError):
        transfer("other")


def test_inverted_time_is_repaired(calls_frame):
    row = calls_frame(dict(hora_inicio_seg=61500, hora_fin_seg=61389)).select(seconds().alias("s"), start().alias("a")).first()
    assert (row.s, row.a) == (111, 61389)
    clean = calls.clean_calls(calls_frame(dict(hora_inicio_seg=61500, hora_fin_seg=61389))).first()
    assert (clean.flag_timestamp, clean.timestamp_inicio_completo) == ("CORREGIDO", "2024-01-02 17:03:09")


def test_journey_is_in_time_order(calls_frame):
    steps = [(7260, "B"), (3600, "A"), (7205, "C"), (7199, "A")]
    df = calls_frame(*[dict(numero_entrada="caller", menu=m, opcion=m.lower(), hora_inicio_seg=t, hora_fin_seg=t + 9) for t, m in steps])
    row = journeys.daily_journeys(df).first()
    assert row.total_interacciones == 4
    assert row.patron_navegacion == "01:00:[A-a] → 01:59:[A-a] → 02:00:[C-c] → 02:01:[B-b]"


def test_label_rows_keep_repeated_labels(calls_frame):
    df = labels.exploded_labels(calls_frame(dict(etiquetas="uno,dos,uno,,"), dict(etiquetas=""), dict(etiquetas=None)))
    assert rows_of(df, "etiqueta_individual", "posicion_etiqueta") == [("dos", 2), ("uno", 1), ("uno", 3)]


def test_option_wildcards_and_whole_labels(calls_frame):
    df = calls_frame(dict(opcion="A_C", etiquetas="ABC"), dict(opcion="A_C", etiquetas="AC"))
    assert labels.option_reflection(df, min_rows=1).first().opcion_en_etiquetas == 1
    marked = calls_frame(dict(etiquetas="XVSI,ZMB"))
    assert (labels.label_indicators(marked).first().tiene_VSI, labels.label_indicators(marked, whole_labels=True).first().tiene_VSI) == (1, 0)


def test_daily_report_columns(tables):
    got = reports.daily_report(tables.llamadas_por_trimestre, LOG_PERIODS).columns
    assert got[:6] == ["trimestre", "fecha", "tipo_llamada", "grupo_zonas", "usuarios_activos", "interacciones_totales"]


# --- empty and odd input --------------------------------------------------------------------

def test_quarters_without_rows_are_kept(spark, tables):
    none = tables.ventas.limit(0)
    assert [r.registros_existentes for r in sales.pre_check(none, SALES_PERIODS).collect()] == [0, 0, 0]
    assert {r.registros_existentes for r in eda.pre_check(tables.productos_por_trimestre.limit(0), LOG_PERIODS).collect()} == {0}
    assert {r.total_registros for r in reports.quarter_context(tables.llamadas_por_trimestre.limit(0), LOG_PERIODS).collect()} == {0}


def test_rules_without_hits_show_zero(calls_frame):
    df = calls_frame(dict())
    assert {r.casos for r in calls.malformed_references(df).collect()} == {0}
    assert {r.casos for r in labels.technical_codes(df).collect()} == {0}
    assert {r.casos for r in journeys.anomaly_list(df).collect()} == {0}


def test_grand_total_is_not_a_missing_category(spark):
    rows = [(dt.date(1995, 1, 5), 123, None, "p1"), (dt.date(1995, 1, 5), 369, "c", "p2"), (dt.date(1995, 5, 5), 123, "c", "p3")]
    got = {r.categoria: r for r in sales.org_matrix_with_total(spark.createDataFrame(rows, "fechaTabla date, cIDR int, categoria string, producto_id string"), SALES_PERIODS).collect()}
    assert set(got) == {None, "c", "TOTAL_GENERAL"} and got[None].OP == 1.0 and got["TOTAL_GENERAL"].trimestres_OP == 2


def test_missing_products_count_once_by_first_appearance(spark):
    rows = [(dt.date(1995, 1, 5), 123, "c", None), (dt.date(1995, 1, 6), 123, "c", None), (dt.date(1995, 1, 6), 123, "c", "p")]
    df = spark.createDataFrame(rows, "fechaTabla date, cIDR int, categoria string, producto_id string")
    assert sales.products_by_org(df, SALES_PERIODS).first().productos_unicos == 1
    assert sales.products_by_first_appearance(df, SALES_PERIODS).first().productos_unicos == 2


def test_semantic_nulls(spark):
    rows = [("Q", 1, c) for c in ("", " ", "   ", "N/A", "null", "ok", None)]
    df = spark.createDataFrame(rows, "trimestre string, cIDT bigint, cCategoria string").selectExpr(
        "*", "cast(1 as bigint) as cProducto", "1 as cSeleccion", "1 as cIOT", "timestamp_ntz'2024-01-01' as cFecha", "1 as cHInicio_seg", "2 as cHFin_seg")
    row = eda.null_report(df).first()
    assert (row.categoria_null, row.categoria_vacia, row.categoria_espacio, row.categoria_solo_espacios, row.categoria_semanticos) == (1, 1, 1, 3, 1)
    assert eda.null_summary(df).first().total_nulos_categoria == 6


def test_duplicates_and_ids_filter(spark):
    rows = [(1, 7, "a"), (1, 7, "a"), (2, 8, "b")]
    df = spark.createDataFrame(rows, "cProducto bigint, cIDT bigint, cCategoria string").selectExpr(
        "*", "'Q' as trimestre", "1 as cSeleccion", "1 as cIOT", "timestamp_ntz'2024-01-01 10:00:00' as cFecha", "1 as cHInicio_seg", "2 as cHFin_seg")
    dup = eda.exact_duplicates(df).collect()
    assert [(r.cProducto, r.veces_duplicado, r.cFecha) for r in dup] == [(1, 2, "2024-01-01 10:00:00")]
    assert eda.logical_duplicates(df).first().registros_mismo_dia == 2
    assert eda.exact_duplicates(df, ids=[8]).count() == 0


# --- methods that must agree ----------------------------------------------------------------

def test_products_by_two_methods(tables):
    known = tables.ventas.where(F.col("producto_id").isNotNull())
    assert rows_of(sales.products_by_org(known, SALES_PERIODS)) == rows_of(sales.products_by_first_appearance(known, SALES_PERIODS))
    cols = ("organizacion", "categoria", "promedio_productos")
    assert rows_of(sales.org_category_average(known, SALES_PERIODS), *cols) == rows_of(sales.average_by_dedup(known, SALES_PERIODS), *cols)


def test_category_states_by_four_methods(tables):
    ways = (sales.category_states, sales.category_states_by_join, sales.category_states_by_sum, sales.category_states_by_rank)
    first, *others = [rows_of(w(tables.ventas, SALES_PERIODS)) for w in ways]
    assert first and all(o == first for o in others)


def test_transfer_pairs_by_three_methods(tables):
    df, cols = tables.llamadas_por_trimestre, ("numero_entrada", "numero_digitado", "frecuencia_combinacion", "dias_activos", "primera_aparicion", "ultima_aparicion")
    a, b, c = (rows_of(f(df), *cols) for f in (transfers.transfer_pairs, transfers.pairs_joined_to_dates, transfers.pair_summary))
    assert a and a == b == c


# --- properties -----------------------------------------------------------------------------

def test_shares_add_up(tables):
    df = tables.productos_por_trimestre
    for frame in (eda.histogram(df), eda.cumulative_histogram(df)):
        for r in frame.groupBy("trimestre").agg(F.sum("porcentaje").alias("s")).collect():
            assert r.s == pytest.approx(100, abs=0.1)
    assert sum(r.porcentaje for r in sales.presence_distribution(tables.ventas, SALES_PERIODS).collect()) == pytest.approx(100, abs=0.1)


def test_patterns_partition_the_categories(tables):
    total = sales.presence(tables.ventas, SALES_PERIODS).count()
    assert sum(r.cantidad_categorias for r in sales.presence_distribution(tables.ventas, SALES_PERIODS).collect()) == total
    metrics = {r.metrica: r.valor for r in sales.presence_executive(tables.ventas, SALES_PERIODS).collect()}
    assert metrics["CATEGORÍAS_ESTABLES"] + metrics["CATEGORÍAS_PROBLEMÁTICAS"] == metrics["TOTAL_CATEGORÍAS_ÚNICAS"] == total


def test_first_rank_exists(tables):
    for r in sales.org_quarter_metrics(tables.ventas, SALES_PERIODS).groupBy("trimestre").agg(F.min("ranking_por_trimestre").alias("m")).collect():
        assert r.m == 1
    assert operations.zone_efficiency(tables.llamadas_por_trimestre).agg(F.min("ranking_eficiencia")).first()[0] == 1


def test_clean_rows_are_a_subset(tables):
    typed = normalise(tables.llamadas_crudas)
    assert 0 < calls.clean_calls(typed).count() < typed.count()
    sizes = {r.escenario: r.total_interacciones for r in calls.cleaning_impact(tables.llamadas_por_trimestre).collect()}
    assert sizes["CON_TODOS_LOS_DATOS"] >= sizes["SOLO_DATOS_LIMPIOS"] >= sizes["DATOS_ULTRA_LIMPIOS"]


def test_sessions_cover_all_rows(tables):
    df = tables.llamadas_por_trimestre
    assert reports.daily_sessions(df, LOG_PERIODS).agg(F.sum("total_interacciones")).first()[0] == df.count()
    assert reports.daily_report(df, LOG_PERIODS).agg(F.sum("interacciones_totales")).first()[0] == df.count()


def test_two_quarters_work_as_well(tables):
    from tabulario.sources.periods import Periods

    two = Periods.of(("A", "1995-01-01", "1995-06-30"), ("B", "1995-07-01", "1995-12-31"))
    assert sales.product_lifecycle(tables.ventas, two).count() == 3
    assert set(sales.presence(tables.ventas, two).columns) == {"categoria", "presente_q1", "presente_q2", "patron_presencia", "trimestres_activos"}
    assert sales.category_states(tables.ventas, two).count() == 2 * sales.presence(tables.ventas, two).count()


def test_retention_over_new_year(calls_frame):
    days = ["2023-12-28", "2024-01-03"]
    df = calls_frame(*[dict(numero_entrada=f"u{i}", numero_digitado=f"u{i}", fecha=d) for i in range(12) for d in days])
    row = digital.retention_cohorts(df).first()
    assert (row.cohorte_año, row.usuarios_cohorte, row.retencion_semana_1_pct, row.churn_semana_1_pct) == (2023, 12, 100.0, 0.0)


def test_interpolated_percentile_differs_from_position(calls_frame):
    # 40 callers with 1 row, one with 2, one with 5: both limits are exceeded by the last caller only.
    rows = [dict(numero_entrada=f"u{i}") for i in range(40)] + [dict(numero_entrada="v")] * 2 + [dict(numero_entrada="w")] * 5
    for mode in ("position", "interpolated"):
        got = {r.tipo_outlier: r for r in calls.user_outliers(calls_frame(*rows), mode).collect()}
        assert got["usuarios_outliers_volumen"].max_valor_outlier == 5 and "w" in got["usuarios_outliers_volumen"].ejemplos_usuarios
        assert got["usuarios_outliers_geograficos"].cantidad_outliers == 0


def test_consistency_on_a_bound_does_not_depend_on_row_order(calls_frame):
    # Ten sessions with 28 interactions and a deviation of 1.4, which is half their average: on the bound.
    sizes = [1, 1, 2, 2, 3, 3, 3, 3, 4, 6]
    cases = {f"55500000{k:02d}": sizes[k:] + sizes[:k] for k in range(10)}
    df = calls_frame(*[
        dict(numero_entrada=number, fecha=f"2024-01-{day + 1:02d}") for number, own in cases.items() for day, size in enumerate(own) for _ in range(size)])
    for parts in (1, 7):
        got = [(r.nivel_consistencia, r.variabilidad_interacciones) for r in journeys.user_evolution(df.repartition(parts, "idRe")).collect()]
        assert got == [("CONSISTENTE", 1.4)] * 10
