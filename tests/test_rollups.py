"""Mergeable partial results, frequent groups, refreshed quarters and SQL functions."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulario import registry
from tabulario.operators import calls, eda, reports, rollups, transfers
from tabulario.plans import bitmaps
from tabulario.plans.heavy import frequent_groups, most_frequent
from tabulario.sources import sql_functions
from tabulario.sources.fixtures import LOG_PERIODS
from tabulario.sources.sinks import TableStore

from conftest import SF


def test_bitmaps_count_like_sets(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(["x", "y"]), rng.choice([None, *(f"v{i}" for i in range(300))])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, d string, v string")
    for per_bucket, bits in ((1 << 14, 32768), (16, 8)):  # the second overflows its buckets
        monkeypatch.setattr(bitmaps, "PER_BUCKET", per_bucket)
        monkeypatch.setattr(bitmaps, "BITS", bits)
        codes = bitmaps.dictionary(df, "v").cache()
        assert codes.count() == codes.select("_bucket", "_place").distinct().count() == len({v for _, _, v in rows if v})
        daily = bitmaps.bitmaps(df, ["g", "d"], "v", codes)
        got = {r.g: r.n for r in bitmaps.counted(bitmaps.merged(daily, ["g"]), ["g"], "n").collect()}
        assert got == {g: len({v for h, _, v in rows if h == g and v}) for g in "ab"}


def test_sketches_are_near(tables):
    parts = rollups.daily_partials(tables.llamadas, LOG_PERIODS)
    got = {(r.grano, r.periodo, r.tipo_llamada): r for r in rollups.period_report(parts).collect()}
    exact = rollups.period_callers(rollups.caller_bitmaps(tables.llamadas, LOG_PERIODS)).collect()
    assert len(exact) == len(got)
    for r in exact:
        assert abs(got[(r.grano, r.periodo, r.tipo_llamada)].usuarios_estimados - r.usuarios_unicos) <= 0.03 * r.usuarios_unicos


def test_sketched_summary_of_small_groups_is_exact(tables):
    rows = tables.productos_por_trimestre.where("cIDT <= 3")
    names = ["trimestre", "n_validos", "media_aritmetica"]
    exact, near = ({r.trimestre: r for r in eda.numeric_summary(rows, sketched=s).collect()} for s in (False, True))
    for t, r in exact.items():
        assert [r[c] for c in names] == [near[t][c] for c in names] and r.n_validos < 2000
        values = sorted(x.cProducto for x in rows.where((F.col("trimestre") == t) & F.col("cProducto").isNotNull()).collect())
        at = values.index(near[t].mediana_percentil_50)
        assert abs(at - len(values) / 2) <= 1


def test_sketched_percentiles_take_one_scan(tables):
    plan = eda.percentiles_sketched(tables.productos_por_trimestre)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("cells", [1 << 16, 7, 1])
def test_frequent_groups_against_counts(spark, cells):
    rng = random.Random(cells)
    rows = [(rng.choice([None, *"abcdef"]), rng.choice(["hot"] * 3 + [str(i) for i in range(80)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string")
    counts = Counter(rows)
    for k in (1, 5, 40, 10_000):
        best = sorted(counts.values(), reverse=True)[:k]
        want = {(*g, n) for g, n in counts.items() if n >= (best[-1] if len(best) == k else 0)}
        assert {tuple(r) for r in frequent_groups(df, ["a", "b"], "n", k, cells).collect()} == want
    first = [tuple(r) for r in most_frequent(df, ["a", "b"], "n", 5, cells=cells).collect()]
    assert first == sorted(((*g, n) for g, n in counts.items()), key=lambda r: (-r[2], r[0] is not None, r[0] or "", r[1]))[:5]


def test_frequent_groups_of_nothing(spark):
    assert frequent_groups(spark.createDataFrame([], "a string"), ["a"], "n", 3).count() == 0


def test_redirections_by_cells(tables):
    log = tables.llamadas_por_trimestre
    way = [sorted(map(tuple, transfers.redirections(log, by_cells=b).collect()), key=repr) for b in (False, True)]
    assert way[0] == way[1]


def test_a_corrected_quarter_rewrites_one_folder(spark, tables, tmp_path):
    store = TableStore(spark, str(tmp_path))
    log = tables.llamadas
    reports.refresh_daily(store, log, LOG_PERIODS)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "daily_report") for f in fs if f.startswith("part")}
    before = files()
    second = LOG_PERIODS[1]
    fixed = log.withColumn("numero_digitado", F.when(F.col("fecha").between(second.inicio, second.fin), F.col("numero_entrada")).otherwise(F.col("numero_digitado")))
    daily = reports.refresh_daily(store, fixed, LOG_PERIODS, [second.trimestre])
    after = files()
    other = lambda found: {f: t for f, t in found.items() if f"trimestre={second.trimestre}" not in f}
    assert other(before) == other(after) and before != after
    for stored, whole in ((daily, reports.daily_report), *[(of(daily), whole) for of, whole in (
        (reports.weekly_of, reports.weekly_report), (reports.monthly_of, reports.monthly_report), (reports.annual_of, reports.annual_report))]):
        want = whole(fixed, LOG_PERIODS)
        assert sorted(map(tuple, stored.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_corrected_quarter_of_the_clean_data(spark, tables, tmp_path):
    store, calls_of = TableStore(spark, str(tmp_path)), tables.llamadas_por_trimestre
    calls.refresh_clean_calls(store, calls_of)
    third = LOG_PERIODS[2].trimestre
    fixed = calls_of.withColumn("menu", F.when(F.col("trimestre") == third, F.lit("NUEVO")).otherwise(F.col("menu")))
    got, want = calls.refresh_clean_calls(store, fixed, [third]), calls.clean_calls(fixed)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_reports_as_table_functions(spark, tables):
    tables.llamadas_por_trimestre.createOrReplaceTempView("registro_de_llamadas")
    assert set(sql_functions.register(spark, "registro_de_llamadas")) == set(sql_functions.FUNCTIONS)
    cols = ["numero_entrada", "numero_digitado", "frecuencia_combinacion", "dias_activos", "primera_aparicion", "ultima_aparicion"]
    want = transfers.complete_pairs(tables.llamadas_por_trimestre, 10, "Q02_24").select(cols)
    got = spark.sql("SELECT * FROM transfer_pairs(10, 'Q02_24')")
    assert got.columns == cols and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a, b = got.first()[:2]
    dates = spark.sql(f"SELECT * FROM appearances('{a}', '{b}')").first()
    assert dates.veces >= 1 and dates.primera <= dates.ultima
    assert spark.sql("SELECT * FROM appearances('nobody', NULL)").first().veces == 0
    menus = {r.menu for r in spark.sql("SELECT * FROM label_search('SDO', NULL, NULL, 5)").collect()}
    assert menus == {"SDO"}
    assert {r.trimestre for r in spark.sql("SELECT * FROM quality_of(NULL)").collect()} == {p.trimestre for p in LOG_PERIODS}


# A rollup expands the counted rows of its report by design. Keys over other calendars have the plans of their plain key.
ROLLUP, SAME_PLAN = "s23_org_matrix_with_total", ("_whole_table", "_all_quarters", "_by_day")


def test_no_report_copies_rows_for_distinct_counts(spark):
    for key, query in registry.queries().items():
        if key != ROLLUP and not key.endswith(SAME_PLAN):
            assert "Expand" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString(), key
