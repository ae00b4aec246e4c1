"""Distinct products, category averages and presence between quarters.

Every report starts from `active`: one scan of the sales table, filtered to the
organisations and tagged with its quarter. Distinct counts shuffle on the
distinct value, so a dominating category or organisation stays spread.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulario.functions.bits import Mask
from tabulario.functions.exact import cents, deviation, figure, mean, mean_of_rounded, ratio
from tabulario.plans.shape import first_match, matching, over_all, rows_of
from tabulario.sources.periods import Periods
from tabulario.sources.sinks import TableStore

ORGS: Mapping[str, int] = {"OP": 123, "ONa": 369}


def _org(orgs: Mapping[str, int]) -> Column:
    return first_match([(F.col("cIDR") == code, name) for name, code in orgs.items()], "OTRO")


def active(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    rows = ventas.where(F.col("cIDR").isin(*orgs.values()))
    return periods.tag(rows, "fechaTabla").withColumn("organizacion", _org(orgs))


def with_empty_periods(df: DataFrame, periods: Periods) -> DataFrame:
    """Aggregate of `df` per quarter, keeping quarters that have no rows."""
    calendar = periods.frame(df.sparkSession)
    return calendar.join(df, "trimestre", "left")


def pre_check(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    counts = active(ventas, periods, orgs).groupBy("trimestre").agg(
        F.count("*").alias("n"), F.count_distinct("categoria").alias("c")
    )
    return with_empty_periods(counts, periods).select(
        "trimestre", F.col("inicio").alias("fecha_inicio"), F.col("fin").alias("fecha_fin"),
        F.coalesce("n", F.lit(0)).alias("registros_existentes"),
        F.coalesce("c", F.lit(0)).alias("categorias_distintas"),
    )


def distinct_products(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return active(ventas, periods, orgs).groupBy("trimestre").agg(
        F.count_distinct("producto_id").alias("productos_unicos")
    )


def product_diversity(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return active(ventas, periods, orgs).groupBy("trimestre").agg(
        F.count_distinct("producto_id").alias("productos_unicos"), F.count("*").alias("total_transacciones")
    ).withColumn("ratio_diversidad_productos", ratio(F.col("productos_unicos"), F.col("total_transacciones"), 4))


def products_by_org(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return active(ventas, periods, orgs).groupBy("organizacion", "trimestre").agg(
        F.count_distinct("producto_id").alias("productos_unicos")
    )


def products_by_first_appearance(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """De-duplicate, then count; unlike a distinct count a NULL product counts once."""
    seen = active(ventas, periods, orgs).select("organizacion", "trimestre", "producto_id").distinct()
    return seen.groupBy("organizacion", "trimestre").agg(F.count("*").alias("productos_unicos"))


def quarter_variation(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    per_quarter = periods.numbered(distinct_products(ventas, periods, orgs), "_orden")
    w = Window.orderBy("_orden")
    now, before = F.col("productos_unicos"), F.col("productos_trimestre_anterior")
    # A quarter without rows has no figure, so the one after it has nothing to be compared with.
    follows = F.lag("_orden").over(w) == F.col("_orden") - 1
    return per_quarter.withColumn("productos_trimestre_anterior", F.when(follows, F.lag("productos_unicos").over(w))).select(
        "trimestre", "productos_unicos", "productos_trimestre_anterior",
        (now - before).alias("diferencia_absoluta"),
        F.when(before > 0, ratio(now - before, before)).alias("variacion_porcentual"),
        first_match(
            [(before.isNull(), "TRIMESTRE_BASE"), (now > before, "CRECIMIENTO"), (now == before, "ESTABLE")],
            "DECRECIMIENTO",
        ).alias("tendencia"),
    )


def org_quarter_metrics(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    per_org = periods.numbered(products_by_first_appearance(ventas, periods, orgs), "_orden")
    timeline = Window.partitionBy("organizacion").orderBy("_orden")
    now, before = F.col("productos_unicos"), F.col("productos_trimestre_anterior")
    return per_org.withColumn("productos_trimestre_anterior", F.lag("productos_unicos").over(timeline)).select(
        "organizacion", "trimestre", "productos_unicos", "productos_trimestre_anterior",
        (now - before).alias("diferencia_absoluta"),
        ratio(now - before, before).alias("crecimiento_porcentual"),
        F.avg(now).over(Window.partitionBy("organizacion")).alias("promedio_organizacion"),
        F.rank().over(Window.partitionBy("trimestre").orderBy(now.desc())).cast("bigint").alias("ranking_por_trimestre"),
    )


def org_summary(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    n = F.col("productos_unicos")
    per_org = products_by_first_appearance(ventas, periods, orgs).groupBy("organizacion").agg(
        F.sum(n).alias("total_productos_periodo"), F.avg(n).alias("promedio_productos_trimestre"),
        F.min(n).alias("min_productos_trimestre"), F.max(n).alias("max_productos_trimestre"),
        figure(deviation(n)).alias("volatilidad_productos"),
    )
    by_average = Window.orderBy(F.col("promedio_productos_trimestre").desc())
    return per_org.withColumn("ranking_performance", F.rank().over(by_average).cast("bigint"))


def _masks(df: DataFrame, key: str, periods: Periods) -> DataFrame:
    """One row per key with the set of periods it occurs in (`Mask` m); a single shuffle, whatever the number of periods."""
    numbered = periods.numbered(df.where(F.col(key).isNotNull()), "_orden")
    return numbered.groupBy(key).agg(*Mask.gather(F.col("_orden"), len(periods), "m"))


def _calendar(df: DataFrame, periods: Periods) -> DataFrame:
    return F.broadcast(periods.frame(df.sparkSession))


def product_lifecycle(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """A product is new in the first quarter it occurs in, and discontinued in each one that it is missing from after it occurred."""
    masks = _masks(active(ventas, periods, orgs), "producto_id", periods)
    n, m = len(periods), Mask.of("m", len(periods))
    missed = F.filter(m.without(m.earlier()).members(), lambda i: i < n)
    events = F.concat(
        F.array(F.struct(F.lit("N").alias("que"), m.first().alias("i")), F.struct(F.when(m.full(), "C").alias("que"), F.lit(0).alias("i"))),
        F.transform(missed, lambda i: F.struct(F.lit("D").alias("que"), (i + 1).alias("i"))),
    )
    counts = masks.select(F.inline(events)).where(F.col("que").isNotNull()).groupBy("que", "i").agg(F.count("*").alias("cantidad"))
    later = _calendar(ventas, periods).where(F.col("orden") > 1).select(F.explode(F.array(F.lit("N"), F.lit("D"))).alias("que"), F.col("orden").alias("i"))
    asked = later.unionByName(ventas.sparkSession.createDataFrame([("C", 0)], "que string, i int"))
    i, q = F.col("i").cast("string"), F.concat(F.lit("Q"), F.col("i").cast("string"))
    before = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("i") - 1)), lambda j: F.concat(F.lit("Q"), j.cast("string"))), " ni ")
    return asked.join(counts, ["que", "i"], "left").select(
        F.when(F.col("que") == "N", F.concat(F.lit("PRODUCTOS_NUEVOS_"), q)).when(F.col("que") == "D", F.concat(F.lit("PRODUCTOS_DESCONTINUADOS_"), q))
        .otherwise("PRODUCTOS_CONSISTENTES").alias("categoria"),
        F.coalesce("cantidad", F.lit(0).cast("bigint")).alias("cantidad"),
        F.when(F.col("que") == "N", F.concat(F.lit("Productos que aparecen en Q"), i, F.lit(" pero no estaban en "), before))
        .when(F.col("que") == "D", F.concat(F.lit("Productos que estaban en Q"), (F.col("i") - 1).cast("string"), F.lit(" pero no aparecen en Q"), i))
        .otherwise(f"Productos que aparecen en los {n} trimestres").alias("descripcion"),
    )


def executive_products(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    masks = _masks(active(ventas, periods, orgs), "producto_id", periods)
    n, m = len(periods), Mask.of("m", len(periods))
    totals = masks.agg(
        *[F.count_if(m.has(i)).alias(f"productos_Q{i}") for i in range(1, n + 1)],
        F.count("*").alias("productos_unicos_totales"),
    )
    first, last = F.col("productos_Q1"), F.col(f"productos_Q{n}")
    return totals.select(
        F.lit("RESUMEN_EJECUTIVO").alias("tipo_reporte"), "*",
        ratio(last - first, first).alias(f"crecimiento_Q1_a_Q{n}_pct"),
    )


def category_products(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """Distinct products per quarter and category; the base of the averages below."""
    return active(ventas, periods, orgs).groupBy("trimestre", "categoria").agg(
        F.count_distinct("producto_id").alias("productos_unicos")
    )


def _n() -> Column:
    return F.col("productos_unicos")


def category_statistics(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    n = _n()
    return category_products(ventas, periods, orgs).groupBy("categoria").agg(
        F.count("*").alias("trimestres_con_actividad"), F.min(n).alias("min_productos"), F.max(n).alias("max_productos"),
        mean(n).alias("promedio_productos"), F.round(deviation(n), 2).alias("desviacion_estandar"),
        F.round(F.when(F.avg(n) > 0, deviation(n) / F.avg(n) * 100).otherwise(F.lit(0.0)), 2).alias("coeficiente_variacion_pct"),
    )


def _category_means(ventas, periods, orgs) -> DataFrame:
    return category_products(ventas, periods, orgs).groupBy("categoria").agg(mean(_n()).alias("promedio"))


def overall_statistics(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    p = F.col("promedio")
    return _category_means(ventas, periods, orgs).agg(
        F.lit("ESTADÍSTICAS_GENERALES").alias("tipo_analisis"), F.count("*").alias("total_categorias"),
        F.min(p).alias("promedio_minimo"), F.max(p).alias("promedio_maximo"),
        mean_of_rounded(p).alias("promedio_de_promedios"),
        F.round(deviation(cents(p)) / 100, 2).alias("desviacion_entre_categorias"),
    )


# Lower bound and label of the average ranges.
AVERAGE_RANGES = [
    (100, "ALTO (100+)"), (50, "MEDIO_ALTO (50-99)"), (20, "MEDIO (20-49)"), (10, "MEDIO_BAJO (10-19)"), (5, "BAJO (5-9)"),
]


def average_ranges(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    p = F.col("promedio")
    label = first_match([(p >= low, text) for low, text in AVERAGE_RANGES], "MUY_BAJO (<5)")
    return _category_means(ventas, periods, orgs).groupBy(label.alias("rango_promedio")).agg(
        F.count("*").alias("cantidad_categorias"), F.min(p).alias("promedio_minimo_rango"),
        F.max(p).alias("promedio_maximo_rango"), mean_of_rounded(p).alias("promedio_del_rango"),
    )


def category_variability(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    n, total = _n(), len(periods)
    active_quarters, avg, dev = F.col("trimestres_activos"), F.col("_avg"), F.col("_dev")
    return category_products(ventas, periods, orgs).groupBy("categoria").agg(
        F.count("*").alias("trimestres_activos"), mean(n).alias("promedio_productos"),
        F.min(n).alias("min_productos"), F.max(n).alias("max_productos"),
        (F.max(n) - F.min(n)).alias("rango_variacion"), F.avg(n).alias("_avg"), deviation(n).alias("_dev"),
    ).select(
        "categoria", "trimestres_activos", "promedio_productos", "min_productos", "max_productos", "rango_variacion",
        F.round(dev, 2).alias("desviacion_estandar"),
        first_match([(active_quarters == total, "CATEGORÍA_ESTABLE"), (active_quarters == total - 1, "CATEGORÍA_INTERMITENTE")],
                    "CATEGORÍA_ESPORÁDICA").alias("tipo_categoria"),
        first_match([(dev <= avg * 0.1, "MUY_ESTABLE"), (dev <= avg * 0.3, "ESTABLE"), (dev <= avg * 0.5, "MODERADAMENTE_VARIABLE")],
                    "ALTAMENTE_VARIABLE").alias("clasificacion_variabilidad"),
    )


def top_bottom_categories(
    ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS, limit: int = 10
) -> DataFrame:
    n = _n()
    per_category = category_products(ventas, periods, orgs).groupBy("categoria").agg(
        mean(n).alias("promedio_productos"), F.min(n).alias("min_productos"), F.max(n).alias("max_productos"),
        F.count("*").alias("trimestres_activos"), F.avg(n).alias("_avg"),
    )
    tie = F.col("categoria").asc_nulls_first()
    top = per_category.orderBy(F.col("_avg").desc(), tie).limit(limit).withColumn("tipo_ranking", F.lit("TOP_10_CATEGORÍAS"))
    low = per_category.orderBy(F.col("_avg"), tie).limit(limit).withColumn("tipo_ranking", F.lit("BOTTOM_10_CATEGORÍAS"))
    return top.unionByName(low).drop("_avg")


def executive_categories(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    per_category = category_products(ventas, periods, orgs).groupBy("categoria").agg(
        F.avg(_n()).alias("a"), F.count("*").alias("c")
    )
    totals = per_category.agg(
        F.count("categoria").cast("double").alias("total"), F.round(F.avg("a"), 2).alias("general"),
        F.round(F.max("a"), 2).alias("mas"), F.round(F.min("a"), 2).alias("menos"),
        F.count_if(F.col("c") == len(periods)).cast("double").alias("estables"),
    )
    return rows_of(totals, ["metrica", "valor", "descripcion"], [
        ("TOTAL_CATEGORÍAS", F.col("total"), "Total de categorías únicas que tuvieron actividad en al menos un trimestre"),
        ("PROMEDIO_GENERAL", F.col("general"), "Promedio general de productos por categoría across todas las categorías"),
        ("CATEGORÍA_MÁS_AMPLIA", F.col("mas"), "Mayor promedio de productos por categoría"),
        ("CATEGORÍA_MÁS_PEQUEÑA", F.col("menos"), "Menor promedio de productos por categoría"),
        ("CATEGORÍAS_ESTABLES", F.col("estables"), f"Categorías que aparecen en los {len(periods)} trimestres"),
    ])


def category_average(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    n = _n()
    return category_products(ventas, periods, orgs).groupBy("categoria").agg(
        F.avg(n).alias("promedio_productos"), F.min(n).alias("min_productos"), F.max(n).alias("max_productos"),
        F.count("*").alias("trimestres_con_datos"),
    )


def org_category_products(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return active(ventas, periods, orgs).groupBy("organizacion", "categoria", "trimestre").agg(
        F.count_distinct("producto_id").alias("productos_unicos")
    )


def _of(org: str, value: Column) -> Column:
    return F.when(F.col("organizacion") == org, value)


def org_comparison(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    a, b = list(orgs)[:2]
    return org_category_products(ventas, periods, orgs).groupBy("categoria").agg(
        mean(_of(a, _n())).alias(f"promedio_productos_{a}"), mean(_of(b, _n())).alias(f"promedio_productos_{b}"),
        F.round(F.avg(_of(a, _n())) - F.avg(_of(b, _n())), 2).alias(f"diferencia_{a}_vs_{b}"),
    )


def org_comparison_with_activity(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    # (organisation, category, quarter) is unique here, so counting rows counts quarters.
    return org_category_products(ventas, periods, orgs).groupBy("categoria").agg(
        *[F.avg(_of(o, _n())).alias(f"promedio_productos_{o}") for o in orgs],
        F.avg(_n()).alias("promedio_productos_total"),
        *[F.count(_of(o, F.col("trimestre"))).alias(f"trimestres_{o}") for o in orgs],
    )


def org_matrix(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    a, b = list(orgs)[:2]
    diff = F.col(f"diferencia_{a}_minus_{b}")
    matrix = org_category_products(ventas, periods, orgs).groupBy("categoria").agg(
        mean(_of(a, _n())).alias(f"promedio_{a}"), mean(_of(b, _n())).alias(f"promedio_{b}"),
        F.round(F.avg(_of(a, _n())) - F.avg(_of(b, _n())), 2).alias(f"diferencia_{a}_minus_{b}"),
    )
    return matrix.where(F.col(f"promedio_{a}").isNotNull() | F.col(f"promedio_{b}").isNotNull()).orderBy(
        F.coalesce(F.abs(diff), F.lit(0.0)).desc(), "categoria"
    )


def org_category_average(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    n = _n()
    return org_category_products(ventas, periods, orgs).groupBy("organizacion", "categoria").agg(
        mean(n).alias("promedio_productos"), F.min(n).alias("min_productos"), F.max(n).alias("max_productos")
    )


def org_matrix_with_total(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """Matrix with a grand-total row, told apart from a NULL category by `grouping`."""
    base = org_category_products(ventas, periods, orgs)
    return base.rollup("categoria").agg(
        F.grouping("categoria").alias("_total"),
        *[mean(_of(o, _n())).alias(o) for o in orgs], mean(_n()).alias("PROMEDIO_GENERAL"),
        *[F.count_distinct(_of(o, F.col("trimestre"))).alias(f"trimestres_{o}") for o in orgs],
    ).withColumn(
        "categoria", F.when(F.col("_total") == 1, "TOTAL_GENERAL").otherwise(F.col("categoria"))
    ).orderBy("_total", F.col("PROMEDIO_GENERAL").desc()).drop("_total")


def average_by_dedup(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    seen = active(ventas, periods, orgs).select("organizacion", "categoria", "trimestre", "producto_id").distinct()
    counts = seen.groupBy("organizacion", "categoria", "trimestre").agg(F.count("*").alias("productos_unicos"))
    return counts.groupBy("organizacion", "categoria").agg(mean(_n()).alias("promedio_productos"))


def category_masks(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """The quarters of each category as a `Mask` m; what all presence reports start from, so it can be stored once."""
    return _masks(active(ventas, periods, orgs), "categoria", periods)


def presence(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """Presence pattern per category over the quarters ('111', '101', ...)."""
    return presence_of(category_masks(ventas, periods, orgs), periods)


def presence_of(masks: DataFrame, periods: Periods) -> DataFrame:
    m = Mask.of("m", len(periods))
    return masks.select(
        "categoria", *[m.has(i).alias(f"presente_q{i}") for i in range(1, len(periods) + 1)],
        m.text().alias("patron_presencia"), m.size().alias("trimestres_activos"),
    )


def _losses(m: Mask) -> Column:
    """Pairs (i, j) of quarters, the category being in i and not in j: each quarter with the next, and the first with the last."""
    pairs = F.transform(F.filter(m.without(m.earlier()).members(), lambda i: i < m.n), lambda i: F.struct(i.alias("i"), (i + 1).alias("j")))
    if m.n <= 2:
        return pairs
    ends = F.when(m.has(1) & ~m.has(m.n), F.array(F.struct(F.lit(1).alias("i"), F.lit(m.n).alias("j"))))
    return F.concat(pairs, F.coalesce(ends, F.array().cast("array<struct<i:int,j:int>>")))


def lost_categories(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return lost_of(category_masks(ventas, periods, orgs), periods)


def lost_of(masks: DataFrame, periods: Periods) -> DataFrame:
    n, spark = len(periods), masks.sparkSession
    counts = masks.select(F.inline(_losses(Mask.of("m", n)))).groupBy("i", "j").agg(F.count("*").alias("cantidad"))
    calendar = periods.frame(spark)
    after, before = (calendar.select(F.col("orden").alias(k), F.col("trimestre").alias(name)) for k, name in (("j", "trimestre_sin_compra"), ("i", "trimestre_referencia")))
    pairs = calendar.where(F.col("orden") < n).select(F.col("orden").alias("i"), (F.col("orden") + 1).alias("j"))
    pairs = pairs.unionByName(spark.createDataFrame([(1, n)], "i int, j int")) if n > 2 else pairs
    named = pairs.join(F.broadcast(after), "j").join(F.broadcast(before), "i")
    to_last = F.when(F.col("j") - F.col("i") > 1, "_VS_Q1").otherwise("")
    return named.join(counts, ["i", "j"], "left").select(
        F.concat(F.lit("CATEGORÍAS_NO_COMPRADAS_EN_Q"), F.col("j").cast("string"), to_last).alias("tipo_analisis"),
        "trimestre_sin_compra", "trimestre_referencia", F.coalesce("cantidad", F.lit(0).cast("bigint")).alias("cantidad_categorias"),
    )


def lost_category_listing(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return lost_listing_of(category_masks(ventas, periods, orgs), periods)


def lost_listing_of(masks: DataFrame, periods: Periods) -> DataFrame:
    i, j = F.col("i").cast("string"), F.col("j").cast("string")
    return masks.select("categoria", F.inline(_losses(Mask.of("m", len(periods))))).select(
        "categoria", F.concat(F.lit("LISTADO_CATEGORÍAS_Q"), i, F.lit("_NO_Q"), j).alias("tipo_listado"),
        F.concat(F.lit("Categoría presente en Q"), i, F.lit(" pero ausente en Q"), j).alias("descripcion"),
    )


def categories_per_quarter(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return per_quarter_of(category_masks(ventas, periods, orgs), periods)


def per_quarter_of(masks: DataFrame, periods: Periods) -> DataFrame:
    m = Mask.of("m", len(periods))
    return masks.agg(
        F.lit("ESTADÍSTICAS_CATEGORÍAS_POR_TRIMESTRE").alias("analisis"),
        *[F.count_if(m.has(i)).alias(f"categorias_Q{i}") for i in range(1, len(periods) + 1)],
    )


def _names(numbers: Column, sep: str, last: str | None = None) -> Column:
    """Q1<sep>Q2<last>Q3 for an array of quarters."""
    names = F.transform(numbers, lambda i: F.concat(F.lit("Q"), i.cast("string")))
    if last is None:
        return F.array_join(names, sep)
    head = F.slice(names, F.lit(1), F.greatest(F.lit(0), F.size(names) - 1))
    return F.when(F.size(names) > 1, F.concat(F.array_join(head, sep), F.lit(last), F.element_at(names, -1))).otherwise(F.array_join(names, sep))


def _pattern_name(m: Mask) -> Column:
    """Description of a presence pattern, the quarters in the order of the first one's state."""
    here = F.concat(F.lit("PRESENTE_"), _names(m.members(), "_"))
    away = F.concat(F.lit("AUSENTE_"), _names(m.absent().members(), "_"))
    return first_match([
        (m.full(), "PRESENTE_EN_TODOS"), (m.size() == 1, F.concat(F.lit("SOLO_Q"), m.first().cast("string"))), (m.has(1), F.concat(here, F.lit("_"), away)),
    ], F.concat(away, F.lit("_"), here))


def _irregular(m: Mask) -> Column:
    """Gone and back again, or missing from both the first and the last quarter."""
    return ~m.gapless() | (~m.has(1) & ~m.has(m.n))


def presence_distribution(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return distribution_of(category_masks(ventas, periods, orgs), periods)


def distribution_of(masks: DataFrame, periods: Periods) -> DataFrame:
    m = Mask.of("m", len(periods))
    names = [f"m{w}" for w in range(len(m.words))]
    counts = masks.groupBy(*names).agg(F.count("*").alias("cantidad_categorias"))
    total = masks.agg(F.count("*")).scalar()
    return counts.select(
        m.text().alias("patron_presencia"), _pattern_name(m).alias("descripcion_patron"), "cantidad_categorias",
        ratio(F.col("cantidad_categorias"), total).alias("porcentaje"),
    )


def presence_problems(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return problems_of(category_masks(ventas, periods, orgs), periods)


def problems_of(masks: DataFrame, periods: Periods) -> DataFrame:
    m = Mask.of("m", len(periods))
    totals = masks.agg(F.count_if(m.only(1)).alias("a"), F.count_if(_irregular(m)).alias("b"), F.count_if(~m.has(1)).alias("c"))
    return rows_of(totals, ["tipo_problema", "cantidad", "descripcion"], [
        ("CATEGORÍAS_DESAPARECIDAS_DESPUÉS_Q1", F.col("a"), "Categorías que solo aparecen en Q1"),
        ("CATEGORÍAS_INTERMITENTES", F.col("b"), "Categorías con patrón de presencia irregular"),
        ("CATEGORÍAS_APARICIÓN_TARDÍA", F.col("c"), "Categorías que no estaban en Q1 pero aparecen después"),
    ])


def problem_listing(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return problem_listing_of(category_masks(ventas, periods, orgs), periods)


def problem_listing_of(masks: DataFrame, periods: Periods) -> DataFrame:
    n, m = len(periods), Mask.of("m", len(periods))
    away = _names(m.absent().members(), ", ", " y ")
    later = _names(F.sequence(F.lit(2), F.lit(max(2, n))), ", ", " y ")
    return matching(masks, ["tipo_problema", "detalle"], [
        (m.only(1), "POSIBLE_DESCONTINUACIÓN", "Solo presente en Q1"),
        (m.has(1) & m.has(n) & ~m.full(), f"CATEGORÍA_INTERMITENTE_Q1_Q{n}", F.concat(F.lit(f"Presente en Q1 y Q{n} pero ausente en "), away)),
        (~m.has(1) & (m.size() == n - 1), "NUEVA_CATEGORÍA_EXITOSA", F.concat(F.lit("Ausente en Q1 pero presente en "), later)),
    ], keep=["categoria"])


def presence_executive(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return executive_of(category_masks(ventas, periods, orgs), periods)


def executive_of(masks: DataFrame, periods: Periods) -> DataFrame:
    n, m = len(periods), Mask.of("m", len(periods))
    irregular = "(patrón 101 o 010)" if n == 3 else "(con huecos, o ausentes en el primero y el último trimestre)"
    metrics = [
        ("TOTAL_CATEGORÍAS_ÚNICAS", F.lit(True), "Total de categorías únicas que aparecieron en al menos un trimestre"),
        ("CATEGORÍAS_ESTABLES", m.full(), f"Categorías que aparecen en los {n} trimestres (patrón {'1' * n})"),
        ("CATEGORÍAS_PROBLEMÁTICAS", ~m.full(), f"Categorías que NO aparecen en los {n} trimestres"),
        ("CATEGORÍAS_DESCONTINUADAS", m.has(1) & m.gapless() & ~m.full(), "Categorías que desaparecieron después de aparecer"),
        ("CATEGORÍAS_NUEVAS", ~m.has(1), "Categorías que aparecieron después de Q1"),
        ("CATEGORÍAS_INTERMITENTES", _irregular(m), f"Categorías con presencia irregular {irregular}"),
    ]
    totals = masks.agg(*[F.count_if(c).alias(f"m{i}") for i, (_, c, _) in enumerate(metrics)])
    return rows_of(totals, ["metrica", "valor", "descripcion", "porcentaje_del_total"], [
        (name, F.col(f"m{i}"), text, ratio(F.col(f"m{i}"), F.col("m0"))) for i, (name, _, text) in enumerate(metrics)
    ])


def catalogue_stability(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return stability_of(category_masks(ventas, periods, orgs), periods)


def stability_of(masks: DataFrame, periods: Periods) -> DataFrame:
    t = masks.agg(F.count_if(Mask.of("m", len(periods)).full()).alias("s"), F.count("*").alias("t"))
    s, n = F.col("s"), F.col("t")
    return t.select(
        F.lit("ÍNDICE_ESTABILIDAD_CATÁLOGO").alias("metrica"), ratio(s, n).alias("porcentaje_estabilidad"),
        first_match([(s * 100 >= n * 80, "CATÁLOGO_MUY_ESTABLE"), (s * 100 >= n * 60, "CATÁLOGO_ESTABLE"),
                     (s * 100 >= n * 40, "CATÁLOGO_MODERADAMENTE_ESTABLE")], "CATÁLOGO_INESTABLE").alias("clasificacion_estabilidad"),
        F.concat(F.lit("De "), n.cast("string"), F.lit(" categorías únicas, "), s.cast("string"),
                 F.lit(f" aparecen en los {len(periods)} trimestres")).alias("interpretacion"),
    )


# The reports of the presence script, each from the stored masks.
PRESENCE_REPORTS = {
    "presence": presence_of, "lost_categories": lost_of, "lost_category_listing": lost_listing_of, "categories_per_quarter": per_quarter_of,
    "presence_distribution": distribution_of, "presence_problems": problems_of, "problem_listing": problem_listing_of,
    "presence_executive": executive_of, "catalogue_stability": stability_of,
}


def presence_bundle(store: TableStore, ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> dict[str, DataFrame]:
    """All presence reports from one scan of the sales, whose masks are stored as the table `presence_masks`."""
    masks = store.replace("presence_masks", category_masks(ventas, periods, orgs))
    return {name: report(masks, periods) for name, report in PRESENCE_REPORTS.items()}


# State labels kept as the reports word them: 'vacia' marks a category that is present.
PRESENT, ABSENT = "vacia", "no comprada"


def _universe(known: DataFrame, periods: Periods) -> DataFrame:
    """Every (quarter, category) pair, by exploding the calendar on the distinct categories."""
    return known.select("categoria").distinct().select(
        F.explode(F.array(*[F.lit(t) for t in periods.labels])).alias("trimestre"), "categoria"
    )


def category_states(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """State of every category in every quarter, from the presence masks (one shuffle)."""
    m = Mask.of("m", len(periods))

    def marked(quarters: Column, state: str) -> Column:
        return F.transform(quarters, lambda i: F.struct(i.alias("orden"), F.lit(state).alias("estado")))

    states = F.concat(marked(m.members(), PRESENT), marked(m.absent().members(), ABSENT))
    named = _calendar(ventas, periods).select("orden", "trimestre")
    return category_masks(ventas, periods, orgs).select("categoria", F.inline(states)).join(named, "orden").select("trimestre", "categoria", "estado")


def category_states_by_join(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    known = active(ventas, periods, orgs).where(F.col("categoria").isNotNull()).select("trimestre", "categoria").distinct()
    seen = known.withColumn("_seen", F.lit(True))
    return _universe(known, periods).join(seen, ["trimestre", "categoria"], "left").select(
        "trimestre", "categoria", F.when(F.col("_seen"), PRESENT).otherwise(ABSENT).alias("estado")
    )


def category_states_by_sum(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    """Appearances per (quarter, category) summed over universe and facts together."""
    facts = active(ventas, periods, orgs).where(F.col("categoria").isNotNull()).select("trimestre", "categoria")
    counted = facts.groupBy("trimestre", "categoria").agg(F.count("*").alias("n"))
    padded = counted.unionByName(_universe(counted, periods).withColumn("n", F.lit(0).cast("bigint")))
    return padded.groupBy("trimestre", "categoria").agg(
        F.when(F.sum("n") > 0, PRESENT).otherwise(ABSENT).alias("estado")
    )


def category_states_by_rank(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    known = active(ventas, periods, orgs).where(F.col("categoria").isNotNull()).select("trimestre", "categoria").distinct()
    both = known.withColumn("p", F.lit(1)).unionByName(_universe(known, periods).withColumn("p", F.lit(2)))
    w = Window.partitionBy("trimestre", "categoria").orderBy("p")
    return both.withColumn("r", F.dense_rank().over(w)).where(F.col("r") == 1).select(
        "trimestre", "categoria", F.when(F.col("p") == 1, PRESENT).otherwise(ABSENT).alias("estado")
    ).distinct()


def _no_category() -> Column:
    c = F.col("categoria")
    return c.isNull() | (F.trim(c) == "") | (c == "sin categoria")


def cleaned_categories(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    clean = F.when(_no_category(), "vacio").otherwise(F.upper(F.trim("categoria")))
    return active(ventas, periods, orgs).groupBy("organizacion", "trimestre", clean.alias("categoria_limpia")).agg(
        F.count("*").alias("cantidad_registros")
    )


def rows_without_category(ventas: DataFrame, periods: Periods, orgs: Mapping[str, int] = ORGS) -> DataFrame:
    return active(ventas, periods, orgs).where(_no_category()).groupBy("organizacion", "trimestre").agg(
        F.count("*").alias("registros_sin_categoria")
    )
