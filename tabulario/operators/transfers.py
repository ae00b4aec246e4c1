"""Pairs of caller and dialled number, redirections and their network.

Pair reports rank first and describe afterwards: frequencies are counted for
all pairs, lists and distinct values only for the pairs that are shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.calls import (
    TRANSFER_MODES, different, equal, failed, has_label, location, menu_option, raw_seconds, redirected, seconds, transfer,
)
from tabulario.functions.exact import mean, mean_share, ratio
from tabulario.functions.text import filled, is_blank, sorted_set
from tabulario.operators.reports import clean_interactions, daily_sessions
from tabulario.plans.heavy import most_frequent
from tabulario.plans.shape import bounded_list, first_match, join_on, listed, matching, only, ranked, top_per_key, value_rows, whole_lists, with_distinct_counts
from tabulario.sources.periods import Periods

PAIR = ["numero_entrada", "numero_digitado"]
N = "frecuencia_combinacion"


def _figures() -> list[Column]:
    return [F.count("*").alias(N), F.size(F.collect_set("fecha")).cast("bigint").alias("dias_activos")]


def _dates() -> list[Column]:
    return [F.min("fecha").alias("primera_aparicion"), F.max("fecha").alias("ultima_aparicion")]


def _lists() -> dict[str, tuple[Column, str]]:
    return {
        "menu_opciones_usadas": (menu_option(), ", "), "etiquetas_patron": (F.col("etiquetas"), "|"), "zonas_afectadas": (F.col("id_8T"), ","),
        "divisiones_areas": (location(), ", "),
    }


def _described(rows: DataFrame, keys: Sequence[str] = PAIR, dates: bool = True, more: Sequence[Column] = ()) -> DataFrame:
    """Figures and lists of the keys of `rows`, which are few; `more` aggregates."""
    return rows.groupBy(*keys).agg(*_figures(), *(_dates() if dates else []), *listed(_lists()), *more)


def _top(rows: DataFrame, limit: int, keys: Sequence[str] = PAIR, by_cells: bool = False) -> DataFrame:
    """The most frequent keys; `by_cells` finds them without counting all keys, for logs with very many."""
    if by_cells:
        return most_frequent(rows, keys, N, limit)
    return ranked(rows.groupBy(*keys).agg(F.count("*").alias(N)), N, keys, limit)


def transfer_pairs(llamadas: DataFrame, limit: int = 15, mode: str = "null_kept", by_cells: bool = False) -> DataFrame:
    """Most frequent transfer pairs with what was used on them; a NULL dialled number is its own pair."""
    rows = llamadas.where(transfer(mode))
    shown = only(rows, _top(rows, limit, by_cells=by_cells), PAIR)
    return _described(shown, more=[sorted_set(F.col("trimestre"), ",").alias("trimestres_activos")])


def pair_values(llamadas: DataFrame, mode: str = "null_kept") -> DataFrame:
    """What the lists of the pair reports hold, for every pair and as rows: (pair, lista, valor)."""
    return value_rows(llamadas.where(transfer(mode)), PAIR, {name: c for name, (c, _) in _lists().items()})


def complete_pairs(llamadas: DataFrame, limit: int = 15, trimestre: str | None = None) -> DataFrame:
    """Same for known dialled numbers only, optionally of one quarter."""
    rows = llamadas.where(transfer("strict"))
    if trimestre is not None:
        rows = rows.where(F.col("trimestre") == trimestre)
    return _described(only(rows, _top(rows, limit), PAIR))


def first_of_pair(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    """Earliest row of each pair, by date, time and id."""
    held = ("fecha", "hora_inicio_seg", "idRe", "menu", "opcion", "etiquetas", "id_8T", "division", "area")
    first = llamadas.where(transfer()).groupBy(*PAIR).agg(F.min(F.struct(*held)).alias("r"))
    shown = first.orderBy("numero_entrada", F.col("numero_digitado").asc_nulls_first()).limit(limit)
    return shown.select(*PAIR, *[F.col(f"r.{c}").alias(c) for c in held if c != "hora_inicio_seg"])


def pairs_joined_to_dates(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    """Pair report whose first and last dates come from a separate keyed aggregate."""
    rows = llamadas.where(transfer())
    shown = _described(only(rows, _top(rows, limit), PAIR), dates=False)
    return join_on(shown, rows.groupBy(*PAIR).agg(*_dates()), PAIR)


def pairs_by_null(llamadas: DataFrame, limit: int = 10, null_limit: int = 5) -> DataFrame:
    """Pairs with and without a dialled number, each with its own limit."""
    known, missing = llamadas.where(transfer("strict")), llamadas.where(F.col("numero_entrada").isNotNull() & F.col("numero_digitado").isNull())

    def part(rows: DataFrame, k: int, label: str) -> DataFrame:
        return _described(only(rows, _top(rows, k), PAIR)).withColumn("tipo_digitado", F.lit(label))

    return part(known, limit, "NOT_NULL").unionByName(part(missing, null_limit, "NULL"))


def pairs_by_quarter_totals(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    """Per-quarter pair reports added up; days are summed and per-quarter lists kept whole."""
    rows = llamadas.where(transfer())
    shown = only(rows, _top(rows, limit), PAIR)
    quarterly = _described(shown, [*PAIR, "trimestre"])
    return quarterly.groupBy(*PAIR).agg(
        F.sum(N).alias(N), sorted_set(F.col("menu_opciones_usadas"), " | ").alias("menu_opciones_usadas"),
        sorted_set(F.col("etiquetas_patron"), " | ").alias("etiquetas_patron"), sorted_set(F.col("zonas_afectadas"), ",").alias("zonas_afectadas"),
        sorted_set(F.col("divisiones_areas"), " | ").alias("divisiones_areas"), F.sum("dias_activos").alias("total_dias_activos"),
        F.min("primera_aparicion").alias("primera_aparicion"), F.max("ultima_aparicion").alias("ultima_aparicion"),
        sorted_set(F.col("trimestre"), ",").alias("trimestres_activos"),
    )


def top_pairs_per_quarter(llamadas: DataFrame, limit: int = 5) -> DataFrame:
    rows, keys = llamadas.where(transfer()), ["trimestre", *PAIR]
    counts = rows.groupBy(*keys).agg(F.count("*").alias(N))
    order = [F.col(N).desc(), *[F.col(k).asc_nulls_first() for k in PAIR]]
    return _described(only(rows, top_per_key(counts, ["trimestre"], order, limit), keys), keys)


def appearance_dates(llamadas: DataFrame, pairs: DataFrame) -> DataFrame:
    """First and last date of the given pairs; NULL dialled numbers match each other."""
    dates = llamadas.where(transfer()).groupBy(*PAIR).agg(F.min("fecha").alias("primera_aparicion"), F.max("fecha").alias("ultima_aparicion"))
    return join_on(pairs, dates, PAIR)


def pair_summary(llamadas: DataFrame, limit: int = 15) -> DataFrame:
    """Pair report with menus and options listed apart."""
    rows = llamadas.where(transfer())
    shown = only(rows, _top(rows, limit), PAIR)
    report = shown.groupBy(*PAIR).agg(*_figures(), *_dates(), *listed({"_m": (F.col("menu"), ","), "_o": (F.col("opcion"), ",")}))
    return report.withColumn("menu_opciones_usadas", F.concat("_m", F.lit(":"), "_o")).drop("_m", "_o")


def transfer_variants(llamadas: DataFrame) -> DataFrame:
    """Which predicate variants keep a row; rows kept by none are left out."""
    kept = llamadas.select("idRe", *PAIR, *[F.coalesce(transfer(m), F.lit(False)).alias(m) for m in TRANSFER_MODES])
    return kept.where(F.col("strict") | F.col("null_kept") | F.col("explicit_null") | F.col("trimmed"))


def redirections(llamadas: DataFrame, limit: int = 20, by_cells: bool = False) -> DataFrame:
    rows, keys = llamadas.where(redirected()), ["id_CTransferencia"]
    top = _top(rows, limit, keys, by_cells)
    lists = listed({
        "menus_que_redirigen": (menu_option(), ", "), "contexto_organizacional": (location(), ", "), "patron_etiquetas": (F.col("etiquetas"), " | ")})
    shown = only(rows, top, keys).groupBy(*keys).agg(
        F.count("*").alias("frecuencia_redireccion"),
        F.size(F.collect_set("fecha")).cast("bigint").alias("dias_activos"), F.min("fecha").alias("primera_redireccion"),
        F.max("fecha").alias("ultima_redireccion"), F.count_if(different()).alias("casos_con_procesamiento_interno"), *lists,
    )
    return with_distinct_counts(shown, only(rows, top, keys), keys, {"usuarios_redirigidos": ["numero_entrada"], "referencias_cIdentifica": ["cIdentifica"]})


def _first_menus(rows: DataFrame, key: str, name: str, k: int = 5) -> DataFrame:
    return bounded_list(rows, [key], "menu", k, ",", name)


def processing_types(llamadas: DataFrame) -> DataFrame:
    """Rows with equal, different and missing dialled number; '' is both different and missing."""
    rules = [(equal(), "NUMEROS_IGUALES"), (different(), "NUMEROS_DIFERENTES"), (is_blank(F.col("numero_digitado")), "NUMERO_DIGITADO_NULO")]
    rows = matching(llamadas.withColumn("_red", redirected()), ["tipo_procesamiento"], rules, keep=["numero_entrada", "menu", "_red"])
    found = rows.groupBy("tipo_procesamiento").agg(
        F.count("*").alias("casos"), F.count_distinct("numero_entrada").alias("usuarios_unicos"), F.count_if("_red").alias("con_redireccion_real"))
    return found.join(_first_menus(rows, "tipo_procesamiento", "menus_frecuentes"), "tipo_procesamiento", "left")


def number_relation(llamadas: DataFrame) -> DataFrame:
    relation = first_match([(equal(), "IGUALES"), (different(), "DIFERENTES")])
    return llamadas.withColumn("relacion", relation).where(F.col("relacion").isNotNull()).groupBy("relacion").agg(
        F.count("*").alias("casos"), F.count_distinct("numero_entrada").alias("numeros_unicos"), mean(raw_seconds()).alias("duracion_promedio"))


def external_references(llamadas: DataFrame) -> DataFrame:
    ref = F.col("cIdentifica")
    rows = llamadas.withColumn("tipo_registro", F.when(filled(ref), "CON_CIDENTIFICA").otherwise("SIN_CIDENTIFICA"))
    found = rows.groupBy("tipo_registro").agg(
        F.count("*").alias("total_registros"), F.count_distinct("numero_entrada").alias("usuarios"), F.count_if(redirected()).alias("tambien_con_redireccion"),
        F.count_if(has_label("VSI")).alias("con_validacion_vsi"))
    found = with_distinct_counts(found, rows, ["tipo_registro"], {"referencias_unicas": [F.when(filled(ref), ref)]})
    return found.join(_first_menus(rows, "tipo_registro", "menus"), "tipo_registro", "left")


def redirection_profiles(llamadas: DataFrame) -> DataFrame:
    """Callers grouped by how they are redirected."""
    n, red, internal = F.col("n"), F.col("red"), F.col("internal")
    users = llamadas.groupBy("numero_entrada").agg(
        F.count("*").alias("n"), F.count_distinct("id_CTransferencia").alias("dest"), F.count_if(redirected()).alias("red"),
        F.count_if(different()).alias("internal"), F.count_if(has_label("VSI")).alias("vsi"),
        (F.count("cIdentifica") > 0).alias("refs"), F.count_if(failed()).alias("bad"))
    profile = first_match([
        ((red > 0) & (F.col("dest") > 2), "USUARIO_MULTI_REDIRECCION"), (red > 0, "USUARIO_CON_REDIRECCION"),
        (internal * 2 > n, "USUARIO_PROCESAMIENTO_INTERNO"), (F.col("vsi") * 10 > n * 8, "USUARIO_VALIDADO_SISTEMA"),
        (F.col("bad") * 2 > n, "USUARIO_PROBLEMATICO"), (F.col("refs"), "USUARIO_CON_REFERENCIAS_EXTERNAS"),
    ], "USUARIO_ESTANDAR")
    return users.groupBy(profile.alias("perfil_usuario")).agg(
        F.count("*").alias("usuarios_en_perfil"), mean(n).alias("promedio_interacciones"),
        mean_share(red, n).alias("promedio_pct_con_redireccion"), mean_share(internal, n).alias("promedio_pct_procesamiento_interno"))


def transfer_network(llamadas: DataFrame, limit: int = 25) -> DataFrame:
    """Most frequent pairs, marked when calls also run the other way."""
    rows = llamadas.where(transfer("strict") & (F.col("numero_digitado") != ""))
    top = _top(rows, limit)
    swapped = F.broadcast(top.select(F.col("numero_entrada").alias("_d"), F.col("numero_digitado").alias("_e")))
    back = llamadas.join(swapped, (F.col("numero_entrada") == F.col("_e")) & (F.col("numero_digitado") == F.col("_d"))).select(
        F.col("_d").alias("numero_entrada"), F.col("_e").alias("numero_digitado")).distinct().withColumn("_back", F.lit("SI"))
    lists = listed({
        "menus_generadores": (menu_option(), ", "), "contexto_organizacional": (location(), ", "), "patron_etiquetas": (F.col("etiquetas"), " | ")})
    shown = only(rows, top, PAIR).groupBy(*PAIR).agg(
        F.count("*").alias("frecuencia_transferencia"),
        F.size(F.collect_set("fecha")).cast("bigint").alias("dias_activos"), F.min("fecha").alias("primera_transferencia"),
        F.max("fecha").alias("ultima_transferencia"), *lists)
    return shown.join(back, PAIR, "left").withColumn("es_bidireccional", F.coalesce("_back", F.lit("NO"))).drop("_back")


def redirection_edges(llamadas: DataFrame) -> DataFrame:
    return llamadas.where(F.col("numero_entrada").isNotNull() & redirected()).groupBy(
        F.col("numero_entrada").alias("nodo_origen"), F.col("id_CTransferencia").alias("nodo_destino")
    ).agg(
        F.count("*").alias("peso_conexion"), F.size(F.collect_set("fecha")).cast("bigint").alias("dias_conexion"),
        sorted_set(F.col("menu"), ",").alias("menus_generadores"), sorted_set(location(), ",").alias("ubicaciones"),
        F.avg(seconds()).alias("duracion_promedio_antes_redireccion"))


def redirection_nodes(llamadas: DataFrame) -> DataFrame:
    """Kind, degree and weight of callers (out) and destinations (in); what is both counts as a caller."""
    edges = llamadas.where(F.col("numero_entrada").isNotNull() & redirected()).groupBy("numero_entrada", "id_CTransferencia").agg(F.count("*").alias("w"))
    zero = F.lit(0).cast("bigint")

    def side(col: str, out: bool) -> DataFrame:
        deg, weight = F.count("*"), F.sum("w")
        return edges.groupBy(F.col(col).alias("nodo")).agg(
            F.lit("USUARIO" if out else "DESTINO").alias("tipo_nodo"),
            (deg if out else zero).alias("grado_salida"), (zero if out else deg).alias("grado_entrada"),
            (weight if out else zero).alias("peso_total_salida"), (zero if out else weight).alias("peso_total_entrada"))

    cols = ["grado_salida", "grado_entrada", "peso_total_salida", "peso_total_entrada"]
    return side("numero_entrada", True).unionByName(side("id_CTransferencia", False)).groupBy("nodo").agg(F.max("tipo_nodo").alias("tipo_nodo"), *[F.sum(c).alias(c) for c in cols])


def official_vs_derived(llamadas: DataFrame, periods: Periods) -> DataFrame:
    """Sessions with equal numbers against the others."""
    s = daily_sessions(llamadas, periods)
    return s.groupBy(F.col("tipo_llamada").alias("tipo")).agg(
        F.count_distinct("numero_entrada").alias("usuarios_unicos"), F.avg("total_interacciones").alias("promedio_interacciones"),
        F.avg("menus_visitados").alias("promedio_menus"))


def official_vs_derived_by_zone(llamadas: DataFrame) -> DataFrame:
    """Callers and their average number of rows per zone and relation."""
    rows = llamadas.withColumn("tipo", first_match([(equal(), "OFICIAL"), (different(), "DERIVADO")])).where(F.col("tipo").isNotNull())
    users = rows.groupBy(F.col("id_8T").alias("zona"), "tipo", "numero_entrada").agg(F.count("*").alias("n"))
    return users.groupBy("zona", "tipo").agg(F.count("*").alias("usuarios_unicos"), mean(F.col("n")).alias("promedio_interacciones"))


def derived_share_by_quarter(llamadas: DataFrame, periods: Periods) -> DataFrame:
    return llamadas.groupBy(periods.label_of(F.col("fecha")).alias("trimestre")).agg(
        F.count_if(equal()).alias("oficiales"), F.count_if(different()).alias("derivadas"),
        ratio(F.count_if(different()), F.count("*")).alias("pct_derivadas"))


def _behaviour(days: int, per_day: int) -> Column:
    n, d, avg = F.col("frecuencia_uso"), F.col("dias_activos"), F.col("duracion_promedio")
    return first_match([(d > days, "POSIBLE_INTERNO"), (avg < 5, "AUTOMATICO"), (n > d * per_day, "ALTO_VOLUMEN")], "NORMAL")


def _usage(rows: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("frecuencia_uso"), F.size(F.collect_set("fecha")).cast("bigint").alias("dias_activos"),
        F.avg(duration).alias("duracion_promedio"), sorted_set(menu_option(), ",").alias("opciones_usadas"))


def derived_pairs(llamadas: DataFrame, periods: Periods, days: int = 30, per_day: int = 20) -> DataFrame:
    """Behaviour class of every derived pair, missing dialled numbers included."""
    rows = clean_interactions(llamadas, periods).where(F.col("tipo_llamada") == "DERIVADO")
    duration = F.col("hora_fin_real") - F.col("hora_inicio_real")
    return _usage(rows, PAIR, duration).withColumn("patron_comportamiento", _behaviour(days, per_day))


def derived_pairs_by_zone(llamadas: DataFrame, days: int = 20, per_day: int = 15, limit: int = 20) -> DataFrame:
    """Most used derived pairs per quarter and zone; known dialled numbers and recorded times only."""
    keys = [*PAIR, "zona"]
    rows = llamadas.where(different()).withColumn("zona", F.col("id_8T"))
    counts = rows.groupBy("trimestre", *keys).agg(F.count("*").alias(N))
    order = [F.col(N).desc(), *[F.col(k).asc_nulls_first() for k in keys]]
    shown = only(rows, top_per_key(counts, ["trimestre"], order, limit), ["trimestre", *keys])
    return _usage(shown, ["trimestre", *keys], raw_seconds()).withColumn("patron_comportamiento", _behaviour(days, per_day))


def suspicious_pairs(llamadas: DataFrame, periods: Periods, days: int = 30, per_day: int = 20) -> DataFrame:
    return derived_pairs(llamadas, periods, days, per_day).where(F.col("patron_comportamiento") != "NORMAL").select(
        *PAIR, "dias_activos", ratio(F.col("frecuencia_uso"), F.col("dias_activos"), 2, 1).alias("interacciones_promedio"),
        "patron_comportamiento", "opciones_usadas")
