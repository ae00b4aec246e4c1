"""Registered queries: key -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.functions.calls import start, transfer
from tabulario.operators import calls, digital, eda, journeys, labels, operations, reports, rollups, sales, service, transfers
from tabulario.plans.sessions import steps
from tabulario.sources.calls import normalise, union_quarters
from tabulario.sources.fixtures import LOG_PERIODS, SALES_CALENDAR, SALES_DAYS, SALES_PERIODS, SALES_WHOLE, Tables
from tabulario.sources.storage import session_store

ORACLES = ["sales", "eda", "calls", "reports", "transfers", "labels", "journeys", "service"]

# Run date of the reports that look back from a day.
AS_OF = dt.date(2024, 1, 31)
# Label fragments that occur in the test tables.
OTHER_CODES = {"TELCO": "TELECOM", "SOMC": "FUERA_MEXICO", "QJA_": "PROCESO_QUEJA"}


def _sales(fn, **kw):
    return lambda t, periods=SALES_PERIODS: fn(t.ventas, periods, **kw)


SALES = {
    "s01_pre_check": _sales(sales.pre_check),
    "s02_distinct_products": _sales(sales.distinct_products),
    "s03_product_diversity": _sales(sales.product_diversity),
    "s04_products_by_org": _sales(sales.products_by_org),
    "s05_products_by_first_appearance": _sales(sales.products_by_first_appearance),
    "s06_quarter_variation": _sales(sales.quarter_variation),
    "s07_org_quarter_metrics": _sales(sales.org_quarter_metrics),
    "s08_org_summary": _sales(sales.org_summary),
    "s09_product_lifecycle": _sales(sales.product_lifecycle),
    "s10_executive_products": _sales(sales.executive_products),
    "s11_category_products": _sales(sales.category_products),
    "s12_category_statistics": _sales(sales.category_statistics),
    "s13_overall_statistics": _sales(sales.overall_statistics),
    "s14_average_ranges": _sales(sales.average_ranges),
    "s15_category_variability": _sales(sales.category_variability),
    "s16_top_bottom_categories": _sales(sales.top_bottom_categories),
    "s17_executive_categories": _sales(sales.executive_categories),
    "s18_category_average": _sales(sales.category_average),
    "s19_org_comparison": _sales(sales.org_comparison),
    "s20_org_comparison_with_activity": _sales(sales.org_comparison_with_activity),
    "s21_org_matrix": _sales(sales.org_matrix),
    "s22_org_category_average": _sales(sales.org_category_average),
    "s23_org_matrix_with_total": _sales(sales.org_matrix_with_total),
    "s24_average_by_dedup": _sales(sales.average_by_dedup),
    "s25_lost_categories": _sales(sales.lost_categories),
    "s26_lost_category_listing": _sales(sales.lost_category_listing),
    "s27_categories_per_quarter": _sales(sales.categories_per_quarter),
    "s28_presence": _sales(sales.presence),
    "s29_presence_distribution": _sales(sales.presence_distribution),
    "s30_presence_problems": _sales(sales.presence_problems),
    "s30_problem_listing": _sales(sales.problem_listing),
    "s31_presence_executive": _sales(sales.presence_executive),
    "s32_catalogue_stability": _sales(sales.catalogue_stability),
    "s33_category_states": _sales(sales.category_states),
    "s34_category_states_by_join": _sales(sales.category_states_by_join),
    "s35_category_states_by_sum": _sales(sales.category_states_by_sum),
    "s36_category_states_by_rank": _sales(sales.category_states_by_rank),
    "s37_cleaned_categories": _sales(sales.cleaned_categories),
    "s38_rows_without_category": _sales(sales.rows_without_category),
    "s02_distinct_products_all_quarters": lambda t: sales.distinct_products(t.ventas, SALES_CALENDAR),
    "s07_org_quarter_metrics_all_quarters": lambda t: sales.org_quarter_metrics(t.ventas, SALES_CALENDAR),
    "s11_category_products_all_quarters": lambda t: sales.category_products(t.ventas, SALES_CALENDAR),
}
SALES |= {f"{key}_whole_table": lambda t, build=build: build(t, SALES_WHOLE) for key, build in SALES.items() if not key.endswith("_all_quarters")}
SALES |= {f"{key}_by_day": lambda t, build=SALES[key]: build(t, SALES_DAYS) for key in ("s02_distinct_products", "s06_quarter_variation", "s11_category_products")}


def _presence_bundle(t: Tables) -> DataFrame:
    """Number of rows of each presence report, all from the one stored table."""
    reports = sales.presence_bundle(session_store(t.spark), t.ventas, SALES_WHOLE)
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("informe"), F.count("*").alias("filas")) for name, df in reports.items()])


SALES["s32_presence_bundle"] = _presence_bundle


def _eda(fn, **kw):
    return lambda t: fn(t.productos_por_trimestre, **kw)


def _eda_dated(fn, **kw):
    return lambda t: fn(t.productos_por_trimestre, LOG_PERIODS, **kw)


def _by_the_hour(t: Tables) -> DataFrame:
    """The log as a system would record it that keeps hours and product lines only, so that rows repeat."""
    hour = lambda c: F.expr(f"{c} div 3600 * 3600").cast("int")
    return t.productos_por_trimestre.withColumns({
        "cProducto": F.expr("cProducto div 10000000"), "cFecha": F.date_trunc("hour", "cFecha").cast("timestamp_ntz"), "cHInicio_seg": hour("cHInicio_seg"), "cHFin_seg": hour("cHFin_seg")})


# The ids that a report is restricted to, as nearly all these reports can be.
SOME_IDS = range(1, 51)


def _sketched_percentiles(t: Tables) -> DataFrame:
    """Per quarter and percentile whether the rows up to the estimated value are that share of all, give or take 0.5%."""
    rows = t.productos_por_trimestre.where(F.col("cProducto").isNotNull())
    found = eda.percentiles_sketched(rows)
    names = {"P05": 5, "P10": 10, "P25_Q1": 25, "P50_Mediana": 50, "P75_Q3": 75, "P90": 90, "P95": 95}
    x, n = F.col("cProducto"), F.count("*")
    below = rows.join(F.broadcast(found), "trimestre").groupBy("trimestre").agg(*[
        ((F.count_if(x < F.col(c)) <= n * (p + 0.5) / 100) & (F.count_if(x <= F.col(c)) >= n * (p - 0.5) / 100)).alias(c) for c, p in names.items()
    ])
    return below.withColumn("variable", F.lit("cProducto"))


EDA = {
    "e01_pre_check": _eda_dated(eda.pre_check),
    "e02_null_profile": _eda(eda.null_profile),
    "e02_null_profile_of_ids": _eda(eda.null_profile, ids=list(SOME_IDS)),
    "e03_null_summary": _eda(eda.null_summary),
    "e04_consistency_pre_check": _eda_dated(eda.consistency_pre_check),
    "e05_consistency_report": _eda_dated(eda.consistency_report),
    "e06_group_consistency": _eda(eda.group_consistency),
    "e07_worst_records": _eda_dated(eda.worst_records),
    "e08_valid_counts": _eda_dated(eda.valid_counts),
    "e09_numeric_summary": _eda(eda.numeric_summary),
    "e10_binary_summary": _eda(eda.binary_summary),
    "e11_quarter_comparison": _eda_dated(eda.quarter_comparison),
    "e12_histogram": _eda(eda.histogram),
    "e13_executive_dashboard": _eda_dated(eda.executive_dashboard),
    "e14_percentiles": _eda(eda.percentiles),
    "e14_percentiles_sketched": _sketched_percentiles,
    "e15_flag_correlation": _eda(eda.flag_correlation),
    "e16_structure": _eda(eda.structure),
    "e17_null_report": _eda(eda.null_report),
    "e18_time_integrity": _eda_dated(eda.time_integrity),
    "e18_numeric_ranges": _eda(eda.numeric_ranges),
    "e19_descriptive_statistics": _eda(eda.descriptive_statistics),
    "e20_distribution_shape": _eda(eda.distribution_shape),
    "e21_iqr_outliers": _eda(eda.iqr_outliers),
    "e21_iqr_outliers_true_quartiles": _eda(eda.iqr_outliers, mode="iqr"),
    "e22_rare_combinations": _eda(eda.rare_combinations),
    "e23_exact_duplicates": lambda t: eda.exact_duplicates(_by_the_hour(t)),
    "e24_logical_duplicates": _eda(eda.logical_duplicates),
    "e25_category_pareto": _eda(eda.category_pareto),
    "e26_category_cardinality": _eda(eda.category_cardinality),
    "e27_weekday_hour_pattern": _eda_dated(eda.weekday_hour_pattern),
    "e28_date_gaps": _eda_dated(eda.date_gaps),
    "e29_correlation_matrix": _eda(eda.correlation_matrix),
    "e30_contingency": _eda(eda.contingency),
    "e31_evolution_dashboard": _eda_dated(eda.evolution_dashboard),
    "e32_category_stability": _eda_dated(eda.category_stability),
    "e33_session_durations": _eda(eda.session_durations),
    "e34_business_rules": _eda_dated(eda.business_rules),
    "e35_cumulative_histogram": _eda(eda.cumulative_histogram),
    "e36_user_profile": _eda(eda.user_profile),
    "e37_anomaly_scores": _eda(eda.anomaly_scores),
    "e38_hourly_throughput": _eda_dated(eda.hourly_throughput),
    "e39_trend_projection": _eda_dated(eda.trend_projection),
    "e40_quality_scorecard": _eda_dated(eda.quality_scorecard),
    "e41_normality": _eda(eda.normality),
    "e42_chi_square": _eda(eda.chi_square),
}


def _calls(fn, **kw):
    return lambda t: fn(t.llamadas_por_trimestre, **kw)


def _raw(fn, **kw):
    return lambda t: fn(t.llamadas_crudas, **kw)


def _calls_dated(fn, **kw):
    return lambda t: fn(t.llamadas_por_trimestre, LOG_PERIODS, **kw)


def _pairs(t: Tables) -> DataFrame:
    return t.llamadas_por_trimestre.where(transfer()).select(*transfers.PAIR).distinct()


def _quarterly_tables(t: Tables) -> DataFrame:
    """The raw log as three tables, one a quarter, read as one; each branch is tagged with its table's quarter."""
    raw = t.llamadas_crudas
    return union_quarters({p.trimestre: raw.where(F.col("trimestre") == p.trimestre).drop("trimestre") for p in LOG_PERIODS})


def _step_rows(t: Tables) -> DataFrame:
    rows = t.llamadas_por_trimestre.where(F.col("numero_entrada").isNotNull())
    return steps(rows, start()).select("numero_entrada", "fecha", "idRe", "paso", "pasos", F.col("anterior.idRe").alias("anterior"))


CALLS = {
    "c01_cardinality": _calls(calls.cardinality),
    "c02_completeness": _calls(calls.completeness),
    "c02_field_domains": _calls(calls.field_domains),
    "c03_criticality": _calls(calls.criticality),
    "c04_value_domains": _calls(calls.value_domains),
    "c05_division_areas": _calls(calls.division_areas),
    "c05_menu_options": _calls(calls.menu_options),
    "c05_zone_locations": _calls(calls.zone_locations),
    "c06_key_checks": lambda t: calls.key_checks(t.llamadas_crudas, LOG_PERIODS),
    "c07_repeated_ids": _raw(calls.repeated_ids),
    "c07_repeated_ids_first_ten": _raw(calls.repeated_ids, first=10),
    "c08_daily_distribution": _calls(calls.daily_distribution),
    "c09_time_inconsistencies": _raw(calls.time_inconsistencies),
    "c10_reference_prefixes": _calls(calls.reference_prefixes),
    "c10_queue_vs_dialled": _calls(calls.queue_vs_dialled),
    "c11_integral_quality": _calls(calls.integral_quality),
    "c12_inverted_times": _calls(calls.inverted_times),
    "c12_inverted_times_first_ten": _calls(calls.inverted_times, first=10),
    "c13_base_dates": _raw(calls.base_dates),
    "c13_base_dates_first_three": _raw(calls.base_dates, first=3),
    "c14_label_consistency": _calls(calls.label_consistency),
    "c15_outside_calendar": lambda t: calls.outside_calendar(t.llamadas_crudas, LOG_PERIODS),
    "c16_malformed_references": _raw(calls.malformed_references),
    "c17_number_formats": _raw(calls.number_formats),
    "c17_invalid_numbers": _raw(calls.invalid_numbers),
    "c18_date_validation": _raw(calls.date_validation),
    "c18_invalid_dates": _raw(calls.invalid_dates),
    "c19_user_outliers": _calls(calls.user_outliers),
    "c19_user_outliers_interpolated": _calls(calls.user_outliers, mode="interpolated"),
    "c20_quality_scores": lambda t: calls.quality_scores(normalise(t.llamadas_crudas)),
    "c21_cleaning_impact": _calls(calls.cleaning_impact),
    "c21_cleaning_impact_any_time": _calls(calls.cleaning_impact, ordered_times=False),
    "c22_clean_calls": lambda t: calls.clean_calls(normalise(t.llamadas_crudas)),
    "c23_problem_records": lambda t: calls.problem_records(normalise(t.llamadas_crudas)),
    "c24_quality_dashboard": lambda t: calls.quality_dashboard(normalise(t.llamadas_crudas), AS_OF),
    "c25_sample_rows": _calls(calls.sample_rows),
    "c25_number_bounds": _calls(calls.number_bounds),
    "c26_quarter_quality": _calls(calls.quarter_quality),
    "p02_scores_of_quarterly_tables": lambda t: calls.quality_scores(normalise(_quarterly_tables(t))),
    "p03_ids_of_quarterly_tables": lambda t: calls.repeated_ids(_quarterly_tables(t)),
}

def _sketched_periods(t: Tables) -> DataFrame:
    """The report from stored daily partials, its estimated callers replaced by whether they are within 3% of the exact ones."""
    store = session_store(t.spark)
    daily = store.replace("daily_partials", rollups.daily_partials(t.llamadas, LOG_PERIODS))
    exact = rollups.period_callers(rollups.caller_bitmaps(t.llamadas, LOG_PERIODS))
    near = F.abs(F.col("usuarios_estimados") - F.col("usuarios_unicos")) <= F.col("usuarios_unicos") * 0.03
    return rollups.period_report(daily).join(exact, rollups.KEYS).withColumn("estimacion_fiel", near).drop("usuarios_estimados", "P50_sesion", "P90_sesion", "P95_sesion")


REPORTS = {
    "r01_daily_average": _calls(reports.daily_average),
    "r01_daily_average_filtered": _calls(reports.daily_average_filtered),
    "r02_weekly_average": _calls(reports.weekly_average),
    "r02_monthly_average": _calls(reports.monthly_average),
    "r02_annual_average": _calls(reports.annual_average),
    "r03_clean_interactions": _calls_dated(reports.clean_interactions),
    "r04_daily_sessions": _calls_dated(reports.daily_sessions),
    "r05_daily_report": _calls_dated(reports.daily_report),
    "r06_weekly_report": _calls_dated(reports.weekly_report),
    "r06_monthly_report": _calls_dated(reports.monthly_report),
    "r06_quarterly_report": _calls_dated(reports.quarterly_report),
    "r06_annual_report": _calls_dated(reports.annual_report),
    "r06_period_callers": lambda t: rollups.period_callers(rollups.caller_bitmaps(t.llamadas, LOG_PERIODS)),
    "r06_period_report": _sketched_periods,
    "r07_official_beside_derived": _calls_dated(reports.official_beside_derived),
    "r08_quarter_context": _calls_dated(reports.quarter_context),
    "r09_usage_by_kind": _calls_dated(reports.usage_by_kind),
    "r09_usage_by_kind_recorded": _calls(reports.usage_by_kind_recorded),
}

TRANSFERS = {
    "t01_transfer_pairs": _calls(transfers.transfer_pairs),
    "t01_transfer_pairs_by_cells": _calls(transfers.transfer_pairs, by_cells=True),
    "t01_pair_values": _calls(transfers.pair_values),
    "t02_complete_pairs": _calls(transfers.complete_pairs),
    "t02_complete_pairs_of_quarter": _calls(transfers.complete_pairs, limit=10, trimestre="Q02_24"),
    "t03_first_of_pair": _calls(transfers.first_of_pair),
    "t04_pairs_joined_to_dates": _calls(transfers.pairs_joined_to_dates),
    "t05_pairs_by_null": _calls(transfers.pairs_by_null),
    "t06_pairs_by_quarter_totals": _calls(transfers.pairs_by_quarter_totals),
    "t07_top_pairs_per_quarter": _calls(transfers.top_pairs_per_quarter),
    "t08_appearance_dates": lambda t: transfers.appearance_dates(t.llamadas_por_trimestre, _pairs(t)),
    "t09_pair_summary": _calls(transfers.pair_summary),
    "t10_transfer_variants": _calls(transfers.transfer_variants),
    "t11_redirections": _calls(transfers.redirections),
    "t12_processing_types": _calls(transfers.processing_types),
    "t12_number_relation": _calls(transfers.number_relation),
    "t13_external_references": _calls(transfers.external_references),
    "t14_redirection_profiles": _calls(transfers.redirection_profiles),
    "t15_transfer_network": _calls(transfers.transfer_network),
    "t16_redirection_edges": _calls(transfers.redirection_edges),
    "t16_redirection_nodes": _calls(transfers.redirection_nodes),
    "t17_official_vs_derived": _calls_dated(transfers.official_vs_derived),
    "t17_official_vs_derived_by_zone": _calls(transfers.official_vs_derived_by_zone),
    "t17_derived_share_by_quarter": _calls_dated(transfers.derived_share_by_quarter),
    "t18_derived_pairs": _calls_dated(transfers.derived_pairs),
    "t18_derived_pairs_by_zone": _calls(transfers.derived_pairs_by_zone),
    "t18_suspicious_pairs": _calls_dated(transfers.suspicious_pairs, days=25),
}

LABELS = {
    "l01_exploded_labels": _calls(labels.exploded_labels),
    "l02_label_frequency": _calls(labels.label_frequency),
    "l02_label_functions": _calls(labels.label_functions),
    "l03_label_indicators": _calls(labels.label_indicators),
    "l04_menu_usage": _calls(labels.menu_usage),
    "l04_menu_abandonment": _calls(labels.menu_abandonment),
    "l05_option_usage": _calls(labels.option_usage),
    "l05_option_transfers": _calls(labels.option_transfers),
    "l06_combination_success": _calls(labels.combination_success),
    "l07_menu_label_patterns": _calls(labels.menu_label_patterns),
    "l08_option_reflection": _calls(labels.option_reflection),
    "l09_menu_option_flow": _calls(labels.menu_option_flow),
    "l10_rule_violations": _calls(labels.rule_violations),
    "l10_rule_violation_counts": _calls(labels.rule_violation_counts),
    "l11_pattern_evolution": _calls(labels.pattern_evolution),
    "l12_menu_dashboard": _calls(labels.menu_dashboard),
    "l13_combination_search": _calls(labels.combination_search, etiqueta="ZMB"),
    "l14_menu_classes": _calls(labels.menu_classes),
    "l15_option_types": _calls(labels.option_types),
    "l16_combination_profile": _calls(labels.combination_profile),
    "l17_rule_compliance": _calls(labels.rule_compliance),
    "l18_option_label_consistency": _calls(labels.option_label_consistency),
    "l19_complete_flows": _calls(labels.complete_flows),
    "l20_record_anomalies": _calls(labels.record_anomalies),
    "l21_routes": _calls(labels.routes, good=(60, 30)),
    "l22_label_validity": _calls(labels.label_validity),
    "l22_label_kinds": _calls(labels.label_kinds),
    "l23_service_levels": _calls(labels.service_levels),
    "l24_technical_codes": _calls(labels.technical_codes),
    "l24_technical_codes_custom": _calls(labels.technical_codes, codes=OTHER_CODES),
    "l25_label_segments": _calls(labels.label_segments),
    "l26_labels_and_behaviour": _calls(labels.labels_and_behaviour),
    "l27_labels_by_hour": _calls(labels.labels_by_hour),
    "l28_label_correlation": _calls(labels.label_correlation),
    "l29_option_label_dependency": _calls(labels.option_label_dependency),
    "l30_label_combinations": _calls(labels.label_combinations),
    "l30_navigation_by_relation": _calls(labels.navigation_by_relation),
    "l31_combination_usage": _calls(labels.combination_usage),
    "l31_combination_usage_repaired": _calls(labels.combination_usage_repaired),
    "l32_menu_efficiency": _calls(labels.menu_efficiency),
    "l32_menu_efficiency_by_destination": _calls(labels.menu_efficiency_by_destination),
}

JOURNEYS = {
    "j01_daily_journeys": _calls(journeys.daily_journeys),
    "j01_daily_journeys_with_destinations": _calls(journeys.daily_journeys_with_destinations),
    "j01_detailed_journeys": _calls(journeys.detailed_journeys),
    "j01_recorded_journeys": _calls(journeys.recorded_journeys),
    "j01_validated_journeys": _calls(journeys.validated_journeys),
    "j02_frequent_sequences": _calls(journeys.frequent_sequences),
    "j03_transitions": _calls(journeys.transitions),
    "j03_step_transitions": _calls(journeys.step_transitions),
    "j03_step_rows": _step_rows,
    "j04_user_patterns": _calls(journeys.user_patterns),
    "j05_user_types": _calls(journeys.user_types),
    "j06_anomalous_users": _calls(journeys.anomalous_users, volume=2),
    "j07_behaviour_clusters": _calls(journeys.behaviour_clusters),
    "j08_five_profiles": _calls(journeys.five_profiles),
    "j09_score_clusters": _calls(journeys.score_clusters),
    "j10_circadian": _calls(journeys.circadian),
    "j11_user_evolution": _calls(journeys.user_evolution),
    "j12_intensity_segments": _calls(journeys.intensity_segments),
    "j13_number_behaviour": _calls(journeys.number_behaviour),
    "j14_time_direction": _calls(journeys.time_direction),
    "j14_anomaly_list": _calls(journeys.anomaly_list),
    "j15_hourly_activity": _calls(journeys.hourly_activity),
    "j15_daily_hourly_activity": _calls(journeys.daily_hourly_activity),
    "j16_zone_behaviour": _calls(journeys.zone_behaviour),
    "j16_zone_division_area": _calls(journeys.zone_division_area),
    "j16_zone_totals": _calls_dated(journeys.zone_totals),
    "j17_division_area": _calls(journeys.division_area),
}

SERVICE = {
    "v01_abandoned_sequences": _calls(service.abandoned_sequences, min_sessions=2),
    "v02_abandonment_points": _calls(service.abandonment_points),
    "v03_resolution_time": _calls(service.resolution_time),
    "v04_frustration": _calls(service.frustration),
    "v05_weekly_kpis": _calls(service.weekly_kpis),
    "o01_hourly_load": _calls(operations.hourly_load),
    "o02_zone_efficiency": _calls(operations.zone_efficiency),
    "o03_capacity": _calls(operations.capacity),
    "o04_load_distribution": _calls(operations.load_distribution),
    "o05_bottlenecks": _calls(operations.bottlenecks),
    "o06_operating_cost": _calls(operations.operating_cost),
    "o07_daily_kpis": _calls(operations.daily_kpis),
    "d01_archetypes": _calls(digital.archetypes),
    "d02_segment_journeys": _calls(digital.segment_journeys),
    "d03_retention_cohorts": _calls(digital.retention_cohorts),
    "d04_churn_risk": _calls(digital.churn_risk, as_of=AS_OF),
    "d05_funnel": _calls(digital.funnel),
    "d06_journey_variants": _calls(digital.journey_variants, min_sessions=2),
    "d07_feature_preference": _calls(digital.feature_preference),
    "d08_weekly_ux": _calls(digital.weekly_ux),
}

FAMILIES = [SALES, EDA, CALLS, REPORTS, TRANSFERS, LABELS, JOURNEYS, SERVICE]


def _bind(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _bind(build) for family in FAMILIES for key, build in family.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in ORACLES:
        out.update(import_module(f"tabulario.oracle.{name}").SQL)
    return out
