"""Building blocks against brute force, and the shape of physical plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabulario import registry
from tabulario.plans import sessions as session_plans
from tabulario.plans.order_stats import ntile_start, order_statistics, percentile_rank
from tabulario.plans.sessions import sessions, steps
from tabulario.plans.shape import bounded_list, join_on, leading_list, matching

from conftest import SF


@pytest.fixture(params=[12, 2])
def way(request, monkeypatch):
    """Run a test with slots of thousands of ids and of a few."""
    monkeypatch.setattr(session_plans, "BLOCK_BITS", request.param)
    return request.param


def random_calls(calls_frame, n=400, seed=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.choice([rng.randrange(0, 86400), rng.randrange(36000, 36180)])
        rows.append(dict(
            # One caller holds more than half of the rows; some callers are unknown.
            numero_entrada=rng.choice(["hot"] * 6 + ["a", "b", None]), fecha=f"2024-01-0{rng.randrange(1, 4)}", hora_inicio_seg=start,
            hora_fin_seg=start + rng.randrange(-50, 200), menu=rng.choice(["M1", "M2", "M3", None]), opcion=rng.choice(["1", "2", None]),
            numero_digitado=rng.choice(["x", "y", None]),
        ))
    return calls_frame(*rows), rows


def grouped(rows):
    out = {}
    for i, r in enumerate(rows, 1):
        out.setdefault((r["numero_entrada"], r["fecha"]), []).append((r["hora_inicio_seg"], i, r))
    return {k: sorted(v, key=lambda t: t[:2]) for k, v in out.items()}


def test_sessions_match_brute_force(calls_frame, way):
    df, rows = random_calls(calls_frame)
    got = sessions(
        df, F.col("hora_inicio_seg"), step=F.concat("menu", F.lit(":"), "opcion"), sums={"s": F.col("hora_fin_seg")}, sets={"menus": F.col("menu")},
        mins={"a": F.col("hora_inicio_seg")}, maxs={"b": F.col("hora_fin_seg")}, firsts={"primero": F.col("menu")}, lists={"nums": (F.col("numero_digitado"), ",")},
    ).collect()
    want = grouped(rows)
    assert len(got) == len(want)
    for g in got:
        steps_ = want[(g.numero_entrada, str(g.fecha))]
        r = [t[2] for t in steps_]
        text = " → ".join(f"{x['menu']}:{x['opcion']}" for x in r if x["menu"] and x["opcion"])
        nums = ",".join(sorted({x["numero_digitado"] for x in r if x["numero_digitado"]}))
        assert g.n == len(r) and g.journey == (text or None) and g.nums == (nums or None)
        assert g.s == sum(x["hora_fin_seg"] for x in r) and g.menus == len({x["menu"] for x in r if x["menu"]})
        assert (g.a, g.b) == (r[0]["hora_inicio_seg"], max(x["hora_fin_seg"] for x in r))
        assert g.primero == next((x["menu"] for x in r if x["menu"]), None)


def test_steps_match_brute_force(calls_frame, way):
    df, rows = random_calls(calls_frame)
    got = {r.idRe: r for r in steps(df, F.col("hora_inicio_seg"), carry=["idRe", "menu"]).collect()}
    assert len(got) == len(rows)
    for ordered in grouped(rows).values():
        for i, (_, rid, _r) in enumerate(ordered):
            g = got[rid]
            assert (g.paso, g.pasos) == (i + 1, len(ordered))
            before = ordered[i - 1] if i else None
            assert (tuple(g.anterior) if g.anterior else None) == ((before[1], before[2]["menu"]) if before else None)


def test_transitions_are_steps_minus_sessions(calls_frame, way):
    df, rows = random_calls(calls_frame)
    moved = steps(df, F.col("hora_inicio_seg")).where(F.col("anterior").isNotNull()).count()
    assert moved == len(rows) - len(grouped(rows))


def test_a_hot_second_is_split(spark, calls_frame):
    rows = [dict(numero_entrada="hot" if i % 3 == 0 else f"c{i}", hora_inicio_seg=36000, hora_fin_seg=36001, menu="M", opcion=str(i % 7)) for i in range(3000)]
    df = calls_frame(*rows)
    slots = session_plans._slotted(df, F.col("hora_inicio_seg")).groupBy("numero_entrada", "_at", "_block").count()
    assert slots.agg(F.max("count")).first()[0] <= 2**session_plans.BLOCK_BITS
    [hot] = sessions(df, F.col("hora_inicio_seg"), step=F.col("opcion"), sep="").where("numero_entrada = 'hot'").collect()
    assert (hot.n, hot.journey) == (1000, "".join(str(i % 7) for i in range(0, 3000, 3)))
    moved = steps(df, F.col("hora_inicio_seg")).where("numero_entrada = 'hot'").orderBy("idRe").collect()
    assert [r.paso for r in moved] == list(range(1, 1001)) and [r.anterior[0] for r in moved[1:]] == [r.idRe for r in moved[:-1]]


@pytest.mark.parametrize("values", [
    [5], [3, 1, 2], [7] * 50 + [1, 2], list(range(-100, 300, 7)), [random.Random(1).randrange(10**9) for _ in range(500)],
    [0] * 300 + [10**15] + [-(10**15)], [-(2**63), 2**63 - 2, -1, 0, 1, 65535, 65536, -65536, 2**62], [v * 4096**4 for v in range(-900, 900, 7)], [random.Random(2).choice([1, 1, 1, 2, 10**12]) for _ in range(200)],
])
def test_order_statistics_match_sorting(spark, values):
    ranks = {f"p{p}": percentile_rank(p) for p in (0, 5, 25, 50, 75, 95, 100)} | {f"t{t}": ntile_start(t, 4) for t in (1, 2, 3, 4)}
    df = spark.createDataFrame([("g", v) for v in values] + [("h", v + 1) for v in values] + [("g", None)], "k string, v bigint")
    got = {r.k: r for r in order_statistics(df, ["k"], "v", ranks).collect()}
    ordered, n = sorted(values), len(values)
    for p in (0, 5, 25, 50, 75, 95, 100):
        assert got["g"][f"p{p}"] == ordered[min(n - 1, n * p // 100)]
        assert got["h"][f"p{p}"] == ordered[min(n - 1, n * p // 100)] + 1
    for t in (1, 2, 3, 4):
        assert got["g"][f"t{t}"] == ordered[min(n - 1, (t - 1) * (n // 4) + min(t - 1, n % 4))]


def test_lists_are_cut_and_ordered(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a"), (None, "a"), ("k", "z"), ("k", None), ("l", None)], "k string, v string")
    assert {r.k: r.x for r in bounded_list(df, ["k"], "v", 2, ",", "x").collect()} == {None: "a,b", "k": "z"}
    assert spark.range(1).select(leading_list(df.select("v").distinct(), "v", 2, ",")).first()[0] == "a,b"


def test_join_keeps_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, n int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, m int")
    assert {(r.k, r.n, r.m) for r in join_on(a, b, ["k"]).collect()} == {(None, 1, 10), ("x", 2, None)}


def test_matching_gives_one_row_per_rule(spark):
    rows = matching(spark.range(4), ["r"], [(F.col("id") > 1, "big"), (F.col("id") % 2 == 0, "even"), (F.lit(None).cast("boolean"), "never")], keep=["id"])
    assert sorted((r.id, r.r) for r in rows.collect()) == [(0, "even"), (2, "big"), (2, "even"), (3, "big")]


# One key per plan shape; every key is looked at with FULL_PLANS=1.
SHAPES = [
    "s02_distinct_products", "s07_org_quarter_metrics", "s23_org_matrix_with_total", "s33_category_states", "s34_category_states_by_join", "s36_category_states_by_rank",
    "e05_consistency_report", "e14_percentiles", "e20_distribution_shape", "e21_iqr_outliers", "e25_category_pareto", "e30_contingency", "e37_anomaly_scores",
    "c04_value_domains", "c06_key_checks", "c07_repeated_ids", "c13_base_dates", "c14_label_consistency", "t01_transfer_pairs", "t08_appearance_dates",
    "t15_transfer_network", "l02_label_functions", "l04_menu_usage", "l10_rule_violation_counts", "l19_complete_flows", "j01_daily_journeys", "j03_step_transitions",
    "j14_anomaly_list", "r06_quarterly_report", "r08_quarter_context", "v02_abandonment_points", "o02_zone_efficiency", "d03_retention_cohorts", "d07_feature_preference",
    "d08_weekly_ux",
]


@pytest.mark.parametrize("key", SHAPES)
def test_plan_has_no_product_and_no_python(spark, key):
    plan = registry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoop|EvalPython|MapInPandas|FlatMapGroups", plan)
    # A window without partition may only stand above an aggregate or a limited frame.
    for part in re.split(r"(?=\bWindow \[)", plan)[1:]:
        spec = re.match(r"Window \[.*?\](, \[.*?\])*", part.split("\n", 1)[0]).group(0)
        if re.search(r"windowspecdefinition\((specifiedwindowframe|[\w#]+ (ASC|DESC))", spec):
            assert "Aggregate" in part or "TakeOrdered" in part
