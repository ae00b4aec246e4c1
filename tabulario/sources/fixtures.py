"""The three families derived from the shared star-schema test tables (FIXTURES.md)."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.sources.periods import Period, Periods
from tabulario.sources.schemas import LLAMADAS, PRODUCTOS, VENTAS, conform

SALES_PERIODS = Periods.of(
    ("Q01_95", "1995-01-01", "1995-03-31"),
    ("Q02_95", "1995-04-01", "1995-06-30"),
    ("Q03_95", "1995-07-01", "1995-09-30"),
)


def quarters(first: int, last: int) -> Periods:
    """The quarters of the years from `first` to `last`."""
    return Periods.of(*[
        (f"Q0{q}_{year % 100:02d}", f"{year}-{3 * q - 2:02d}-01", f"{year}-{3 * q:02d}-{31 if q in (1, 4) else 30}") for year in range(first, last + 1) for q in range(1, 5)
    ])


# A calendar that begins before the sales table does, and one of every quarter that it has.
SALES_CALENDAR, SALES_WHOLE = quarters(1992, 2001), quarters(1995, 2001)
# A calendar too long for an expression: ten thousand days.
SALES_DAYS = Periods([Period(d.isoformat(), d, d) for d in (dt.date(1992, 1, 1) + dt.timedelta(days=i) for i in range(10_000))])
LOG_PERIODS = Periods.of(
    ("Q01_24", "2024-01-01", "2024-01-10"),
    ("Q02_24", "2024-01-11", "2024-01-20"),
    ("Q03_24", "2024-01-21", "2024-01-30"),
)

# Columns read from the driver tables; a given schema spares the job that infers it.
_TABLES = {
    "lineitem": "l_partkey bigint, l_returnflag string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_SECOND_OF_DAY = "hour(ts) * 3600 + minute(ts) * 60 + cast(second(ts) as int)"


class Tables:
    """Lazily derived inputs of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ventas(self) -> DataFrame:
        lineitem = self._read("lineitem").selectExpr(
            "l_partkey", "cast(l_shipdate as date) as fechaTabla",
            "case l_returnflag when 'A' then 123 when 'R' then 369 else 999 end as cIDR",
        )
        part = self._read("part").selectExpr(
            "p_partkey",
            "case p_size % 10 when 0 then '' when 7 then 'sin categoria' when 3 then null when 5 then '  ' "
            "else concat(p_brand, '-', cast(p_size as string)) end as categoria",
        )
        joined = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        return conform(joined.withColumn("producto_id", F.col("l_partkey").cast("string")), VENTAS)

    @cached_property
    def _events(self) -> DataFrame:
        return self._read("events").withColumn("k", F.expr("cast(regexp_extract(props, '[0-9]+', 0) as int)"))

    @cached_property
    def productos(self) -> DataFrame:
        return conform(self._events.selectExpr(
            "case when k % 25 = 0 then null when k % 25 = 1 then -1 else cast(floor(value * 150000) as bigint) end as cProducto",
            "user_id as cIDT",
            "case k % 20 when 0 then null when 1 then '' when 2 then ' ' when 3 then 'N/A' else event_type end as cCategoria",
            "case when k % 30 = 0 then null else k % 2 end as cSeleccion",
            "case when k % 30 = 1 then null when k % 6 = 5 then 0 when k % 6 = 4 then 1 else k % 2 end as cIOT",
            "ts as cFecha",
            f"{_SECOND_OF_DAY} as cHInicio_seg",
            f"{_SECOND_OF_DAY} + (case when k % 9 = 0 then -1 else 1 end) * cast(floor(value * 20) as int) as cHFin_seg",
        ), PRODUCTOS)

    @cached_property
    def productos_por_trimestre(self) -> DataFrame:
        """Rows tagged with the quarterly table they would sit in."""
        return LOG_PERIODS.tag(self.productos, "cFecha", inclusive_end=True)

    @cached_property
    def llamadas(self) -> DataFrame:
        return conform(self._events.selectExpr(
            "event_id as idRe",
            "case when k = 99 then null else cast(2185000000 + user_id as string) end as numero_entrada",
            "case when k % 10 = 0 then null when k % 10 <= 3 then cast(2185000000 + user_id + k % 7 - 3 as string) "
            "else cast(2185000000 + user_id as string) end as numero_digitado",
            "case event_type when 'click' then if(k % 2 = 0, 'RES-SP_2024', 'RES-ContratacionIfm_2024') "
            "when 'view' then (case k % 4 when 0 then 'SDO' when 1 then 'DASHBOARD' when 2 then 'SELECCION' else 'PROCESO' end) "
            "when 'purchase' then if(k % 3 = 0, 'comercial_11', 'comercial_5') "
            "when 'error' then (case k % 3 when 0 then 'cte_colgo' when 1 then 'SinOpcion_Cbc' else 'Desborde_Cabecera' end) "
            "else (case when k % 5 = 0 then null when k % 2 = 0 then 'CONFIRMACION' else 'INICIO' end) end as menu",
            "case k % 7 when 0 then '' when 1 then 'DEFAULT' when 2 then '2L' when 3 then 'TELCO' when 4 then '5' "
            "when 5 then null else 'NoTmx_SOMC' end as opcion",
            "case when k % 6 = 0 then cast(9000 + k % 4 as string) when k % 6 = 1 then '' else null end as id_CTransferencia",
            "case when k % 4 = 0 then '' when k % 4 = 1 then 'X12' else cast(380000000000 + event_id as string) end as cIdentifica",
            "case when k % 8 = 0 then null else concat('MQ', cast(2185000000 + user_id as string)) end as nidMQ",
            "cast(ts as date) as fecha",
            f"{_SECOND_OF_DAY} as hora_inicio_seg",
            f"{_SECOND_OF_DAY} + (case when k % 9 = 0 then -1 else 1 end) * cast(floor(value) as int) as hora_fin_seg",
            "concat('Z', cast(user_id % 8 as string)) as id_8T",
            "case user_id % 3 when 0 then 'NORTE' when 1 then 'SUR' else 'CENTRO' end as division",
            "concat('AREA_', cast(user_id % 7 as string)) as area",
            "case when k % 5 = 0 then '' when k % 5 = 1 then null "
            "when event_type = 'click' then if(k % 7 = 2, '2L,ZMB,VSI,NVS,', '1L,ZMB,NOBOT,VSI,') "
            "when event_type = 'error' then if(k % 7 = 6, 'NoTmx_SOMC,NoTmx_SOMC,', '') "
            "when k % 7 = 3 then 'ZMB,WTS,TELCO,,' else 'ZMB,MGC' end as etiquetas",
        ), LLAMADAS)

    @cached_property
    def llamadas_por_trimestre(self) -> DataFrame:
        return LOG_PERIODS.tag(self.llamadas, "fecha")

    @cached_property
    def llamadas_crudas(self) -> DataFrame:
        """Text form of the log with broken dates, odd numbers, repeated ids and rows in a wrong table."""
        day = F.expr("date_sub(cast(ts as date), case when k = 22 then 10 else 0 end)")
        texts = self._events.withColumns({
            "trimestre": F.coalesce(LOG_PERIODS.label_of(day), F.lit(LOG_PERIODS[0].trimestre)),
            "fin": F.expr("timestampadd(SECOND, (case when k % 9 = 0 then -1 else 1 end) * cast(floor(value) as int), ts)"),
        }).selectExpr(
            "trimestre", "case when k % 50 = 21 then event_id % 1000 else event_id end as idRe",
            "case k when 99 then null when 98 then '0000000' when 97 then '123' when 96 then 'ABC123' when 95 then '' "
            "else cast(2185000000 + user_id as string) end as numero_entrada",
            "case when k % 10 = 0 then null when k = 11 then '' when k = 12 then '12' when k = 13 then '12-34-56' "
            "else cast(2185000000 + user_id + k % 7 - 3 as string) end as numero_digitado",
            "case k % 12 when 0 then null when 1 then '' when 2 then 'cte_colgo' when 3 then 'SDO' else event_type end as menu",
            "case when k % 7 = 0 then '' else cast(k % 7 as string) end as opcion",
            "case k % 6 when 0 then cast(9000 + k % 4 as string) when 1 then '' when 2 then 'EXT-1' else null end as id_CTransferencia",
            "case k when 13 then '31/02/2024' when 14 then 'sin fecha' when 15 then '01/01/2031' "
            "else date_format(cast(ts as date), 'dd/MM/yyyy') end as fecha",
            "case user_id % 3 when 0 then 'NORTE' when 1 then 'SUR' else 'CENTRO' end as division",
            "concat('AREA_', cast(user_id % 7 as string)) as area",
            "concat(case when k % 50 = 17 then date_format(cast(ts as date), 'dd/MM/yyyy') else '01/01/1900' end, substring(cast(ts as string), 11, 9)) as hora_inicio",
            "concat('01/01/1900', substring(cast(fin as string), 11, 9)) as hora_fin",
            "concat('Z', cast(user_id % 8 as string)) as id_8T",
            "case when k % 5 = 0 then '' when k % 5 = 1 then null else 'ZMB,MGC' end as etiquetas",
            "case k % 4 when 0 then '' when 1 then 'X12' else cast(380000000000 + event_id as string) end as cIdentifica",
            "concat(date_format(date_add(cast(ts as date), if(k % 10 = 3, 1, 0)), 'dd/MM/yyyy'), ' 23:59:59') as fecha_inserta",
            "case when k % 8 = 0 then null else concat('MQ', cast(2185000000 + user_id as string)) end as nidMQ",
        )
        return texts
