import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulario.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tabulario.sources.fixtures import Tables

    return Tables(spark, SF)


CALL_DEFAULTS = dict(
    idRe=1, numero_entrada="5550000000", numero_digitado="5550000000", menu="SDO", opcion="1", id_CTransferencia=None, cIdentifica=None,
    nidMQ=None, fecha="2024-01-02", hora_inicio_seg=36000, hora_fin_seg=36060, id_8T="Z1", division="NORTE", area="A", etiquetas=None, trimestre="Q01_24",
)


@pytest.fixture(scope="session")
def calls_frame(spark):
    """Builds a call log from partial rows."""
    from pyspark.sql import functions as F

    ddl = ("idRe bigint, numero_entrada string, numero_digitado string, menu string, opcion string, id_CTransferencia string, cIdentifica string, "
           "nidMQ string, fecha string, hora_inicio_seg int, hora_fin_seg int, id_8T string, division string, area string, etiquetas string, trimestre string")

    def build(*rows):
        full = [tuple({**CALL_DEFAULTS, "idRe": i, **row}.values()) for i, row in enumerate(rows, 1)]
        return spark.createDataFrame(full, ddl).withColumn("fecha", F.to_date("fecha"))

    return build
