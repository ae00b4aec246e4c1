import numpy as np
import pyarrow as pa

from tabulario.llm import ngram_join
from tabulario.llm.memory import giving_back
from tabulario.llm.ship import send_package


def test_workers_do_not_stay_as_large_as_their_largest_task(spark):
    def own_mb(batches):
        with open("/proc/self/smaps_rollup") as lines:
            mb = sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"mb": [mb]})

    def large(batches):
        rng = np.random.default_rng(1)
        for _ in batches:
            held = [pa.array(rng.random(20_000).tolist()) for _ in range(1000)]
            yield pa.RecordBatch.from_pydict({"mb": [float(len(held))]})

    send_package(spark)
    one = spark.range(0, 1, 1, 1)
    before = one.mapInArrow(own_mb, "mb double").first().mb
    assert [r.mb for r in one.mapInArrow(giving_back(large), "mb double").collect()] == [1000]
    after = one.mapInArrow(own_mb, "mb double").first().mb
    assert after < before + 60, (before, after)


def test_steps_of_the_join_give_back(monkeypatch):
    """Rounds over batches and over groups end by giving back."""
    calls = []
    monkeypatch.setattr("tabulario.llm.memory.give_back", lambda: calls.append(1))
    assert list(giving_back(ngram_join._answered)(iter([]))) == [] and calls == [1]
    empty = pa.table({"keys": pa.array([], pa.binary())})
    assert ngram_join._members(80)(empty, empty).num_rows == 0 and calls == [1, 1]
