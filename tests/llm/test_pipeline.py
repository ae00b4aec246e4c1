"""The pipeline's stages against plain versions, each on its own input."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm import test_ngram_join, test_substring
from llm.tables import SF
from tabulario.llm import toxicity
from tabulario.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each one."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append(work.keep(stage(spark, held[-1], SF), f"s{k}"))
    return [(df.columns, df.collect()) for df in held]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert all(columns == COLUMNS for columns, _ in stages[:-1])


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.toxicity(docs, model).where("predicted = 1").collect()}
    assert sorted(map(tuple, stages[1][1])) == sorted(tuple(r) for r in stages[0][1] if r.doc_id not in bad)


def test_copies_go(stages):
    last = {}
    for r in sorted(stages[1][1], key=lambda r: r.doc_id):
        last[r.text] = tuple(r)
    assert sorted(map(tuple, stages[2][1])) == sorted(last.values())


def test_near_copies_go(stages, monkeypatch):
    def fives(text):
        words = test_ngram_join.WORD.findall((text or "").translate(test_ngram_join.LOWER))
        if len(words) < 5:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows = stages[2][1]
    sets = [fives(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(map(tuple, stages[3][1])) == sorted(tuple(r) for r in rows if r.doc_id in set(least.values()))


def test_repeats_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[3][1]]
    want = {i: (gone, kept) for i, _, gone, _, kept in test_substring.brute(rows)}
    before = {r.doc_id: r for r in stages[3][1]}
    assert len(stages[4][1]) == len(rows)
    for r in stages[4][1]:
        gone, kept = want[r.doc_id]
        assert r.text == (kept if gone else before[r.doc_id].text)
        assert r.n_chars == (len(r.text) if gone else before[r.doc_id].n_chars)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)


def test_everything_left_is_packed(stages):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4][1]}
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in stages[5][1]:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, stages):
    assert sorted(r.ids_crc32 for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.ids_crc32 for r in stages[-1][1])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
