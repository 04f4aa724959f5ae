import os

import pyarrow as pa
import public_tokenizers
import pytest

from faircart.llm import common, packing, toxicity


def test_memory_is_given_back_behind_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))

    def run(batches):
        held = [b * 2 for b in batches]
        for x in held:
            told.append(x)
            yield x

    assert list(common.trimmed(run)(iter([1, 2]))) == [2, 4] and told == [2, 4, "back"]


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_freed_memory_leaves_the_process():
    held = [bytearray(2000) for _ in range(100_000)]
    last = bytearray(2000)  # stands behind the others, so that the C library keeps what is before it
    full = resident()
    del held
    common.give_back()
    assert full - resident() > 100_000_000 and last is not None


def test_packing_keeps_no_words_in_workers(spark):
    rows = [(d, " ".join(f"word{d}x{i}" for i in range(50))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    packing.pieces(docs, str(public_tokenizers.path(packing.TOKENIZER))).collect()

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e) + len(e.cores) for e in packing._WORKER.values())])], names=["n"])

    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(run, "n long").where("n > 0").collect()] == []


def test_labels_reach_executors_without_python_rows(spark, monkeypatch):
    rows = [(d, "vile wretched scum" if d % 3 == 0 else f"a calm note number {d}") for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows], "doc_id long, toxic int")
    made, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(type(data)) or make(self, data, *a, **b))
    toxicity.train(docs, labels)
    assert made == [pa.Table]


def test_one_cache_of_words_gives_each_word_its_own_value():
    kernel = toxicity.Kernel(["scum", "wretched"])
    texts = ["scum! scum, SCUM", "...scum_ ??? wretched" + "x" * 40 + ".", "", "wretched wretched? s c u m"]
    held = toxicity.Sentences(kernel)
    for _ in range(2):
        for got, want in zip(held(texts), toxicity.Sentences(kernel)(texts), strict=True):
            assert (got == want).all()
    assert not hasattr(held, "bare")
    alone = [toxicity.Sentences(kernel)([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(held(texts)[0], [row for part in alone for row in part], strict=True))
