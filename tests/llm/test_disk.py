"""What the stages before and within near_duplicates leave or send to disk."""

import os
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import classes, stored


@pytest.fixture
def shared_bytes(spark):
    """Bytes in the shared folder since the test began."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    total = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = total()
    return lambda: total() - before


def noise(rng, n):
    return "".join(rng.choice(string.ascii_letters + "  ") for _ in range(n))


def test_quality_leaves_no_texts(spark, tmp_path, shared_bytes):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, noise(rng, 20_000), "en", f"s{i % 3}", 20_000) for i in range(60)]
    docs = stored(spark, tmp_path / "d", rows, "doc_id long, text string, lang string, source string, n_chars long")
    stored(spark, tmp_path / "labels.parquet", [(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == set(rows)
    assert shared_bytes() < 200_000


def test_run_keeps_one_predecessor(spark, tmp_path, monkeypatch, shared_bytes):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, noise(rng, 20_000)) for i in range(30)]
    stored(spark, tmp_path / "documents.parquet", rows, "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda spark, docs, sf_dir: docs) for k in range(5)])
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(rows)
    assert 400_000 < shared_bytes() < 900_000  # one table of 600 kB


def test_copies_give_signatures_once(spark, tmp_path, monkeypatch):
    """Copies in many blocks are in no group; near copies are, and all classes are right."""
    import viewweave.llm.jaccard as jaccard
    from viewweave.llm.common import store_blocks

    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(6)]
    rows = [(100 * c + i, t) for c in range(12) for i, t in enumerate(base)]
    met = []

    def counted(df, keep=jaccard.materialise):
        out = keep(df)
        if out.columns == ["gid", "uid"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    for name, more, some in (("c", [], False), ("n", [(5000, base[0] + " tail"), (5001, base[0] + " tail"), (5002, base[1] + " end")], True)):
        table = stored(spark, tmp_path / name, rows + more, "doc_id long, text string", 4)
        blocks = store_blocks(table, "doc_id", "text", block_bytes=2000)
        assert blocks.count() > 20
        met.clear()
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(blocks, 5, 8, 10).collect())
        assert got == classes(rows + more, 5, 8, 10)
        assert bool(sum(met)) == some


@pytest.mark.parametrize("turns", [2, 4])
def test_ranges_of_signatures(turns, spark, tmp_path):
    """The ranges together hold each signature of the rows that are no copies, in its bucket, and each range a share of them."""
    import viewweave.llm.jaccard as jaccard
    from viewweave.llm.common import store_blocks, undelta, unpack

    rng = random.Random(4)
    table = stored(spark, tmp_path / "d", [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)] + [(50, None), (51, "")], "doc_id long, text string", 1)
    block = store_blocks(table, "doc_id", "text").first()
    batch = lambda gone: pa.RecordBatch.from_arrays([pa.array([block.block]), pa.array([bytes(block.data)]), pa.array([gone], pa.list_(pa.int32()))], names=["block", "data", "rows"])

    def signed(gone, *turn):
        out = Counter()
        for found in jaccard._sign(5, 8, 10, 6, *turn)([batch(gone)]):
            for bucket, data in zip(found["part"].to_pylist(), found["data"].to_pylist()):
                keys, own = undelta((both := unpack(data))[0]), both[1]
                assert set((keys >> np.uint64(58)).tolist()) == {bucket}
                out.update(zip(keys.tolist(), own.tolist()))
        return out

    whole = signed(None)
    shares = [signed(None, turn, turns) for turn in range(turns)]
    assert sum(shares, Counter()) == whole and max(x.total() for x in shares) < 1.5 * whole.total() / turns
    assert signed([3, 4]) == Counter({k: n for k, n in whole.items() if k[1] not in (3, 4)})
