"""Cases in which operators once gave less than their whole result."""

import zlib
from collections import Counter

import numpy as np
import pytest


def stored(spark, path, rows, schema, parts=2):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_warc_keys_with_control_characters(spark, tmp_path):
    from viewweave.llm.warc import archive_and_read, build_index, look_up, write_segments

    urls = ["http://b.org/x\ty", *["http://b.org/x"] * 5, "http://b.org/xa", "http://b.org/x\ny", "http://b.org/x\\y", "http://b.org/x\x00!", "http://b.org/x\x00", "http://b.org/xZ"]
    table = stored(spark, tmp_path / "p", [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = archive_and_read(table).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    assert {r.page_id: r.payload_bytes for r in got} == {i: len(f"<p>{i}</p>") for i in range(len(urls))}
    index = build_index(write_segments(table))
    lost = spark.createDataFrame([("org,b)/none", 1, 99)], "key string, row long, page long")
    with pytest.raises(Exception, match="not in the index"):
        look_up(index, lost).collect()


def test_packing_of_texts_with_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from viewweave.llm.packing import WordTokens, pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["plain words", "hello <|endoftext|> world", "<|startoftext|>a", "", "<|EndOfText|> x", "<|endoftext|>" * 3, "end <|endof", "text|> again"]
    plain = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids, count = WordTokens(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == plain
    table = stored(spark, tmp_path / "d", list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(plain))
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in pack_documents(table, path).collect()) == want


def test_neighbours_beside_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from viewweave.llm.ann import nearest

    rng = np.random.default_rng(4)
    v = rng.standard_normal(8).tolist()
    rows = [(7, v)] * 30 + [(9, v)] + [(100 + i, rng.standard_normal(8).tolist()) for i in range(20)]
    table = stored(spark, tmp_path / "v", rows, "vec_id long, embedding array<double>", 1)
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(table, F.col("vec_id").isin(7, 9)).collect()}
    assert got[7, 1] == 9 and got[9, 1] == 7
    assert len(got) == 10 and 7 not in [i for (q, _), i in got.items() if q == 7] and len({i for (q, _), i in got.items() if q == 9}) == 5


def test_quality_query_has_a_row_a_document(spark, tmp_path):
    from viewweave.llm.queries import QUERIES

    rows = [(i, (f"fine words number {i} " * 20) if i % 4 else (f"BAD!! {i} " * 30), "s", "en") for i in range(200)] + [(900, None, "s", "en")]
    stored(spark, tmp_path / "documents.parquet", rows, "doc_id long, text string, source string, lang string")
    stored(spark, tmp_path / "labels.parquet", [(i, int(i % 4 != 0), 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.keep) for r in QUERIES["op4_quality_classifier"](spark, str(tmp_path)).collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, *_ in rows)
    assert {i: keep for i, keep in got if i < 200} == {i: bool(i % 4) for i in range(200)}


def test_stages_keep_the_right_documents(spark, tmp_path):
    from viewweave.llm.dedup import cut_texts
    from viewweave.llm.jaccard import keep_one

    words = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    rows = [(1, words[0]), (2, words[1]), (3, words[0]), (4, words[2]), (5, words[1] + " more"), (6, words[3])]
    table = stored(spark, tmp_path / "d", rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in keep_one(table, shingle=5, num=8, den=10).collect()} == {rows[k] for k in (0, 1, 3, 5)}
    tail = [(1, words[0]), (2, "own " + words[0] + " end"), (3, words[2]), (4, words[2])]
    cut = stored(spark, tmp_path / "c", tail, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in cut_texts(cut).collect()} == {(1, words[0]), (2, "own  end"), (3, words[2])}
