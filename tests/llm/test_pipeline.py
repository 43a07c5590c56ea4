"""The corpus pipeline's stages and its whole run against plain Python, on a small table."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.test_llm import classes, sequential_budgets, stored, words


def plain_cut(rows):
    """Texts without the bytes that a 50-byte string of a smaller id covers, judged on the input; rows of white space alone go if cut."""
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or kept.strip():
            out[i] = kept
    return out


def plain_mix(rows, weights, fraction):
    """Ids that each leaf (domain, lang, source) gives, one epoch at most; rows are (id, text, lang, source)."""
    leaves = defaultdict(list)
    for i, t, la, s in rows:
        digits = "".join(c for c in (s or "")[::-1] if c.isdigit())  # sources end in one digit here
        leaves[f"d{int(digits[0]) % 4 if digits else 0}", la, s].append((i, len(words(t))))
    supply = {k: sum(n for _, n in own) for k, own in leaves.items()}
    caps = {k: float(s) for k, s in supply.items()}
    out = set()
    for k, b in sequential_budgets(caps, lambda k: weights.get("/".join(x or "null" for x in k), 1.0), sum(supply.values()) * fraction).items():
        if b >= supply[k] - 1e-6:
            out.update(i for i, _ in leaves[k])
            continue
        left = int(b + 1e-6)
        for i, n in sorted(leaves[k], key=lambda r: hashlib.md5(f"17:0:{r[0]}".encode()).hexdigest()):
            left -= n
            if left < 0:
                break
            out.add(i)
    return out


def test_pipeline_stage_by_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from viewweave.llm.queries import MIX_WEIGHTS, tokenizer_path

    rng = random.Random(11)
    good = "river stone cloud maple winter garden lantern harbour meadow copper violet orchard".split()
    passage = " ".join(rng.choice(good) + str(k) for k in range(70))
    rows, marks = [], []
    for i in range(160):
        if i % 5 == 0:
            text = " ".join(rng.choice(("BUY!!", "###", "click$$", "win@@")) for _ in range(60)) + f" {i}"
        else:
            text = " ".join(rng.choice(good) + str(rng.randrange(40)) for _ in range(rng.randrange(40, 120)))
        rows.append([i, text, ("en", "de")[i % 2], f"src{i % 6}"])
        if i < 140:
            marks.append((i, int(i % 5 != 0), 0))
    for i, of in ((200, 1), (201, 1), (202, 2)):
        rows.append([i, rows[of][1] + (" tail" if i == 201 else ""), "en", "src1"])
    rows += [[210 + k, " ".join(rng.choice(good) + str(100 + rng.randrange(40)) for _ in range(60)) + f" {passage} end{k}", "en", f"src{k}"] for k in range(4)]
    rows += [[220, None, "en", "src2"], [221, "", None, None]]
    rows = [[*r, len(r[1] or "")] for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    at = str(tmp_path)
    docs = stored(spark, os.path.join(at, "documents.parquet"), rows, schema, 3)
    stored(spark, os.path.join(at, "labels.parquet"), marks, "doc_id long, quality int, toxic int")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]
    texts = {}
    for name in list(stages)[:4]:
        before = [tuple(r) for r in docs.collect()]
        out = stages[name](spark, docs, at)
        assert out.columns == docs.columns
        out.write.parquet(os.path.join(at, name))
        docs = spark.read.schema(out.schema).parquet(os.path.join(at, name))
        after = [tuple(r) for r in docs.collect()]
        texts = {r[0]: r[1] for r in after}
        pairs = [(r[0], r[1]) for r in before]
        if name == "quality":
            assert {r[0] for r in before if r[0] < 160 and r[0] % 5} <= set(texts) and not {i for i in texts if i < 160 and i % 5 == 0}
            assert set(after) <= set(before)
        elif name == "near_duplicates":
            keep = {c for _, _, c in classes(pairs, 5, 8, 10)}
            assert Counter(after) == Counter(r for r in before if r[0] in keep) and not {200, 201, 202} & set(texts)
        elif name == "repeated_passages":
            want = plain_cut(pairs)
            assert {i: t or "" for i, t in texts.items()} == want and all(passage not in want[210 + k] for k in range(1, 4)) and passage in want[210]
            assert {r[0]: r[4] for r in after} == {i: len(t) for i, t in want.items()}
        else:
            want = plain_mix([r[:4] for r in before], MIX_WEIGHTS, 0.9)
            assert set(texts) == want and set(after) <= set(before)
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            want[i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())] += 1
    for packed in (stages["packing"](spark, docs, at).collect(), corpus_pipeline.run(spark, at).collect()):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
        bins = defaultdict(list)
        for r in packed:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert len(bins) <= sum(r.length for r in packed) // 2048 + 2
