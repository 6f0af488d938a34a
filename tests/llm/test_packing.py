import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm.packing import Packing, UnitIds, cut, pack
from barlake.llm.q_packing import PARAMS, op10_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def library(texts):
    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


def check(rows, docs, capacity=2048):
    """rows: (doc, start, length, crc, doc_tokens, sequence, offset); docs: id -> token ids."""
    by_doc, by_seq = {}, {}
    for d, start, n, crc, total, seq, at in rows:
        ids = np.array(docs[d][start:start + n], "<u4")
        assert len(ids) == n and zlib.crc32(ids.tobytes()) == crc and total == len(docs[d])
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault(seq, []).append((at, n))
    for d, ids in docs.items():
        end = 0
        for start, n in sorted(by_doc[d]):
            assert start == end and n > 0
            end += n
        assert end == len(ids)
    for held in by_seq.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= capacity
    return len(by_seq)


def test_op10_round_trip_and_padding(spark):
    raw = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = dict(zip([i for i, _ in raw], library([t or "" for _, t in raw])))
    got = [tuple(r) for r in op10_packing(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    sequences = check(got, docs)
    tokens = sum(map(len, docs.values()))
    assert 1 - tokens / (2048 * sequences) < 0.015


def test_several_rounds_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "long text " * 30_000), (5, "  \n x")] + [(i, "w " * (i * 7)) for i in range(6, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9).withColumn("start", F.lit("clash"))
    out = pack(df, PATH, params=Packing(fan_in=3)).collect()
    docs = dict(zip([i for i, _ in rows], library([t or "" for _, t in rows])))
    check([(r.doc_id, r.start, len(r.input_ids), zlib.crc32(np.array(r.input_ids, "<u4").tobytes()), r.doc_tokens, r.sequence_id, r.seq_offset) for r in out], docs)
    assert pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (1, "x"), (1, "x")], "doc_id bigint, text string")
    assert pack(twice, PATH).count() == 4


def test_cut_and_memory_of_units():
    for n in range(1, 9000):
        parts = cut(n, PARAMS)
        assert sum(parts) == n and len(parts) <= n // 2048 + 6
    texts = ["some text, here", "é 日本 🙂 a\x85b", "", "   "] * 3 + [f"word{i} other{i}" for i in range(200)]
    units = UnitIds(PATH, limit=50)
    assert [units.encode([t], 1)[0].tolist() for t in texts] == library(texts)
    texts += ["a <|endoftext|> b", "", "<|endoftext|>"]
    flat, stops = units.encode(texts, 1)
    assert [x.tolist() for x in np.split(flat, stops[:-1])] == library(texts)


def test_units_that_come_again_are_learnt_once():
    units, learnt = UnitIds(PATH, limit=100), []
    encoded = units._encoded
    units._encoded = lambda new: learnt.extend(new) or encoded(new)
    texts = [f" often again{'' if i % 2 else '!'} " + " ".join(f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)) for i in range(60)]
    for text, want in zip(texts, library(texts)):
        flat, stops = units.encode([text], 1)
        assert flat.tolist() == want and stops.tolist() == [len(want)]
    assert learnt.count(" often") == learnt.count(" again") == 1 and len(units) < 130
    units.again[:] = True  # too many to keep: begun anew
    assert units.encode([" ".join(texts)], 1)[0].tolist() == library([" ".join(texts)])[0]
    assert units.encode([texts[3]], 1)[0].tolist() == library([texts[3]])[0]


def test_a_batch_is_cut_at_once_and_looks_each_unit_up_once():
    class Counted(UnitIds):
        looked_up = 0

        def __getitem__(self, unit):
            self.looked_up += 1
            return super().__getitem__(unit)

    units = Counted(PATH)
    assert np.split(units.encode([" same words." * 500, " same words."], 1)[0], [1500])[0].tolist() == library([" same words." * 500])[0][:-1]
    assert units.looked_up == 3
    rng, units = random.Random(4), UnitIds(PATH, limit=2000)
    parts = [*" \n\t\x0b\x85\xa0     　\x1c.,;:!?'-aZÀ×ß÷ÿ", "'s", "it's", " word", "  ", "é", "日本", "ま。", "’", "12", "🙂", "<|endoftext|>"]
    for _ in range(200):
        texts = ["", *("".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(20))]
        column = pa.array(["cut off", *texts], rng.choice([pa.string(), pa.large_string()])).slice(1)
        flat, stops = units.encode(column, 1)
        assert [x.tolist() for x in np.split(flat, stops[:-1])] == library(texts)
