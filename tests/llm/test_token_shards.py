import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_shards as ts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
KINDS = "doc_id long, text string, slot string, shard int"


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        y = ts.permute(x, n)
        assert sorted(y.tolist()) == x.tolist() and ts.permute(y, n, inverse=True).tolist() == x.tolist()
    assert ts.permute(np.arange(1000), 1000, key=1).tolist() != ts.permute(np.arange(1000), 1000, key=2).tolist()
    assert (ts.permute(np.arange(1000), 1000) != np.arange(1000)).mean() > 0.95


def test_round_trip(spark, tmp_path):
    rows = [(i, f"Text {i} " * (i * 7 % 90)) for i in range(80)] + [(100, None), (None, "no id"), (101, ""), (102, "long " * 30_000), (5, "again"), (5, "again")]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(*x, "clash", 1) for x in rows], 3), KINDS)
    stream, bounds = [], [0]
    for part in df.rdd.glom().collect():
        ids = [k for r in part for k in (*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 1)]
        ids += [1] * (-len(ids) % 128)
        stream += ids
        bounds.append(len(stream))
    want = sorted(tuple(stream[k : k + 128]) for k in range(0, len(stream), 128))
    n = len(want)
    place = f"file://{tmp_path}/shards"
    got = ts.write_shards(df, place, sequence=128, span=40).collect()
    assert sorted(r.slot for r in got) == list(range(n)) and len({r.key for r in got}) == n
    assert all(r.shard == r.key // 40 for r in got) and [r.slot for r in sorted(got, key=lambda r: r.key)] == list(range(n))
    back = [tuple(x.tolist()) for x in ts.read_slots(place, 0, n + 5, sequence=128)]
    assert sorted(back) == want and back != [tuple(stream[k : k + 128]) for k in range(0, len(stream), 128)]
    for r in got:
        assert zlib.crc32(np.array(back[r.slot], "<u4").tobytes()) == r.ids_crc32
        with open(f"{tmp_path}/shards/shard-{r.shard:08d}.bin", "rb") as f:
            f.seek(r.byte_offset)
            assert np.frombuffer(f.read(256), "<u2").tolist() == list(back[r.slot])
    assert [tuple(x.tolist()) for x in ts.read_slots(place, 13, 90, sequence=128)] == back[13:103]
    assert sum(r.n_tokens for r in got) == sum(len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert not list(tmp_path.glob("shards/.writing*"))


def test_empty_table(spark, tmp_path):
    assert ts.write_shards(spark.createDataFrame([], KINDS), f"file://{tmp_path}/none").collect() == []


def test_ids_that_do_not_fit_the_width_are_an_error(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "some text of words")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        ts.write_shards(df, f"file://{tmp_path}/narrow", width=1).collect()
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / ".writing-old").write_bytes(b"x")
    assert ts.write_shards(df, f"file://{tmp_path}/wide", width=4, sequence=8).count() == 1
    assert [p.name for p in (tmp_path / "wide").iterdir() if not p.name.endswith(".crc")] == ["shard-00000000.bin"]
