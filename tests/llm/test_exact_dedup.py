import hashlib
import random

from tessera.llm import exact_dedup as ed

KINDS = "doc_id long, text string, lang string, recipe string"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé ñ\n") for _ in range(r.randrange(1, 9)))
    long = " ".join(word() for _ in range(20_000))
    texts = ["", None, "a", "A", "a ", long, long + "x", "y" + long] + [" ".join(word() for _ in range(r.randrange(400))) for _ in range(20)]
    rows = [(i, r.choice(texts)) for i in range(150)] + [(7, texts[5]), (7, texts[5]), (None, texts[5]), (None, None), (None, "only null"), (None, "only null"), (9, "nine"), (9, "neuf")]
    return [(d, t, "en", "clash") for d, t in rows]


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        kept = False
        for d in ids:
            mine = d == keep and not kept
            kept |= mine
            out.append((d, keep, len(ids), mine, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    assert rows_of(ed.exact_groups(spark.createDataFrame(rows, KINDS).repartition(3))) == brute(rows)


def test_identifier_shared_by_two_chunks_is_never_trusted(spark):
    rows = corpus()
    weak = lambda chunk: bytes([len(chunk) % 3])
    df = spark.createDataFrame(rows, KINDS)
    assert rows_of(ed.exact_groups(df, (weak, ed._sha))) == brute(rows)
    assert rows_of(ed.exact_groups(df, (weak, weak, ed._itself))) == brute(rows)


def test_chunks_join_to_the_text_and_follow_content():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(200_000))
    parts = ed.chunks_of(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= ed.MAX_BYTES
    moved = ed.chunks_of(b"some words before " + data)
    assert len(set(parts) & set(moved)) > 0.8 * len(parts)
    assert ed.chunks_of(b"") == []


def test_drop_copies_keeps_columns_and_one_row(spark):
    rows = corpus()
    got = ed.drop_copies(spark.createDataFrame(rows, KINDS).repartition(4))
    assert got.columns == ["doc_id", "text", "lang", "recipe"]
    want = sorted(((d, t) for d, _, _, kept, t in brute(rows) if kept), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=repr) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    assert ed.exact_groups(df).collect() == [] and ed.drop_copies(df).collect() == []
