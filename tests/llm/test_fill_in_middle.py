import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fm

KINDS = "doc_id long, text string, form string, n int, _u string"


def plan(doc_id, n):
    g = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    return sorted((h[0] % (n + 1), h[1] % (n + 1))), h[2] % 100, h[3] % 100


def brute(doc_id, text):
    t = text or ""
    (a, b), rate, order = plan("null" if doc_id is None else doc_id, len(t))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or rate >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    p, m, s = t[:a], t[a:b], t[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if order < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(t), "spm" if order < 20 else "psm", len(p), len(m), sha(out), sha(t)


def corpus():
    r = random.Random(2)
    texts = ["", None, "a", "\n", "😀", "é́x", "a😀b\r\n\x0b\x85  z", "see <P> here", "<S", "S>", "<<", "P><M", "x<M>", "<p>", "0" * 300_000 + "😀"]
    texts += ["".join(r.choice("ab <>PSM\n😀é") for _ in range(r.randrange(60))) for _ in range(300)]
    return [(i, t, "clash", 1, "u") for i, t in enumerate(texts)] + [(5, "five", "x", None, None), (5, "five", "x", None, None), (None, "no id", "x", 2, "u")]


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in fm.digests(spark.createDataFrame(rows, KINDS).repartition(3)).collect()), key=repr)
    assert got == sorted((brute(d, t) for d, t, *_ in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    df = fm.digests(spark.createDataFrame([], KINDS))
    assert df.collect() == [] and df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("unit", sorted(fm.UNITS))
def test_units_join_to_the_text_and_restore(spark, unit):
    df = spark.createDataFrame(corpus(), KINDS)
    text = F.coalesce("text", F.lit(""))
    for r in df.select(text.alias("t"), fm.units_of(text, unit).alias("u")).collect():
        assert "".join(r.u) == r.t and all(r.u)
    out = fm.rearrange(df, unit)
    assert out.where(~F.col("text").eqNullSafe(fm.restore(F.col("output"), F.col("form")))).count() == 0


@pytest.mark.parametrize(
    "unit, text, units",
    [
        ("char", "a😀\n", ["a", "😀", "\n"]),
        ("word", " ab  c\n\nd", [" ", "ab  ", "c\n\n", "d"]),
        ("line", "a\n\nb", ["a\n", "\n", "b"]),
        ("sentence", "A. B c! D", ["A. ", "B c! ", "D"]),
        ("run", "ab1, c", ["ab1", ", ", "c"]),
        ("word", "", []),
    ],
)
def test_unit_grammars(spark, unit, text, units):
    assert spark.createDataFrame([(text,)], "t string").select(fm.units_of(F.col("t"), unit)).first()[0] == units


def test_other_sentinels_and_rates(spark):
    df = spark.createDataFrame([(i, f"text <P> number {i}.") for i in range(40)], "doc_id long, text string")
    out = fm.rearrange(df, percent=100, spm_percent=100, sentinels=("(p)", "[s", "m*")).collect()
    assert {r.form for r in out} == {"spm"} and all(r.output == f"[s{r.suffix}(p){r.prefix}m*{r.middle}" for r in out)
