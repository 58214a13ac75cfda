"""Fill-in-the-middle: documents cut at unit boundaries into prefix, middle and suffix, and written in another order.

A unit grammar is a list of rules (classes before a boundary, class after it).
boundary() translates it to one zero-width regex of neighbouring classes, a
lookbehind and a lookahead a rule; Spark's split at that regex keeps every code
point, so the units joined are the text. (Java's classes and boundaries go by
code points: a surrogate pair is never cut.) An empty text is one empty piece
for split and no unit here, which is handled apart.

Where the cuts lie and which form a document takes comes from the SHA-256 of
`seed:doc_id` alone, so it does not depend on how the table is partitioned.
Everything is column expressions on one row: no shuffle, no state.

Defined cases: a null text is an empty one; an empty text, and one that holds a
sentinel, stays plain. A null doc_id counts as the text "null". Repeated rows
come out alike. Very long texts are cut as a whole; their units are in memory
while their row is worked on. Other columns are not read, whatever their names.
No rows in: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Classes are written as what stands between the brackets of a regex class.
ANY, SPACE, BLACK, NEWLINE, STOP, LETTER = r"\s\S", r" \t\n\x0B\f\r", r"^ \t\n\x0B\f\r", r"\n", r".!?", r"\p{L}\p{N}"
#: unit -> rules; a rule is (classes of the code points before a boundary, in order; class of the one after it)
UNITS = {
    "char": [((ANY,), ANY)],
    "word": [((SPACE,), BLACK)],  # with the white space after it
    "line": [((NEWLINE,), ANY)],  # with its line break
    "sentence": [((STOP, SPACE), BLACK)],
    "run": [((LETTER,), "^" + LETTER), ((f"^{LETTER}",), LETTER)],  # letters and digits, or anything else
}
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(unit: str) -> str:
    """The zero-width regex of a unit's boundaries."""
    return "|".join(f"(?<={''.join(f'[{c}]' for c in left)})(?=[{right}])" for left, right in UNITS[unit])


def units_of(text: Column, unit: str = "char") -> Column:
    """The units of a text in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def _quoted(s: str) -> str:
    return "".join(rf"\x{{{ord(c):x}}}" for c in s)


def rearrange(docs: DataFrame, unit: str = "char", seed: str = "1", percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output of each document.

    h1 to h4 are the first four groups of 8 hex digits of sha256(seed:doc_id). The
    prefix has min(h1, h2) mod (n + 1) units, the middle ends after the larger of
    both; `percent` of the documents are rearranged, `spm_percent` of those with the suffix first.
    """
    p, s, m = sentinels
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256).alias("_h"))
    h = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_u", units_of(F.col("text"), unit))
    rows = rows.withColumn("n", F.size("_u").cast("long"))
    rows = rows.withColumns({"_a": F.least(h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)).cast("int"), "_b": F.greatest(h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)).cast("int")})
    holds = F.lit(False)
    for x in sentinels:
        holds |= F.contains(F.col("text"), F.lit(x))
    rows = rows.withColumn("form", F.when((F.col("text") == "") | holds | (h(2) % 100 >= percent), "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_u", start, length), ""))
    rows = rows.select(
        "doc_id", "text", "n", "form",
        part(F.lit(1), F.col("_a")).alias("prefix"),
        part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b") + 1, F.size("_u") - F.col("_b")).alias("suffix"),
    )
    psm, spm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from what was written and its form alone: a rearranged text holds each sentinel once."""
    pieces = F.split(output, "|".join(map(_quoted, sentinels)), -1)
    at = lambda k: F.get(pieces, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Lengths and SHA-256 of each document's output and of the text rebuilt from it."""
    rows = rearrange(docs)
    return rows.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
