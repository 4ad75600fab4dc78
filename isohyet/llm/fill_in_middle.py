"""Fill-in-middle transformation by lookaround splitting, in DataFrame expressions alone.

A unit grammar is a set of neighbouring classes between which a unit ends: it becomes a regular expression of zero
width, `(?<=left)(?=right)`, and splitting there keeps every character. Two cuts fall at unit boundaries, and the three
parts are put together with sentinels, suffix first (spm) or prefix first (psm). All choices come from a hash of the
seed and the row's id, so that they can be made again.

Rows: a null or empty text has no units and stays plain, as does a text that holds a sentinel, which could not be told
from those put in. A null id is hashed as an empty one. Repeated rows get equal results; an empty table has none. Extra
columns are left out. Texts of any length are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import narrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SPACE = r"\x20\x09-\x0D"
#: Unit grammars by name: the classes on the left and right of a boundary.
GRAMMARS = {
    "tokens": [(f"[^{_SPACE}]", f"[{_SPACE}]")],  # white space and the word behind it
    "characters": [(r"[\s\S]", r"[\s\S]")],
    "lines": [(r"\n", r"[\s\S]")],  # a line with its end
    "classes": [(r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"), (r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]")],  # words, and what is between
}


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width expression of a grammar's boundaries."""
    return "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def units(text: Column, grammar: str = "tokens") -> Column:
    """The units of a text, which put together give the text; none for an empty one, which split() would give one for."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def transform(
    df: DataFrame, grammar: str = "tokens", rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) of every row: `rate` percent are transformed, and of these
    `spm_rate` percent have the suffix first. The parts of a plain row are null."""
    rows = narrow(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    holds = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        holds |= F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | holds | (draw[2] % 100 >= rate)
    cut = rows.select(
        "doc_id", "text", units(F.col("text"), grammar).alias("units"), F.when(plain, PLAIN).when(draw[3] % 100 < spm_rate, SPM).otherwise(PSM).alias("form"), *(d.alias(f"h{i}") for i, d in enumerate(draw[:2]))
    )
    n = F.size("units")
    cuts = [(F.col(f"h{i}") % (n + 1)).cast("int") for i in range(2)]
    first, last = F.least(*cuts), F.greatest(*cuts)
    there = F.col("form") != PLAIN
    parts = {"prefix": _part(F.col("units"), F.lit(0), first), "middle": _part(F.col("units"), first, last), "suffix": _part(F.col("units"), last, n)}
    out = cut.select("doc_id", "text", n.cast("long").alias("n"), "form", *(F.when(there, p).alias(name) for name, p in parts.items()))
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    return out.withColumn("output", F.when(F.col("form") == SPM, spm).when(F.col("form") == PSM, psm).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that a form's output was made of: the parts lie between the sentinels, each of which occurs once."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substr(F.substring_index(head, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substr(F.substring_index(head, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
