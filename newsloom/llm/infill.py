"""Fill-in-middle transformation, in DataFrame functions alone.

A text is cut into units, each a word with the white space before it, or the white space at its end. Two cuts and
two draws come from the sha256 of seed and doc_id, so a document is cut alike on every run and machine. The units between the cuts are
the middle; a document stays plain if it is empty, holds a sentinel, or is not drawn. ``psm`` is prefix,
suffix, middle; ``spm`` is suffix, prefix, middle, each behind its sentinel. A text without sentinels is got back from its arrangement by
cutting at the sentinels: none can arise where a sentinel meets a text, since it begins with ``<`` and ends with ``>``.

A null text is an empty one; a null doc_id is hashed as an empty string; rows that repeat doc_id and text get equal results; an
empty table gives an empty one; texts are cut whole, however long, in the task that reads them: nothing is shuffled. Columns of
any name besides doc_id and text are kept by ``arranged`` and ignored by ``transformed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, fresh

UNIT = f"[{SPACES}]*{WORD}|[{SPACES}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
SEED = 42
#: Of 100 documents so many are arranged, and of 100 of those so many with the suffix first.
RATE = 50
SUFFIX_FIRST = 80


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _joined(units: Column, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(units, begin + 1, end - begin), "")


def arranged(df: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """df with a column ``infill`` (under a fresh name if it has one): n (units), form (plain, psm or spm), prefix, middle, suffix (null
    if plain) and output."""
    units, drawn, out = fresh(df, "units", "drawn", "infill")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(units)
    h = [F.get(drawn, F.lit(i)) for i in range(4)]
    cuts = [h[i] % (n + 1) for i in range(2)]
    begin, end = F.least(*cuts).cast("int"), F.greatest(*cuts).cast("int")
    plain = (text == "") | text.rlike(SENTINEL) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    parts = F.struct(
        n.cast("long").alias("n"), form.alias("form"), F.when(~plain, _joined(F.col(units), F.lit(0), begin)).alias("prefix"),
        F.when(~plain, _joined(F.col(units), begin, end)).alias("middle"), F.when(~plain, _joined(F.col(units), end, n)).alias("suffix"),
    )
    cut = df.withColumns({units: F.regexp_extract_all(text, F.lit(UNIT), 0), drawn: F.array(*draws(F.col("doc_id"), seed))}).withColumn(out, parts)
    p = {name: F.col(f"{out}.{name}") for name in ("form", "prefix", "middle", "suffix")}
    output = (
        F.when(p["form"] == "plain", text).when(p["form"] == "psm", F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"]))
        .otherwise(F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"]))
    )
    return cut.withColumn(out, F.col(out).withField("output", output)).drop(units, drawn)


def restored(output: Column, form: Column) -> Column:
    """The text that an arrangement was made of."""
    part = F.split(output, SENTINEL, -1)
    of = lambda *order: F.concat(*(F.get(part, F.lit(i)) for i in order))
    return F.when(form == "plain", output).when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1))


def transformed(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    x = arranged(df.select("doc_id", "text"))
    i = lambda name: F.col(f"infill.{name}")
    return x.select(
        F.col("doc_id").cast("long").alias("doc_id"), i("n").alias("n"), i("form").alias("form"), F.length(i("prefix")).cast("long").alias("prefix_chars"),
        F.length(i("middle")).cast("long").alias("middle_chars"), F.sha2(i("output"), 256).alias("output_sha256"), F.sha2(restored(i("output"), i("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parted AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""
