"""Fill-in-the-middle texts by built-in SQL functions alone.

A text is cut into units (lines with their ends, by default) by regexp_extract_all;
digits of a keyed sha2 of the id, read through conv, give the two cuts and the form;
slices of the units are joined behind sentinels.  ``restored`` turns such a text back
by splitting it at its sentinels.  No step shuffles, collects or leaves the JVM.

Defined cases: null text is empty text, and an empty text stays plain; a text that
holds a sentinel stays plain, so that sentinels always tell the parts apart; a null
id counts as the empty decimal; rows that repeat an id are cut at the same draws,
repeated rows alike; texts of any length are cut whole; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Percent of the texts that are rearranged at all, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Sentinels (fixed values): before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(i: int) -> Column:
    """The i-th eight hex digits of column ``draws`` as a number."""
    return F.conv(F.substring("draws", 8 * i + 1, 8), 16, 10).cast("long")


def rearranged(docs: DataFrame, *, unit: str = LINES, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output - one row per document."""
    decimal = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), decimal), 256).alias("draws"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0)))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    cuts = [_draw(i) % (F.col("n") + 1) for i in (0, 1)]
    sentinel = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        sentinel = sentinel | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | sentinel | (_draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", "units", form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))

    def part(first: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, size), ""))

    a, b, n = F.col("a"), F.col("b"), F.col("n").cast("int")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, n - b).alias("suffix"))
    head, tail = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(SUFFIX), "suffix")
    arranged = F.concat(F.when(F.col("form") == "psm", F.concat(head, tail)).otherwise(F.concat(tail, head)), F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(arranged))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of the given form was made from.

    No sentinel begins inside another or across its edge, and none stands in a part,
    so splitting behind the first one yields exactly three parts.
    """
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(2)), F.get(parts, F.lit(1)))
    spm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0)))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 - one row per document."""
    made = rearranged(docs)
    chars = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units,
         sha256('7:' || coalesce(cast(doc_id as varchar), '')) as draws
  from documents
), drawn as (
  select doc_id, text, units, len(units) as n,
         ('0x' || substr(draws, 1, 8))::bigint as h1, ('0x' || substr(draws, 9, 8))::bigint as h2,
         ('0x' || substr(draws, 17, 8))::bigint as h3, ('0x' || substr(draws, 25, 8))::bigint as h4
  from cut
), formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m,
         coalesce(array_to_string(units[b + 1:], ''), '') as s
  from formed
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from parts
"""
