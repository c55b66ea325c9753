"""Fill-in-middle transformation over run-length encoded character classes.

A unit is a run of A-Z and a-z, or any other single code point.  A text is stored as its
maximal runs of one class, letters or others, each with its first code point and the number
of units before it: a run of letters is one unit, a run of others has a unit for each code
point.  A cut behind ``u`` units is found by binary search of the run that holds unit ``u``;
its place is the start of that run, plus the units left over, which are code points there.

Two keyed cuts make prefix, middle and suffix; they are written in one of three forms:
plain (the text), psm and spm.  Marks in the text itself make it plain, so the text can
always be rebuilt from output and form.

A null text is empty, and an empty one is plain with 0 units.  Texts of any length are cut as a
whole.  A null id draws as the empty string does.  Repeated rows give a row each, equal
cuts an empty middle.  An empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm import textbatch as tb
from docloom.llm.tables import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100 draws
SPM_BELOW = 20  # of 100 draws
CUTS = StructType([StructField(c, LongType()) for c in ("n", "low", "high")])


def _letter_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = True
    return table


LETTER = _letter_table()


@dataclass
class Runs:
    """The class runs of texts laid end to end; a closing entry stands behind the last run."""

    start: np.ndarray  # first code point
    letters: np.ndarray  # class of each run
    before: np.ndarray  # units before it
    first: np.ndarray  # the first run of each text, and the end

    def units(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before[self.first])

    def cut(self, u: np.ndarray) -> np.ndarray:
        """Code points of each text before the cut behind its first ``u`` units."""
        unit = self.before[self.first[:-1]] + u
        run = np.searchsorted(self.before, unit, "right") - 1
        return self.start[run] + unit - self.before[run] - self.start[self.first[:-1]]


def class_runs(buf: np.ndarray, off: np.ndarray) -> Runs:
    """Runs of UTF-8 texts in a buffer with row offsets."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    letter = LETTER[buf[lead]]
    row_start = np.searchsorted(lead, off)
    head = np.ones(len(lead), bool)
    np.not_equal(letter[1:], letter[:-1], out=head[1:])
    head[row_start[row_start < len(lead)]] = True
    start = np.append(np.flatnonzero(head), len(lead))
    letters = letter[start[:-1]]
    size = np.where(letters, 1, np.diff(start))
    return Runs(start, letters, np.concatenate([[0], np.cumsum(size)]), np.searchsorted(start, row_start))


def encode_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run_start, run_letters, units_before): the stored runs of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1)):
                r = class_runs(buf, off)
                of = np.repeat(r.first[:-1], np.diff(r.first))
                lists = [r.start[:-1] - r.start[of], r.letters, r.before[:-1] - r.before[of]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(tb.arrow_lists(x, r.first) for x in lists)], names=["doc_id", "run_start", "run_letters", "units_before"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, run_start array<long>, run_letters array<boolean>, units_before array<long>")


@F.arrow_udf(CUTS)
def cut_points(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Units of a text, and the code points before the lesser and the greater of two drawn cuts."""
    out, draws = [], [np.asarray(x.to_numpy(zero_copy_only=False)) for x in (one, other)]
    for i, j, buf, off in tb.text_runs(text):
        runs = class_runs(buf, off)
        n = runs.units()
        cuts = np.sort([d[i:j] % (n + 1) for d in draws], axis=0)
        out.append((n, runs.cut(cuts[0]), runs.cut(cuts[1])))
    n, low, high = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(low), pa.array(high)], ["n", "low", "high"])


def draw(key: Column, k: int) -> Column:
    """The k-th of eight 32-bit draws for a key."""
    digest = F.sha2(F.encode(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text."""
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.cast("long").alias("doc_id"), text.alias("text"), cut_points(text, draw(key, 0), draw(key, 1)).alias("cut"), draw(key, 2).alias("h3"), draw(key, 3).alias("h4"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("cut.n") == 0) | marked | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    prefix, middle = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a)
    suffix = F.substring("text", b + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = rows.withColumn("form", form)
    cut = F.col("form") != "plain"
    return out.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(cut, F.col("cut.low")).alias("prefix_chars"),
        F.when(cut, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""

    def until(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def behind(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)

    middle = behind(output, MIDDLE)
    psm = F.concat(until(behind(output, PREFIX), SUFFIX), middle, until(behind(output, SUFFIX), MIDDLE))
    spm = F.concat(until(behind(output, PREFIX), MIDDLE), middle, until(behind(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    digests = {name: F.sha2(F.encode(c, "UTF-8"), 256) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form"))))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(c.alias(name) for name, c in digests.items()))
