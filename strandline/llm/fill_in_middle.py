"""Fill-in-the-middle: a document is cut twice and its parts are laid down in another order.

A unit is a run of the letters A-Z and a-z, or one other code point.  A text is stored as
its maximal runs of letters and of others: where each begins, and how many units lie
before it (a run of letters is one unit, a run of others as many as its code points).  A
cut after k units is found by binary search for the run that holds unit k, and its place
in the run is k less the units before it; no unit is ever written out.

Only the places of the cuts are found in Python, over blocks of bytes in numpy; texts are
cut and put together by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAW = "1"
PLAIN_PERCENT = 10
SPM_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLOCK = 1 << 20  # bytes looked at together
_GROUP = 4 << 20  # bytes of texts whose runs are held together; a longer text is a group of its own
_CUTS = "n: long, first: long, second: long"


class Runs:
    """The runs of neighbouring texts: ``data`` is their UTF-8, text i lies between offsets i and i + 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text_at = np.empty(len(offsets), np.int64)  # the code point at which each text begins
        starts, letters, n, last = [], [], 0, None
        for low in range(0, len(data), _BLOCK):
            block = data[low : low + _BLOCK]
            lead = (block & 0xC0) != 0x80
            i, j = np.searchsorted(offsets, (low, low + len(block)))
            before = np.concatenate(([0], np.cumsum(lead)))
            self.text_at[i:j] = n + before[offsets[i:j] - low]
            chars = block[lead]
            letter = ((chars | 32) - 97) < 26
            if len(letter):
                begins = np.empty(len(letter), bool)
                begins[0] = letter[0] != last
                begins[1:] = letter[1:] != letter[:-1]
                begins[self.text_at[i:j][self.text_at[i:j] < n + len(letter)] - n] = True
                at = np.flatnonzero(begins)
                starts.append(at + n)
                letters.append(letter[at])
                n, last = n + len(letter), letter[-1]
        self.text_at[np.searchsorted(offsets, len(data)) :] = n
        self.starts = np.concatenate([*starts, [n]]).astype(np.int64)
        self.letters = np.concatenate([*letters, [False]]).astype(bool)
        self.units = np.concatenate(([0], np.cumsum(np.where(self.letters[:-1], 1, np.diff(self.starts))))).astype(np.int64)
        self.first = self.units[np.searchsorted(self.starts, self.text_at)]  # the units before each text

    def counts(self) -> np.ndarray:
        """The units of each text."""
        return np.diff(self.first)

    def places(self, cuts: np.ndarray) -> np.ndarray:
        """For each text, the code points before its cut after so many units."""
        unit = self.first[:-1] + cuts
        run = np.searchsorted(self.units, unit, "right") - 1
        place = self.starts[run] + np.where(self.letters[run], 0, unit - self.units[run])
        return np.minimum(place, self.text_at[1:]) - self.text_at[:-1]


def cut_places(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before its two cuts; a cut is the number drawn modulo units + 1."""
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    out, i = [np.empty(len(texts), np.int64) for _ in range(3)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _GROUP, "right")) - 1)
        runs = Runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = runs.counts()
        a, b = first[i:j] % (n + 1), second[i:j] % (n + 1)
        out[0][i:j], out[1][i:j], out[2][i:j] = n, runs.places(np.minimum(a, b)), runs.places(np.maximum(a, b))
        i = j
    return tuple(out)


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in cut_places(texts, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))], ["n", "first", "second"])


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number, k from 1."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, draw: str = DRAW, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output: a row for each row of docs.

    The cuts and the form follow from the SHA-256 of ``draw``, a colon and doc_id (nothing
    where it is null), so the same row always gives the same output.  A null text is
    empty; an empty text and one that holds a sentinel stay plain, as do plain_percent of
    the others, and their prefix_chars and middle_chars are null.  Repeated rows give
    repeated rows.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(F.concat(F.lit(f"{draw}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_h"))
    cut = F.arrow_udf(_cuts, _CUTS).asNondeterministic()
    rows = rows.select("doc_id", "text", "_h", cut("text", _draw(F.col("_h"), 1), _draw(F.col("_h"), 2)).alias("_c"))
    held = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | held | (_draw(F.col("_h"), 3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(F.col("_h"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("_c.n").alias("n"), form.alias("form"), F.col("_c.first").cast("int").alias("_a"), F.col("_c.second").cast("int").alias("_b"))
    prefix, middle, suffix = F.substr("text", F.lit(1), F.col("_a")), F.substr("text", F.col("_a") + 1, F.col("_b") - F.col("_a")), F.substr("text", F.col("_b") + 1)
    p, s, m = (F.concat(F.lit(x), part) for x, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    cut_rows = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut_rows, F.col("_a")).cast("long").alias("prefix_chars"), F.when(cut_rows, F.col("_b") - F.col("_a")).cast("long").alias("middle_chars"), output.alias("output"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text from which an output was made, from the output and its form alone.

    No sentinel ends as it begins, so none can arise across a cut: each stands once.
    """
    part = lambda after, to: F.substring_index(F.substring_index(F.col(output), to, 1), after, -1)
    last = F.substring_index(F.col(output), MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), last, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), last, part(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
