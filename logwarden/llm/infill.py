"""Fill-in-middle arrangements of documents, in SQL functions only.

A text becomes the array of its units, which are code points. Numbers from a hash of the document's
id cut it into prefix, middle and suffix and choose a form: prefix, suffix, middle (``psm``) or
suffix, prefix, middle (``spm``), each part behind its sentinel, or the text as it is (``plain``).
Parsing the sentinels brings the text back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sentinels:
    """What stands before each part; every one begins with ``<`` and has no other, so none can arise where parts meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] != "<" or m.count("<") > 1 for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("sentinels are three texts that begin with < and hold no other, none the start of another")

    def any_of(self) -> str:
        """A regular expression of the three."""
        return "|".join(rf"\Q{m}\E" for m in (self.prefix, self.suffix, self.middle))


SENTINELS = Sentinels()
#: Arrangements in a hundred documents, and those in a hundred of them that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 to the 32 of a document: groups of eight digits of its hash. No id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def infill(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Sentinels = SENTINELS) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of code points; the prefix ends after the smaller and the middle after the larger
    of two cuts from 0 to n, each as likely. ``form`` is plain where the text is null (counts as
    empty), empty or holds a sentinel, and for ``100 - rate`` documents in a hundred; the lengths of
    the parts are null then. Repeated rows get the same cuts. An empty table gives an empty result;
    other columns of ``docs``, whatever their names, are ignored. Rows never leave their task.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (F.length(text) == 0) | text.rlike(marks.any_of()) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda units, start, size: F.array_join(F.slice(units, start + 1, size), "")

    def arranged(units: Column) -> Column:
        n = F.size(units)
        a, b = (h1 % (n + 1)).cast("int"), (h2 % (n + 1)).cast("int")
        first, second = F.least(a, b), F.greatest(a, b)
        prefix, middle, suffix = part(units, F.lit(0), first), part(units, first, second - first), part(units, second, n - second)
        psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
        spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
        shown = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm)
        return F.struct(n.cast("long").alias("n"), first.cast("long").alias("prefix_chars"), (second - first).cast("long").alias("middle_chars"), shown.alias("output"))

    rows = docs.select("doc_id", text.alias("text"), form.alias("form"))
    units = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    rows = rows.select("doc_id", "text", "form", once(units, arranged).alias("made"))
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("made.n").alias("n"), "form", F.when(moved, F.col("made.prefix_chars")).alias("prefix_chars"), F.when(moved, F.col("made.middle_chars")).alias("middle_chars"),
        F.coalesce("made.output", "text").alias("output"),
    )


def restored(form: Column, output: Column, marks: Sentinels = SENTINELS) -> Column:
    """The text that an arrangement was made of, from its form and its sentinels."""
    in_order = lambda parts, *at: F.concat(*[parts[k] for k in at])
    parts = F.split(output, marks.any_of(), -1)
    return F.when(form == "psm", once(parts, lambda p: in_order(p, 1, 3, 2))).when(form == "spm", once(parts, lambda p: in_order(p, 2, 3, 1))).otherwise(output)
