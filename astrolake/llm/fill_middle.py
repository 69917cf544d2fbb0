"""Fill-in-the-middle transformation as plain column expressions.

``regexp_extract_all`` makes the array of units of a text, ``conv`` of substrings of a
``sha2`` gives the cuts, ``slice`` and ``array_join`` build the arrangement, and the
sentinels of an output are parsed to restore the text.  Every row is a function of itself
alone: no exchange, no Python.

A unit is blanks with the word after them, or the blanks at the end of a text, so units
joined are the text.  Draws h1 to h4 are the first four groups of eight hexadecimal digits
of sha256 of ``seed:doc_id``.  The prefix ends after the smaller of h1 and h2 modulo
(units + 1), the middle after the larger one.

Forms: ``plain``, the text as it is; ``psm``, prefix, suffix, middle, each behind its
sentinel; ``spm``, suffix, prefix, middle.  Texts that hold a sentinel stay plain, so the
sentinels of an output are its own.

Defined cases: a null text is an empty one; empty texts are plain; a null id draws as an
empty one; repeated rows give repeated rows; other columns, whatever their names, go along
in the struct ``doc``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.llm import packing

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits (from 0) as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three sentinels that can be told apart wherever they stand: none is part of another, none begins as another ends."""
    for i, a in enumerate(sentinels):
        if not a or any(i != j and a in b for j, b in enumerate(sentinels)):
            raise ValueError(f"not a sentinel beside the others: {a!r}")
        if any(a[-n:] == b[:n] for b in sentinels for n in range(1, min(len(a), len(b)))):
            raise ValueError(f"the end of {a!r} begins a sentinel")
    return sentinels


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, moved: int = 50, suffix_first: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc`` (the row), n (units), form, prefix, middle, suffix (null if plain) and output.

    ``moved`` of 100 texts are rearranged, ``suffix_first`` of 100 of these as spm."""
    p, s, m = checked(sentinels)
    rows = packing.wrapped(docs, id=doc_id, text=text)
    rows = rows.select("doc", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("key"))
    rows = rows.withColumns({"units": F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), "digest": F.sha2("key", 256)})
    n = F.size("units").cast("long")
    held = F.contains(F.col("text"), F.lit(p)) | F.contains(F.col("text"), F.lit(s)) | F.contains(F.col("text"), F.lit(m))
    form = F.when((F.col("text") == "") | held | (draw(F.col("digest"), 2) % 100 >= moved), "plain").when(draw(F.col("digest"), 3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"n": n, "h1": draw(F.col("digest"), 0) % (n + 1), "h2": draw(F.col("digest"), 1) % (n + 1), "form": form})
    rows = rows.withColumns({"a": F.least("h1", "h2").cast("int"), "b": F.greatest("h1", "h2").cast("int")})

    def joined(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    rows = rows.withColumns({"prefix": joined(F.lit(1), F.col("a")), "middle": joined(F.col("a") + 1, F.col("b") - F.col("a")), "suffix": joined(F.col("b") + 1, F.size("units") - F.col("b"))})
    parts = {"psm": (p, "prefix", s, "suffix"), "spm": (s, "suffix", p, "prefix")}
    shapes = {k: F.concat(F.lit(x), F.col(first), F.lit(y), F.col(second), F.lit(m), F.col("middle")) for k, (x, first, y, second) in parts.items()}
    output = F.when(F.col("form") == "psm", shapes["psm"]).when(F.col("form") == "spm", shapes["spm"]).otherwise(F.col("text"))
    return rows.select("doc", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made from."""
    part = F.split(output, "|".join(re.escape(x) for x in checked(sentinels)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
