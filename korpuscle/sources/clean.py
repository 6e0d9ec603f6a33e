"""Text normalisation and the splitting of over-long documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nfkc

MAX_CHARS = 1_000_000


def normalized(text: Column) -> Column:
    """NFKC, line ends to LF, control and format characters out, blanks joined, at most one empty line, trimmed."""
    t = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def split_points(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Parts of at most ``limit`` characters, cut at a paragraph, else at white space, else hard."""
    out, at = [], 0
    while len(text) - at > limit:
        window = text[at : at + limit + 1]
        cut = window.rfind("\n\n")
        if cut <= 0:
            spaces = [m.start() for m in re.finditer(r"\s", window)]
            cut = spaces[-1] if spaces and spaces[-1] > 0 else limit
        out.append(text[at : at + cut])
        at += cut
        while at < len(text) and text[at].isspace():
            at += 1
    out.append(text[at:])
    return [p for p in out if p] or [""]


def split_long(df: DataFrame, limit: int = MAX_CHARS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Documents over the limit become parts with ids id#0, id#1 and on; others stay as they are."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [t] if t is None or len(t) <= limit else split_points(t, limit))

    parts = df.withColumn("_parts", cut(F.col(text_col)))
    out = parts.select("*", F.posexplode("_parts").alias("_n", "_part"))
    ident = F.when(F.size("_parts") > 1, F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("_n"))).otherwise(F.col(id_col).cast("string"))
    return out.withColumn(id_col, ident).withColumn(text_col, F.col("_part")).drop("_parts", "_n", "_part")
