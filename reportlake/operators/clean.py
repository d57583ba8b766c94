"""Cleaning and quality gates of raw reports; narrow transforms, nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx
from ..functions.objects import valid_json

ENTROPY_LIMIT = 4.8
TEXT, HTML, IMAGE, PDF = (".txt", ".md"), (".html", ".htm"), (".png", ".jpg", ".jpeg", ".gif"), (".pdf",)
#: A small lexicon stands in for a tagger: verbs of reports in four languages.
VERBS = "is are was were be has have had uses used est sont a ont ist sind wird hat es son fue tiene".split()


@F.pandas_udf(DoubleType())
def _entropies(texts: pd.Series) -> pd.Series:
    def bits(text: str | None) -> float:
        if not text:
            return 0.0
        counts = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        counts = counts[counts > 0]
        return float(np.log2(len(text)) - (counts * np.log2(counts)).sum() / len(text))

    return texts.map(bits).astype("float64")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for a null or empty text. Counted by batches of texts: built-in functions would make a row or a list item of every character."""
    return _entropies(text)


def code_blob(text: Column) -> Column:
    return entropy(text) > ENTROPY_LIMIT


def prose_counts(text: Column) -> Column:
    """Struct of sentences, tokens, alphabetic tokens and verbs of a text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    n = lambda keep: F.size(F.filter(words, keep))
    return F.struct(F.regexp_count(text, F.lit(r"[.!?](\s|$)")).alias("n_sentences"), F.size(words).alias("n_tokens"), n(lambda w: w.rlike(r"^\p{L}+$")).alias("n_alpha"), n(lambda w: w.isin(VERBS)).alias("n_verbs"))


def dominant(counts: Column) -> Column:
    """Prose: two sentences, two verbs and a quarter of alphabetic tokens, by :func:`prose_counts`."""
    return (counts["n_sentences"] >= 2) & (counts["n_verbs"] >= 2) & (counts["n_tokens"] > 0) & (counts["n_alpha"] >= 0.25 * counts["n_tokens"])


def prose_columns(df: DataFrame, column: str = "text") -> DataFrame:
    """Add the counts of :func:`prose_counts` and ``dominant``."""
    out = df.withColumn("_p", prose_counts(F.col(column))).withColumn("dominant", dominant(F.col("_p")))
    return out.select(*[c for c in out.columns if c not in ("_p", "dominant")], "_p.*", "dominant")


def route(df: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """stem, status and skip_reason of each file by extension and content; gates apply in the order empty, code, name.

    Text is code if its entropy is high and prose doesn't dominate. A name without three letters in a row before its extension is
    no document's. A PDF whose text could not be read (null) is an error.
    """
    ext, t = tx.extension(F.col(name)), tx.strip(F.coalesce(F.col(text), F.lit("")))
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    skip = (
        F.when(ext.isin(*TEXT) & (t == ""), "empty")
        .when(ext.isin(*TEXT) & code_blob(F.col(text)) & ~dominant(prose_counts(F.col(text))), "code")
        .when(ext.isin(*TEXT) & ~stem.rlike("[a-zA-Z]{3,}"), "filename")
        .when(ext.isin(*PDF) & F.col(text).isNull(), None)
        .when(ext.isin(*HTML, *PDF) & (t == ""), "empty")
        .when(~ext.isin(*TEXT, *HTML, *PDF, *IMAGE), "extension")
    )
    kind = F.when(ext.isin(*PDF) & F.col(text).isNull(), "[ERR]").when(ext.isin(*IMAGE), "[IMG]").when(ext.isin(*HTML), "[HTML]").when(ext.isin(*PDF), "[PDF]").otherwise("[TEXT]")
    return df.withColumn("stem", tx.clean_stem(F.col(name))).withColumn("skip_reason", skip).withColumn("status", F.when(F.col("skip_reason").isNotNull(), "[SKIP]").otherwise(kind))


def html_text(html: Column) -> Column:
    """Paragraphs, then list items as ``• …``, then table rows as ``a | b``, one to a line; page furniture is dropped."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|header|aside)\b.*?</\1\s*>", "")
    inner = lambda x: tx.strip(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), r"\s+", " "))
    blocks = lambda tag: F.filter(F.transform(F.regexp_extract_all(bare, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), inner), lambda x: x != "")
    items = F.transform(blocks("li"), lambda x: F.concat(F.lit("• "), x))
    cells = lambda row: F.array_join(F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), inner), " | ")
    rows = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), cells), lambda x: x != "")
    table = F.when(F.size(rows) > 0, F.concat(F.array(F.lit("[Table]")), rows)).otherwise(F.array().cast("array<string>"))
    return F.regexp_replace(F.array_join(F.concat(blocks("p"), items, table), "\n"), r"\n{3,}", "\n\n")


def selected(df: DataFrame, selection: DataFrame | None, key: str = "stem") -> DataFrame:
    """Rows of the selection; no selection means all."""
    return df if selection is None else df.join(selection.select(key).distinct(), key, "left_semi")


def bare_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name is a file name: not blank and without separators."""
    return df.filter(~F.col(name).rlike(r"[/\\]") & (F.trim(name) != ""))


def changed(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the store doesn't hold with the same content and provenance."""
    return current.join(stored.select(*keys).distinct(), keys, "left_anti")


def accepted_uploads(files: DataFrame, suffixes: tuple[str, ...], stamp: Column) -> DataFrame:
    """Uploads with an allowed extension; a name taken before gets a stamp before its extension. ``files``: upload_id, name, and
    optionally content, where JSON files must hold one JSON value."""
    from pyspark.sql import Window

    ok = files.filter(tx.extension(F.col("name")).isin(*suffixes))
    if "content" in files.columns:
        ok = ok.filter((tx.extension(F.col("name")) != ".json") | valid_json(F.col("content")))
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("upload_id"))
    renamed = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), stamp, F.lit("_"), n.cast("string"), tx.extension(F.col("name")))
    return ok.withColumn("_n", n).withColumn("stored_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(renamed)).drop("_n")
