"""Feature pages and search results that have landed as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.music import strip

# ---- fixed values: how a feature page marks the line that names a feature ----
STYLED_NAME = '<dt style="color:var(--dark-gray);font-size:1.25rem">'
PLAIN_NAME = r"^<dt>[a-zA-Z]+</dt>"


def tag_text(line: Column) -> Column:
    """Text between the first '>' and the first '</' of a line, percent signs removed."""
    start, stop = F.locate(">", line) + 1, F.locate("</", line)
    return F.replace(F.substring(line, start, stop - start), F.lit("%"), F.lit(""))


def feature_pairs(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, line, name, value): every name line, by its number, paired with the line after it; Key gives key and mode.

    Lines are zipped with their successors inside the row; a page is never split over tasks, moved or regrouped."""
    lines = F.transform(F.split(F.col(html), "\n"), strip)
    pairs = pages.select(id_col, F.posexplode(F.arrays_zip(
        lines.alias("line"), F.slice(lines, 2, F.size(lines)).alias("following"))).alias("line", "p"))
    named = pairs.filter(F.contains("p.line", F.lit(STYLED_NAME)) | F.col("p.line").rlike(PLAIN_NAME))
    read = named.select(id_col, "line", tag_text(F.col("p.line")).alias("name"), tag_text(F.col("p.following")).alias("value"))
    words = F.split("value", " ")
    entries = F.when(F.lower("name") == "key", F.array(
        F.struct(F.lit("key").alias("name"), F.get(words, F.lit(0)).alias("value")),
        F.struct(F.lit("mode").alias("name"), F.get(words, F.lit(1)).alias("value")))).otherwise(
        F.array(F.struct(F.col("name").alias("name"), F.col("value").alias("value"))))
    return read.select(id_col, "line", F.explode(entries).alias("e")).select(id_col, "line", "e.*")


def feature_rows(pairs: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """One row per page with the named features; of a name that a page repeats the last value holds. All-digit values become
    integers in typed tables downstream."""
    return pairs.groupBy(id_col).agg(*[
        F.max_by("value", F.when(F.lower("name") == n.lower(), F.col("line"))).alias(n) for n in names])


def split_query(query: Column) -> tuple[Column, Column]:
    """Song and artist around the last dash of ``song - artist``; nulls when there is no dash."""
    tail = F.substring_index(query, "-", -1)
    cut = F.length(query) - F.length(tail)  # length up to and including the dash
    has = F.contains(query, F.lit("-"))
    song = F.substring(query, F.lit(1), cut - 2)
    artist = F.substring(query, cut + 2, F.length(query))
    return F.when(has, F.lower(song)), F.when(has, F.lower(artist))


def match_candidates(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query, url): per query the url of the first source whose top hit names the song or the artist.

    ``results`` (query, source_priority, title, description, url) holds the landed top hit per source. A hit
    without url is passed over, and so is a source without hit."""
    song, artist = split_query(F.col("query"))
    wanted = queries.select("query").distinct()
    text = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "description")]
    hit = F.lit(False)
    for t in text:
        hit = hit | F.contains(t, song) | F.contains(t, artist)
    # Matching needs the query text only, so hits are reduced to one per query before anything is joined.
    found = (results.filter(hit & (F.coalesce(F.col("url"), F.lit("")) != ""))
             .groupBy("query").agg(F.min_by("url", F.struct("source_priority", "url")).alias("url")))
    return wanted.join(found, "query", "left").select("query", F.coalesce("url", F.lit("")).alias("url"))
