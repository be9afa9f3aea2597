"""Recordings, match pages and manifests: labels, filters, names, counts and selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of a match page, each with one group.
PAGE = {
    "maps": r'class="mapname">\s*([^<]+?)\s*<',
    "demo_id": r'data-demo-link="/download/demo/(\d+)"',
    "event": r'class="event text-ellipsis">\s*([^<]+?)\s*<',
    "date": r'class="date"[^>]*>\s*([^<]+?)\s*<',
    "teams": r'class="teamName[^"]*">\s*([^<]+?)\s*<',
}


# ---- rows and columns ------------------------------------------------------------------------------------------------


def add_side(df: DataFrame, roles: tuple[str, ...] = ("",)) -> DataFrame:
    """side of each role from its team_num (2: T, 3: CT, else null), for the roles that df has."""
    new = {f"{r}side": F.when(F.col(f"{r}team_num") == 2, "T").when(F.col(f"{r}team_num") == 3, "CT") for r in roles if f"{r}team_num" in df.columns}
    return df.withColumns(new) if new else df


def live_samples(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Samples of players with health (if there is such a column) in a team, with x and y; z may be null."""
    ok = F.col("team_num").isin(2, 3) & F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(ok & (F.col("health") > 0) if "health" in df.columns else ok)


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; rows with a value that is none leave."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna(subset=columns)


def snake_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case with single underscores: `Integration [HH]` is integration_hh."""
    plain = lambda name: re.sub("_+", "_", re.sub(r"[ \[-]", "_", name.strip().lower()).replace("]", "")).strip("_")
    return df.toDF(*map(plain, df.columns))


def unprefix(df: DataFrame, names: tuple[str, ...] = ("X", "Y", "Z", "health")) -> DataFrame:
    """Columns whose part behind the last underscore is one of names get that name, if it is free (the first one of several)."""
    new: dict[str, str] = {}
    for c in df.columns:
        tail = c.rsplit("_", 1)[-1]
        if tail in names and tail not in df.columns and tail not in new.values():
            new[c] = tail
    return df.withColumnsRenamed(new)


def demo_id(path: str, root: str) -> Column:
    """The path below root with forward slashes and without .dem."""
    whole = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    inner = F.when(F.startswith(whole, F.lit(base)), F.substring(whole, len(base) + 1, 1 << 20)).otherwise(whole)
    return F.regexp_replace(inner, r"\.dem$", "")


def source_label(demo: str, override: str | None = None) -> Column:
    """pug or pro by the first folder of demo, else unknown; override wins."""
    if override:
        return F.lit(override)
    top = F.lower(F.split(demo, "/")[0])
    return F.when(F.contains(top, F.lit("pug")), "pug").when(top == "demos", "pro").otherwise("unknown")


def source_roots(recordings: DataFrame) -> DataFrame:
    """By map: the distinct first folders of its paths, sorted and joined by a comma and a space."""
    return recordings.groupBy("map_name").agg(F.array_join(F.array_sort(F.collect_set(F.split("path", "/")[0])), ", ").alias("roots"))


def match_id(file: str) -> Column:
    """The part of a file's name before the first underscore."""
    return F.substring_index(file, "_", 1)


def valid_lines(lines: DataFrame) -> DataFrame:
    """Lines with integration and connectivity over 0 and choice of at least 0, none of them NaN: lines without a contact have -1."""
    ok = F.lit(True)
    for c in ("integration_hh", "connectivity", "choice"):
        ok &= ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0 if c == "choice" else F.col(c) > 0)
    return lines.where(ok)


def only_map(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("map_name") == name)


def assert_same_map(df: DataFrame, name: str) -> DataFrame:
    """df as it is; the job fails at a row of another map."""
    wrong = F.raise_error(F.concat(F.lit(f"expected map {name}, got "), F.coalesce("map_name", F.lit("none")))).cast("string")
    return df.withColumn("map_name", F.when(F.col("map_name") == name, F.col("map_name")).otherwise(wrong))


def union_frames(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there, and types are widened."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# ---- counts and selections -------------------------------------------------------------------------------------------


def event_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """By file: rounds (round_start rows) and kills (player_death rows)."""
    return events.groupBy(*by).agg(F.count_if(F.col("event_name") == "round_start").alias("rounds"), F.count_if(F.col("event_name") == "player_death").alias("kills"))


def complete_matches(counts: DataFrame, min_rounds: int = 13) -> DataFrame:
    return counts.where(F.col("rounds") >= min_rounds)


def map_totals(recordings: DataFrame) -> DataFrame:
    """By map: files, rounds, kills, rows and bytes of its recordings, and the source of the first path."""
    sums = [F.sum(c).alias(n) for c, n in (("rounds", "rounds"), ("kills", "kills"), ("rows", "rows"), ("size_bytes", "bytes_total"))]
    return recordings.groupBy("map_name").agg(F.count("*").alias("demo_count"), *sums, F.min_by("source", "path").alias("source"))


def inventory(geometry: DataFrame, behaviour: DataFrame) -> DataFrame:
    """All maps with a geometry, with what is known of their behaviour."""
    return geometry.join(behaviour, "map_name", "left")


#: Rows that Spark's window limit keeps on the map side at most; of more, groups are first cut into SALTS parts.
LIMITED, SALTS = 1000, 64


def sample_rows(df: DataFrame, key: str, by: list[str], k: int, seed: int = 1) -> DataFrame:
    """k rows of each group (all, if it has no more): those with the least md5 of `seed|key`, the same ones in every run and at every partitioning.

    The least k of parts make the least k of all: each task hands on k rows of a group at most.
    """
    named = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    least = lambda d, *on: d.withColumn("_place", F.row_number().over(Window.partitionBy(*on).orderBy("_hash", key))).where(F.col("_place") <= k).drop("_place")
    if k > LIMITED:
        named = least(named.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS))), *by, "_salt").drop("_salt")
    return least(named, *by).drop("_hash")


def first_rows(df: DataFrame, columns: list[str], order: list[str], n: int = 6) -> DataFrame:
    """The first n rows, with those of columns that df has."""
    return df.orderBy(*order).limit(n).select(*(c for c in columns if c in df.columns))


# ---- pages -----------------------------------------------------------------------------------------------------------


def extract_links(html: str, pattern: str = r'href="(/matches/\d+/[^"]+)"') -> Column:
    """The distinct links that match, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1))


def slug(url: Column | str) -> Column:
    """The last part of an address, with runs of other characters than letters, digits and underscores as one dash, cut to 60."""
    return F.substring(F.regexp_replace(F.substring_index(url, "/", -1), r"(?U)[^\w]+", "-"), 1, 60)


def parse_match_page(pages: DataFrame, patterns: dict[str, str] = PAGE) -> DataFrame:
    """(link, match_id, maps, demo_id, event, date, teams) of pages (link, html). match_id is the link where it has no number."""
    every = lambda k: F.transform(F.regexp_extract_all("html", F.lit(patterns[k]), 1), F.trim)
    one = lambda k: F.regexp_extract("html", patterns[k], 1)
    number = F.nullif(F.regexp_extract("link", r"/matches/(\d+)/", 1), F.lit(""))
    teams = F.substring(F.array_join(F.array_distinct(every("teams")), " vs "), 1, 60)
    return pages.select("link", F.coalesce(number, "link").alias("match_id"), every("maps").alias("maps"), F.nullif(one("demo_id"), F.lit("")).alias("demo_id"), F.trim(one("event")).alias("event"), F.trim(one("date")).alias("date"), teams.alias("teams"))


def quota(df: DataFrame, have: DataFrame, by: str, order: list[str], per: int) -> DataFrame:
    """The first rows of each group, in order, as long as have (by, have) and they are no more than per."""
    known = df.join(have.select(by, "have"), by, "left").fillna(0, ["have"])
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return known.withColumn("_place", place).where(F.col("have") + F.col("_place") <= per).drop("_place", "have")


def select_candidates(pages: DataFrame, have: DataFrame, labels: dict[str, str], per_map: int, keywords: tuple[str, ...] = (), order: list[str] = ("match_id",)) -> DataFrame:
    """(match_id, wanted): pages with a recording, whose event holds a keyword (if there are any), and which have maps that are wanted still.

    labels names the maps as pages do. Of each map, the first pages in order are taken until per_map are there.
    """
    ok = F.col("demo_id").isNotNull()
    if keywords:
        ok &= F.rlike(F.lower("event"), F.lit("|".join(map(re.escape, keywords))))
    names = F.array(*(F.struct(F.lit(m).alias("map_name"), F.lit(label).alias("label")) for m, label in labels.items()))
    rows = pages.where(ok).withColumn("m", F.explode(names)).where(F.array_contains("maps", F.col("m.label"))).select("*", F.col("m.map_name").alias("map_name")).drop("m")
    taken = quota(rows, have, "map_name", list(order), per_map)
    return taken.groupBy("match_id").agg(F.array_sort(F.collect_set("map_name")).alias("wanted"))
