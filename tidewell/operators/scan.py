"""Rule scans over lines and paths, and the selection of reviews and runs."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Shapes of secrets.
SECRETS = {
    "github_token": r"ghp_[A-Za-z0-9_]{30,}",
    "github_fine_token": r"github_pat_[A-Za-z0-9_]+",
    "sk_key": r"sk-[A-Za-z0-9_-]{20,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]+",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
}
#: A secret assigned in quotes; an addition of this package.
ASSIGNED = {"assigned_token": r'token = "[0-9a-f]{40}"'}
# Suffixes of media files.
MEDIA_SUFFIXES = (".aac", ".avi", ".flac", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".wav", ".webm")


def findings(texts: DataFrame, key: str, text: str, rules: Mapping[str, str], terms: Sequence[str] = ()) -> DataFrame:
    """(key, line, rule) of every line and rule that match; one finding for each pair.

    `rules` are patterns and `terms` literal strings, all constants of the plan, so each is
    compiled once per task and no rule table is joined.
    """
    lines = texts.select(F.col(key), F.posexplode(tx.lines(text)).alias("pos", "content"))
    tests: list[tuple[str, Column]] = [(name, F.col("content").rlike(pattern)) for name, pattern in rules.items()]
    tests += [(f"term: {term}", F.col("content").contains(term)) for term in terms]
    hits = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))
    return lines.select(key, (F.col("pos") + 1).cast("bigint").alias("line"), F.explode(hits).alias("rule"))


def path_status(path: Column, exact: Sequence[str] = (), names: Sequence[str] = (), folders: Sequence[str] = (), prefixes: Sequence[str] = (), allowed: Sequence[str] = (), part_prefixes: Sequence[str] = ()) -> Column:
    """Why a path is refused, or null: exact path, file name or folder (whatever their case), prefix of the path or (whatever its case) of any part, media file not allowed."""
    parts = F.split(F.lower(path), "/")
    starts = functools.reduce(lambda a, p: a | path.startswith(p), prefixes, F.lit(False))
    opens = F.exists(parts, lambda part: functools.reduce(lambda a, p: a | part.startswith(p.lower()), part_prefixes, F.lit(False)))
    return (
        F.when(path.isin(*exact) | F.element_at(parts, -1).isin(*(n.lower() for n in names)), "path")
        .when(F.arrays_overlap(parts, F.array(*(F.lit(f.lower()) for f in folders)).cast("array<string>")), "folder")
        .when(starts, "prefix").when(opens, "part")
        .when(tx.suffix(path).isin(*MEDIA_SUFFIXES) & ~path.isin(*allowed), "media")
    )


def is_media(path: Column, skipped_folders: Sequence[str] = (), skipped_prefixes: Sequence[str] = (), suffixes: Sequence[str] = MEDIA_SUFFIXES) -> Column:
    """A media suffix (or one of those given), and no skipped folder among the path's parents."""
    parents = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    bad = lambda part: functools.reduce(lambda a, p: a | part.startswith(p), skipped_prefixes, part.isin(*skipped_folders))
    return tx.suffix(path).isin(*suffixes) & ~F.exists(parents, bad)


def outside_bundles(paths: DataFrame, column: str = "relative_path", markers: Sequence[str] = ("manifest.json", "source.json")) -> DataFrame:
    """Paths not below a folder that holds all the marker files: an anti-join on their ancestors."""
    named = paths.select(F.regexp_extract(column, r"^(.*?)/?[^/]+$", 1).alias("folder"), F.regexp_extract(column, r"([^/]+)$", 1).alias("name"))
    marked = named.where(F.col("name").isin(*markers)).groupBy("folder").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(markers)).select("folder")
    parts = F.split(column, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = paths.select(column, F.explode(ancestors).alias("folder")).join(marked, "folder").select(column).distinct()
    return paths.join(below, column, "left_anti")


def candidates(tracked: DataFrame, changed: DataFrame, untracked: DataFrame, key: str) -> DataFrame:
    """(key, origin): tracked rows from the index, then changed and untracked ones of the working tree; a changed tracked row comes twice."""
    tree = changed.select(key).union(untracked.select(key).join(tracked.select(key), key, "left_anti"))
    return tracked.select(key, F.lit("index").alias("origin")).union(tree.select(key, F.lit("worktree").alias("origin")))


def reviewed(heads: DataFrame, reviews: DataFrame, states: Sequence[str], reviewer: str) -> DataFrame:
    """Heads with a submitted review by that reviewer, any `[bot]` ending aside."""
    mine = reviews.where((tx.reviewer_name("author") == tx.reviewer_name(F.lit(reviewer))) & F.col("state").isin(*states))
    return heads.join(mine.select(F.col("commit_oid").alias("head")), "head", "left_semi")


def commented(heads: DataFrame, comments: DataFrame, reviewer: str, clean: str, named: str, resolved: DataFrame) -> DataFrame:
    """Heads that a clean comment names in full, or by a prefix that `resolved` (short, oid) leads back to the head."""
    mine = comments.where((tx.reviewer_name("author") == tx.reviewer_name(F.lit(reviewer))) & F.col("body").rlike(clean))
    short = mine.select(F.explode(F.regexp_extract_all("body", F.lit(named), F.lit(1))).alias("short")).select(F.lower("short").alias("short")).distinct()
    oids = short.join(resolved.select(F.lower("short").alias("short"), F.lower("oid").alias("oid")), "short", "left")
    reach = oids.select(F.col("short").alias("named")).union(oids.where(F.col("oid").startswith(F.col("short"))).select("oid"))
    return heads.join(reach.select(F.col("named").alias("_h")).distinct(), F.lower("head") == F.col("_h"), "left_semi")


def resolved(shorts: DataFrame, short: str, hashes: DataFrame, full: str, least: int = 7) -> DataFrame:
    """(short, oid, matches) of each distinct prefix: none, one (then `oid` is the hash) or ambiguous.

    Both sides are dealt by their first `least` digits and sorted together, a prefix behind all that begins with it: if any hash
    does, the last one before the prefix does, and if another one does, the hash before that.  So the work grows with the rows
    and not with the pairs that a first part has.  Prefixes shorter than that match nothing; case is of no account, nulls are left out.
    """
    head = lambda c: F.substring(c, 1, least).alias("head")
    none, behind = F.lit(None).cast("string"), F.lit(b"\xff")  # a byte above all that UTF-8 has
    mine = shorts.select(F.lower(short).alias("short")).where(F.col("short").isNotNull()).distinct()
    there = hashes.select(F.lower(full).alias("oid")).where(F.col("oid").isNotNull()).distinct()
    rows = mine.select(head("short"), F.concat(F.col("short").cast("binary"), behind).alias("at"), "short", none.alias("oid"))
    rows = rows.unionByName(there.select(head("oid"), F.col("oid").cast("binary").alias("at"), none.alias("short"), "oid"))
    order = Window.partitionBy("head").orderBy("at")
    rows = rows.withColumn("before", F.last("oid", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("last", F.last(F.when(F.col("oid").isNotNull(), F.struct("oid", "before")), True).over(upto)).where(F.col("short").isNotNull())
    begins = lambda c: F.coalesce((F.length("short") >= least) & F.col(c).startswith(F.col("short")), F.lit(False))
    matches = F.when(begins("last.before"), "ambiguous").when(begins("last.oid"), "one").otherwise("none")
    return met.select("short", F.when(matches == "one", F.col("last.oid")).alias("oid"), matches.alias("matches"))


def commented_among(heads: DataFrame, comments: DataFrame, reviewer: str, clean: str, named: str, hashes: DataFrame, full: str, least: int = 7) -> DataFrame:
    """`commented`, with prefixes resolved among all `hashes`: one that several share names none of them."""
    shorts = comments.select(F.explode(F.regexp_extract_all("body", F.lit(named), F.lit(1))).alias("short"))
    found = resolved(shorts, "short", hashes, full, least).where("matches = 'one'")
    return commented(heads, comments, reviewer, clean, named, found.select("short", "oid"))


def failed_runs(runs: DataFrame, head: str, events: Sequence[str]) -> DataFrame:
    """Completed and failed runs of a head for the given events, newest first, larger ids first among equals."""
    wanted = runs.where((F.col("head_sha") == head) & (F.col("status") == "completed") & (F.col("conclusion") == "failure") & F.col("event").isin(*events))
    return wanted.orderBy(F.desc("created_at"), F.desc("run_id"))


def failed_jobs(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.where((F.col("name") == name) & (F.col("status") == "completed") & (F.col("conclusion") == "failure"))


def reruns(runs: DataFrame, jobs: DataFrame, head: str, events: Sequence[str], name: str) -> DataFrame:
    """(run_id, jobs): how many jobs of that name to run again for each failed run of a head, 0 where none failed; `jobs` has their run_id."""
    found = failed_jobs(jobs, name).groupBy("run_id").agg(F.count("*").alias("jobs"))
    return failed_runs(runs, head, events).select("run_id").join(found, "run_id", "left").select("run_id", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def newest_page(rows: DataFrame, size: int, *order: Column, skip: int = 0) -> DataFrame:
    """One page of at most `size` rows in an order that must be total."""
    return rows.orderBy(*order).offset(skip).limit(size) if skip else rows.orderBy(*order).limit(size)


def nodes(payloads: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """Rows of a node list inside JSON payloads; a missing author becomes an empty name."""
    rows = payloads.select(F.explode(F.from_json(F.get_json_object(column, path), f"array<{schema}>")).alias("node")).select("node.*")
    return rows.withColumn("author", F.coalesce(F.col("author.login"), F.lit(""))) if "author" in rows.columns else rows
