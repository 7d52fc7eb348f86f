"""Secret scan with corpus-wide ownership frequency (DataFrame only).

Candidates are the base matches (assignments, access keys, hex strings) and
opaque tokens: long runs that mix letters and digits.  The hash of each
candidate's value is counted over distinct repositories and distinct owners.
A value that many owners share is a copied example, and so is one in very many
repositories of one owner; one of few owners with few repositories each looks
live.  Base matches always stay; opaque tokens become spans when they look live.

Positions: splitting a text at a pattern and extracting its matches give the
pieces between and the matches; running sums of their lengths place them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satledger.llm.common import keyed, store

_VALUE = "A-Za-z0-9+/_.=-"
#: kind, pattern, group that holds the value, least length of the value.
KINDS = (
    ("assign", rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{_VALUE}]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = ("assign", "access", "hex")
#: From this number of owners on a value is a copied example.
COMMON_OWNERS = 3
#: From this number of repositories of one owner on a value is a copied example too.
COMMON_REPOS = 100
#: A live value has at least so many different characters.
LEAST_CHARACTERS = 8


def _cut(no: int, pattern: str, group: int) -> Column:
    """Null without a match, else the kind and its pieces: length of the gap before
    each match (a last one follows all), length of the match, value."""
    hit = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = hit if group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
                         F.transform(hit, F.length).alias("width"), value.alias("value"))
    return F.when(F.col("text").rlike(pattern), F.struct(F.lit(no).alias("kind_no"), parts.alias("parts")))


def _candidates(rows: DataFrame) -> DataFrame:
    """``row, owner, repo, kind_no, start, end, value, h`` of all matches but failing ones."""
    kinds = rows.select("row", "owner", "repo", F.explode("kinds").alias("k"))
    parts = kinds.select("row", "owner", "repo", "k.kind_no", F.posexplode("k.parts").alias("pos", "part"))
    order = Window.partitionBy("row", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.coalesce("part.width", F.lit(0))).over(order)
    least = F.element_at(F.array(*(F.lit(n) for *_, n in KINDS)), F.col("kind_no") + 1)
    placed = parts.withColumn("end", end).where(F.length("part.value") >= least)
    return placed.select("row", "owner", "repo", "kind_no", (F.col("end") - F.col("part.width")).alias("start"), "end",
                         F.col("part.value").alias("value"), F.md5("part.value").alias("h"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``h, owners, repos, most_repos, uses`` from rows of ``h, owner, repo``: distinct
    counts (``most_repos``: of the owner with most) by two partial aggregations, so a
    value that a third of all rows hold leaves each task once.  Null is an owner and a repository like any other."""
    by_repo = candidates.groupBy("h", "owner", "repo").agg(F.count("*").alias("uses"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"),
                                     F.max("repos").alias("most_repos"), F.sum("uses").alias("uses"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", common_owners: int = COMMON_OWNERS,
         common_repos: int = COMMON_REPOS) -> DataFrame:
    """One row per input row: ``id, found``, an array of structs ``start, kind_no,
    end, kind, base, owners, repos, live`` in order of start, then kind.

    Offsets count code points, ``end`` is exclusive.  Null and empty texts find
    nothing; repeated rows each keep their finds.  ``live``: fewer than
    ``common_owners`` owners, each with fewer than ``common_repos`` repositories, and
    enough different characters.  An empty table gives no rows; other columns are ignored."""
    rows = keyed(docs, id_col, text_col, owner_col, repo_col)
    kinds = F.array_compact(F.array(*(_cut(no, pattern, group) for no, (_, pattern, group, _) in enumerate(KINDS))))
    # the one pass over the texts; what it keeps is written, so row numbers are drawn once
    rows = store(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.col("c0").alias("owner"),
                             F.col("c1").alias("repo"), kinds.alias("kinds")), "secret-rows")
    found = store(_candidates(rows), "secret-candidates")
    owned = store(ownership(found), "secret-owners")
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in KINDS)), F.col("kind_no") + 1)
    variety = F.size(F.array_distinct(F.split("value", "")))
    few = (F.col("owners") < common_owners) & (F.col("most_repos") < common_repos)
    live = few & (variety >= LEAST_CHARACTERS)
    token = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    judged = found.join(owned, "h").withColumns({"kind": kind, "live": live, "base": kind.isin(*BASE)})
    spans = judged.where(F.col("base") | (F.col("live") & token)).groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "kind_no", "end", "kind", "base", "owners", "repos", "live"))).alias("found"))
    empty = F.array().cast(spans.schema["found"].dataType)
    return rows.select("row", "id").join(spans, "row", "left").select("id", F.coalesce("found", empty).alias("found"))
