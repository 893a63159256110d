"""Added lines of unified diffs, with the commit they belong to.

Input are patches as ordered lines (patch_id, seq, line), of any length: one commit, one staged file or a whole log. A patch is read by a
sequential machine (are we inside a diff, which commit, which file, where did the hunk start, how many lines since), but each part of
its state is the last of some events, or a sum since one. So a patch is cut into blocks, a block is folded into the little that it
changes, the folds are combined over the blocks before, and what comes out is the state in which the block's own lines are read. Lines
are shuffled once, by block; windows over whole patches see one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternscan.functions.text import excluded_commit, excluded_path, hunk_start, parse_author

#: Lines of a patch that are read in one go.
BLOCK = 4096


def added_lines(patches: DataFrame, exclude_paths: Sequence[str] = (), exclude_commits: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """path, line_no, line, commit, author, email, date, message of each added line."""
    line, keys = F.col("line"), ["patch_id", "block"]
    begins = lambda text: line.startswith(text)
    here = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("patch_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_here = lambda c: F.last(c, ignorenulls=True).over(here)
    last_before = lambda c: F.last(c, ignorenulls=True).over(before)
    last_of = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))

    lines = patches.select("patch_id", F.col("seq").cast("long").alias("seq"), "line", F.expr(f"cast(seq AS BIGINT) div {block}").alias("block"))
    lines = lines.repartition(*keys)  # the one shuffle of lines, which all folds and the last pass read again
    is_commit, is_diff = begins("commit ") & (F.octet_length(line) >= 47), begins("diff --git ")
    inside = F.when(is_commit, F.lit(False)).when(is_diff, F.lit(True))
    opened = F.when(is_commit, F.col("seq"))

    # first fold: inside a diff or not, and the line at which the commit begins
    folded = lines.groupBy(*keys).agg(last_of(inside).alias("inside"), last_of(opened).alias("opened"))
    start = folded.select(*keys, F.coalesce(last_before("inside"), F.lit(False)).alias("inside0"), F.coalesce(last_before("opened"), F.lit(-1)).alias("opened0"))
    lines = lines.join(start, keys)
    lines = lines.withColumns({"inside": F.coalesce(last_here(inside), "inside0"), "opened": F.coalesce(last_here(opened), "opened0")}).drop("inside0", "opened0")

    # second fold: file, hunk, and lines of the new version since the hunk began
    is_path, is_hunk = begins("+++ b/") & F.col("inside"), begins("@@ ") & F.col("inside")
    is_bound = is_path | is_hunk | is_diff
    is_added = F.col("inside") & ~is_bound & ~begins("--- ") & begins("+") & ~begins("+++")
    counts = is_added | (F.col("inside") & ~is_bound & begins(" "))
    path = F.when(is_commit, F.lit("")).when(is_path, F.substring(line, 7, 1 << 20))
    hunk = F.when(is_hunk, hunk_start("line")).when(is_bound, F.lit(0))
    lines = lines.withColumns({"path": last_here(path), "start": last_here(hunk), "n": F.sum(counts.cast("long")).over(here), "bound": is_bound, "added": is_added})
    lines = lines.withColumn("n_bound", last_here(F.when(F.col("bound"), F.col("n"))))  # so many were counted when the hunk began
    folded = lines.groupBy(*keys).agg(
        F.max_by("path", "seq").alias("path"), F.max_by("start", "seq").alias("start"), (F.max("n") - F.coalesce(F.max("n_bound"), F.lit(0))).alias("rest"),
        F.collect_set(F.when(F.col("added"), F.col("opened"))).alias("commits"), F.bool_or("bound").alias("bound"),
    )
    so_far = F.coalesce(F.sum("rest").over(before), F.lit(0))
    folded = folded.withColumns({"so_far": so_far, "path0": last_before("path"), "start0": last_before("start")})
    folded = folded.withColumn("n0", F.col("so_far") - F.coalesce(last_before(F.when(F.col("bound"), F.col("so_far"))), F.lit(0)))

    # what stands before a commit's first diff, once per commit, and then once per block that has lines of it
    said = lines.filter(~F.col("inside")).groupBy("patch_id", "opened").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).line.alias("head"))
    blocks = folded.select(*keys, F.explode("commits").alias("opened")).join(said.select("patch_id", "opened", header("head").alias("h")), ["patch_id", "opened"], "left")
    heads = blocks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("opened", "h"))).alias("heads"))
    state = folded.filter(F.size("commits") > 0).select(*keys, "path0", "start0", "n0").join(heads, keys)

    out = lines.filter("added").join(state, keys)
    h = F.try_element_at("heads", F.col("opened"))
    since = F.col("n") - 1 - F.coalesce("n_bound", -F.col("n0"))
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    out = out.select(
        text(F.coalesce("path", "path0"), "path"), (F.coalesce("start", "start0", F.lit(0)) + since).cast("int").alias("line_no"), F.substring(line, 2, 1 << 30).alias("line"),
        text(h.sha, "commit"), text(h.who["name"], "author"), text(h.who["email"], "email"), text(h.date, "date"), text(h.message, "message"),
    )
    return out.filter(~excluded_path("path", exclude_paths) & ~excluded_commit("commit", exclude_commits))


def header(head: Column | str) -> Column:
    """sha, who (name, email), date and message from the lines before a commit's first diff."""
    head = F.col(head) if isinstance(head, str) else head
    lead = lambda text: F.try_element_at(F.filter(head, lambda x: x.startswith(text)), F.lit(-1))
    dated = F.aggregate(head, F.struct(F.lit(False).alias("after"), F.array().cast("array<string>").alias("said")), lambda s, x: F.struct(
        (s.after | x.startswith("Date: ")).alias("after"),
        F.when(s.after & ~x.startswith("Date: ") & (F.trim(x) != ""), F.concat(s.said, F.array(F.trim(x)))).otherwise(s.said).alias("said"),
    ))
    first = F.get(head, F.lit(0))
    sha = F.when(first.startswith("commit ") & (F.octet_length(first) >= 47), F.regexp_extract(first, r"^commit (\S+)", 1))
    return F.struct(
        sha.alias("sha"), parse_author(F.substring(lead("Author: "), 9, 1 << 20)).alias("who"),
        F.trim(F.substring(lead("Date: "), 7, 1 << 20)).alias("date"), F.array_join(dated.said, " ").alias("message"),
    )
