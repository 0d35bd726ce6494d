"""Cut a list of commits into work units by row count.

Input is one row per commit: ``version`` and ``rows``. A group takes commits greedily in version order, so
each group starts where the one before ended. The plan still runs in parallel. A block of commits is a map
from the state of the open group (its rows and commits so far) to the state behind the block: the open group
takes on as many commits of the block as fit, at most ``max_commits``, and what happens after these doesn't
depend on it. So a map is a short list, one entry for each number of commits taken on; maps of neighbouring
blocks make a map of the same form. They are put together level by level (``plans.scan``), and the states
that happen are handed back down, where each block numbers its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.plans.positions import row_positions, running_sum
from changeflow.plans.scan import Scan, before_blocks, span

MAX_COMMITS = 10
#: Version numbers in a block; a list of no more is one block and needs no maps.
BLOCK = 1_024

# A state: rows s and commits k of the open group, groups n so far. A group that takes no more has k = max_commits.
_STATE = "struct<s: bigint, k: int, n: bigint>"
_TAKEN = "named_struct('s', {s}, 'k', {k}, 'n', {n})"


def _maps(row_limit: int, alone_above: int | None, max_commits: int) -> tuple[str, str, Scan]:
    """The map of a block's sorted commits ``a``, the state behind one more commit, and how maps are put together.

    A map has ``m`` commits; ``p``, the running sums of the first commits that an open group could take on;
    ``whole``, whether these are all; ``e``, the state behind the block when the group ends before commit 0, 1, ...
    """
    big = "false" if alone_above is None else f"x.rows > {alone_above}"
    closed = _TAKEN.format(s="0L", k=max_commits, n="0L")
    next_state = f"""CASE WHEN {big} THEN {_TAKEN.format(s="0L", k=max_commits, n="t.n + 1")}
      WHEN t.k < {max_commits} AND t.s + x.rows <= {row_limit} THEN {_TAKEN.format(s="t.s + x.rows", k="t.k + 1", n="t.n")}
      ELSE {_TAKEN.format(s="x.rows", k="1", n="t.n + 1")} END"""
    sums = f"""aggregate(slice(a, 1, {max_commits}), named_struct('p', cast(array() AS array<bigint>), 'open', true),
      (t, x) -> CASE WHEN t.open AND NOT {big}
        THEN named_struct('p', array_append(t.p, coalesce(element_at(t.p, -1), 0L) + x.rows), 'open', true)
        ELSE named_struct('p', t.p, 'open', false) END, t -> t.p)"""
    sums = sums.replace("element_at(t.p, -1)", "try_element_at(t.p, -1)")
    ends = f"""transform(sequence(0, least(size(p), size(a) - 1)), i ->
      aggregate(slice(a, i + 1, size(a) - i), {closed}, (t, x) -> {next_state}))"""
    block = f"""transform(array({sums}), p -> named_struct('m', size(a), 'p', p, 'whole', size(p) = size(a), 'e', {ends}))[0]"""
    taken = f"size(filter(b.p, (x, i) -> s.s + x <= {row_limit} AND s.k + i + 1 <= {max_commits}))"
    step = f"""transform(array({taken}), i -> CASE
      WHEN b.whole AND i = b.m THEN {_TAKEN.format(s="s.s + b.p[i - 1]", k="s.k + i", n="s.n")}
      ELSE {_TAKEN.format(s="b.e[i].s", k="b.e[i].k", n="s.n + b.e[i].n")} END)[0]"""
    join = f"""named_struct('m', a.m + b.m,
      'p', CASE WHEN a.whole THEN slice(concat(a.p, transform(b.p, x -> x + a.p[a.m - 1])), 1, {max_commits}) ELSE a.p END,
      'whole', a.whole AND b.whole AND a.m + b.m <= {max_commits},
      'e', slice(concat(transform(a.e, s -> {step}), CASE WHEN a.whole THEN b.e ELSE slice(b.e, 1, 0) END), 1, {max_commits} + 1))"""
    return block, next_state, Scan(join, step, _STATE)


def _greedy_groups(
    commits: DataFrame, row_limit: int, alone_above: int | None, max_commits: int
) -> DataFrame:
    """``version, rows, group``: groups of at most ``row_limit`` rows and ``max_commits`` commits.

    The first commit of a group always fits. A commit of more than ``alone_above`` rows is a group
    of its own.
    """
    block, next_state, scan = _maps(row_limit, alone_above, max_commits)
    commits = commits.select(F.col("version").cast("bigint"), F.col("rows").cast("bigint"))
    first, versions = span(commits, "version")
    numbers = -(-versions // BLOCK)
    number = F.floor((F.col("version") - first) / BLOCK).cast("bigint").alias("n")
    blocks = commits.groupBy(number).agg(F.array_sort(F.collect_list(F.struct("version", "rows"))).alias("a"))
    initial = _TAKEN.format(s="0L", k=max_commits, n="0L")
    if numbers <= 1:
        entered = blocks.withColumn("before", F.expr(initial))
    else:
        maps = blocks.select(F.struct(F.lit(0)).alias("g"), "n", F.expr(block).alias("v"))
        states = before_blocks(maps, scan, initial, 0, numbers).select(F.col("n").alias("m"), "before")
        entered = blocks.join(states, F.col("n") == F.col("m"))
    numbered = f"""aggregate(a, named_struct('t', before, 'out', cast(array() AS array<struct<version: bigint, rows: bigint, `group`: bigint>>)),
      (u, x) -> transform(array(transform(array(u.t), t -> {next_state})[0]), t -> named_struct('t', t,
        'out', array_append(u.out, named_struct('version', x.version, 'rows', x.rows, 'group', t.n - 1))))[0], u -> u.out)"""
    return entered.select(F.inline(F.expr(numbered)))


def plan_adaptive(
    commits: DataFrame, split_above: int, merge_up_to: int, max_commits: int = MAX_COMMITS
) -> DataFrame:
    """``version, rows, group, mode``: large commits are split, small neighbours merged."""
    split_above, merge_up_to = max(split_above, 1), max(merge_up_to, 1)
    plan = _greedy_groups(commits, merge_up_to, split_above, max_commits)
    size = F.count(F.lit(1)).over(Window.partitionBy("group"))
    mode = (
        F.when(F.col("rows") > split_above, "split").when(size > 1, "merged").otherwise("single")
    )
    return plan.withColumn("mode", mode)


def plan_row_cap(commits: DataFrame, max_rows: int, max_commits: int = MAX_COMMITS) -> DataFrame:
    """``version, rows, group``: at most ``max_rows`` rows a group, but one commit at least."""
    if max_rows <= 0:
        raise ValueError("a row cap of 0 means off: use plan_version_cap")
    return _greedy_groups(commits, max_rows, None, max_commits)


def plan_version_cap(commits: DataFrame, start: int, max_commits: int = MAX_COMMITS) -> DataFrame:
    """``version, rows, group``: spans of ``max_commits`` version numbers from ``start`` on."""
    group = F.floor((F.col("version") - start) / max_commits).cast("bigint")
    return commits.where(F.col("version") >= start).select("version", "rows", group.alias("group"))


def chunk_counts(rows, target: int):
    """Chunks of a split commit (at least two) and the rows of all chunks but the last."""
    n = F.greatest(F.ceil(rows / F.lit(target)), F.lit(2)).cast("bigint")
    return n, F.floor(rows / n).cast("bigint")


def split_chunks(commits: DataFrame, split_above: int, chunk_target: int) -> DataFrame:
    """``version, chunk, chunks, chunk_rows`` of every commit larger than ``split_above``."""
    n, base = chunk_counts(F.col("rows"), max(chunk_target, 1))
    cut = commits.where(F.col("rows") > split_above).select(
        "version", "rows", n.alias("chunks"), base.alias("base")
    )
    cut = cut.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rest = F.col("rows") - F.col("base") * (F.col("chunks") - 1)
    size = F.when(F.col("chunk") == F.col("chunks") - 1, rest).otherwise(F.col("base"))
    return cut.select("version", "chunk", "chunks", size.alias("chunk_rows"))


def key_chunk(keys, chunks: int) -> Column:
    """Chunk number by key hash: all changes of a key fall into one chunk."""
    return F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("bigint")


def chunk_by_key(rows: DataFrame, keys, chunks: int) -> DataFrame:
    return rows.withColumn("chunk", key_chunk(keys, chunks))


def chunk_by_position(
    feed: DataFrame, chunk_target: int, order: str, version: str = "_commit_version"
) -> DataFrame:
    """Chunk number by position in the commit: exact row ranges, for appends.

    ``order`` is an integer column, unique in a commit.
    """
    placed = row_positions(feed, [version], order, name="__position", size="__rows")
    n, base = chunk_counts(F.col("__rows"), max(chunk_target, 1))
    chunk = F.least(F.floor(F.col("__position") / F.greatest(base, F.lit(1))), n - 1)
    return placed.withColumn("chunk", chunk.cast("bigint")).drop("__position", "__rows")


def progress_table(plan: DataFrame, chunk_target: int) -> DataFrame:
    """What the checkpoint says after each unit of an adaptive plan.

    ``unit_version, chunk, last_full_version, next_chunk, rows_committed, checkpoint``.
    """
    totals = running_sum(plan, "version", F.col("rows"))
    whole = (
        totals.where("mode <> 'split'")
        .groupBy("group")
        .agg(F.max("version").alias("unit_version"), F.max("total").alias("rows_committed"))
        .select(
            "unit_version",
            F.lit(0).cast("bigint").alias("chunk"),
            F.col("unit_version").alias("last_full_version"),
            F.lit(0).cast("bigint").alias("next_chunk"),
            "rows_committed",
        )
    )
    n, base = chunk_counts(F.col("rows"), max(chunk_target, 1))
    cut = totals.where("mode = 'split'").select("version", "rows", "total", n.alias("n"), base.alias("base"))
    cut = cut.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    final = F.col("chunk") == F.col("n") - 1
    done = F.when(final, F.col("rows")).otherwise((F.col("chunk") + 1) * F.col("base"))
    parts = cut.select(
        F.col("version").alias("unit_version"),
        "chunk",
        F.when(final, F.col("version")).otherwise(F.col("version") - 1).alias("last_full_version"),
        F.when(final, 0).otherwise(F.col("chunk") + 1).cast("bigint").alias("next_chunk"),
        (F.col("total") - F.col("rows") + done).alias("rows_committed"),
    )
    text = F.when(
        F.col("next_chunk") == 0, F.format_string("v%d:complete", "last_full_version")
    ).otherwise(F.format_string("v%d+chunk%d", "last_full_version", "next_chunk"))
    return whole.unionByName(parts).withColumn("checkpoint", text)
