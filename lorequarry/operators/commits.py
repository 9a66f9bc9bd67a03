"""A commit graph as tables: revisions, ancestors by pointer doubling, reachability with merges, log, show and status.

commits (sha, parents array<string>, author, time, message), refs (name, sha), changes (sha, path, status, added, deleted).

The first parents form trees.  Commits are numbered by a hash of their name (a second hash is compared wherever numbers meet, and another seed is
taken if two names share a number).  One commit in EVERY, chosen by hash, is an anchor.  ``Graph`` keeps, in the shared folder, the ancestors 1, 2, 4, ...
first parents away that are reached without meeting an anchor, so these tables shrink and end at once the gaps do, and for anchors alone those 1, 2, 4, ...
anchors away with their distance.  So the n-th ancestors of any number of commits take a join for each bit of n, whatever the depth of the history, and all
tables together hold a few rows for each commit.  What is reachable from some tips is found among the anchors first and then filled in between them; then
the other parents of merges start the next round.  The number of rounds is the depth of merges inside merges, not of the history.

Defined cases: a commit without parents ends its line; parents that are not among the commits are followed no further; an ancestor beyond the
root is null; null revisions, and those that name nothing or several commits, have an error and no commit.
"""

from __future__ import annotations

import itertools
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut, kept


EVERY = 16  # commits to an anchor


def _number(sha: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), sha)


def _anchor(n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("anchor"), n), F.lit(EVERY)) == 0


class Graph:
    """Commits (sha, parents) and the tables of their ancestors, made when they are needed."""

    def __init__(self, commits: DataFrame):
        self.commits = commits
        self.levels: list[DataFrame] = []  # (n, to, far): the anchor 2**level anchors away and its distance

    @cached_property
    def _hashed(self) -> tuple[int, DataFrame]:
        """The seed of the numbers, and (n, c, p, pc): number and second hash of each commit and of its first parent."""
        for seed in itertools.count(0, 2):
            first = F.get("parents", F.lit(0))
            parent = F.when(first.isNotNull(), F.struct(_number(first, seed).alias("p"), _number(first, seed + 1).alias("pc")))
            rows = self.commits.where("sha is not null").select(_number(F.col("sha"), seed).alias("n"), _number(F.col("sha"), seed + 1).alias("c"), parent.alias("f"))
            own = kept(rows.groupBy("n").agg(F.min("c").alias("c"), F.max("c").alias("most"), F.min("f").alias("f")))
            if own.where("c <> most").isEmpty():
                return seed, own.select("n", "c", "f.p", "f.pc")

    def numbered(self, rows: DataFrame, sha: str = "sha") -> DataFrame:
        """Rows with n, the number of the commit they name; rows that name none go."""
        seed, own = self._hashed
        return rows.withColumns({"n": _number(F.col(sha), seed), "c": _number(F.col(sha), seed + 1)}).join(own.select("n", "c"), ["n", "c"]).drop("c")

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with sha in place of the number n."""
        own = self.commits.where("sha is not null").select(_number(F.col("sha"), self._hashed[0]).alias("n"), "sha").distinct()
        return rows.join(own, "n").drop("n")

    @cached_property
    def links(self) -> DataFrame:
        """(n, to): each commit with its first parent, where that is a commit."""
        own = self._hashed[1]
        parents = own.select(F.col("n").alias("p"), F.col("c").alias("pc"))
        return kept(own.where("p is not null").select("n", "p", "pc").join(parents, ["p", "pc"]).select("n", F.col("p").alias("to")))

    @cached_property
    def others(self) -> DataFrame:
        """(child, to): each merge with its other parents, where these are commits."""
        merges = self.commits.where(F.size("parents") > 1).select(_number(F.col("sha"), self._hashed[0]).alias("child"), F.explode(F.slice("parents", 2, F.size("parents") - 1)).alias("sha"))
        return kept(self.numbered(merges).select("child", F.col("n").alias("to")))

    @cached_property
    def steps(self) -> list[DataFrame]:
        """(n, to): for each k the ancestor 2**k away, where neither it nor one before it is an anchor."""
        out = [self.links.where(~_anchor(F.col("to")))]
        while True:
            last = out[-1]
            made = kept(last.join(last.select(F.col("n").alias("to"), F.col("to").alias("far")), "to").select("n", F.col("far").alias("to")))
            if made.isEmpty():
                return out
            out.append(made)

    def exits(self, rows: DataFrame) -> DataFrame:
        """(n) -> (n, to, far): the first anchor above each and its distance, where there is one."""
        at = rows.select("n", F.col("n").alias("at"), F.lit(0).cast("long").alias("far"))
        for k, step in reversed(list(enumerate(self.steps))):
            up = at.join(step.select(F.col("n").alias("at"), F.col("to").alias("up")), "at", "left")
            at = up.select("n", F.coalesce("up", "at").alias("at"), (F.col("far") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("far"))
        return at.join(self.links.select(F.col("n").alias("at"), "to"), "at").select("n", "to", (F.col("far") + 1).alias("far"))

    def jump(self, level: int) -> DataFrame | None:
        """(n, to, far) of anchors: the anchor 2**level anchors away, and its distance; None beyond the longest line."""
        while len(self.levels) <= level:
            if not self.levels:
                made = self.exits(self._hashed[1].where(_anchor(F.col("n"))))
            else:
                last = self.levels[-1]
                made = last.join(last.select(F.col("n").alias("to"), F.col("to").alias("__to"), F.col("far").alias("__far")), "to").select("n", F.col("__to").alias("to"), (F.col("far") + F.col("__far")).alias("far"))
            made = kept(made)
            if made.isEmpty():
                return None
            self.levels.append(made)
        return self.levels[level]


def ancestors(graph: Graph, asked: DataFrame) -> DataFrame:
    """asked (..., sha, hops) with ancestor: the commit that many first parents away, null beyond the root.

    Rows whose hops are null or negative have no ancestor; with 0 hops it is the name that was asked for.
    """
    far = asked.where("hops > 0").select("sha", F.col("hops").cast("long").alias("hops")).distinct()
    at = kept(graph.numbered(far).select(F.col("n").alias("of"), "hops"))
    most = at.agg(F.max("hops")).first()[0] or 0
    exits = graph.exits(at.select(F.col("of").alias("n")).distinct()).withColumnsRenamed({"n": "of"})
    out = (F.col("far") <= F.col("left")) & F.col("to").isNotNull()
    at = at.withColumn("left", F.col("hops")).join(exits, "of", "left")
    at = at.select("of", "hops", F.when(out, F.col("to")).otherwise(F.col("of")).alias("at"), (F.col("left") - F.when(out, F.col("far")).otherwise(0)).alias("left"))
    up, level = [], 0
    while (1 << level) <= most and (jump := graph.jump(level)) is not None:
        up.append(jump)
        level += 1
    for jump in reversed(up):  # commits that are no anchors are in none of these
        at = at.join(jump.withColumnsRenamed({"n": "at"}), "at", "left")
        at = at.select("of", "hops", F.when(out, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("left") - F.when(out, F.col("far")).otherwise(0)).alias("left"))
    for k, step in reversed(list(enumerate(graph.steps))):
        if (1 << k) <= most:
            at = at.join(step.withColumnsRenamed({"n": "at"}), "at", "left")
            near = F.col("to").isNotNull() & (F.col("left") >= 1 << k)
            at = at.select("of", "hops", F.when(near, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("left") - F.when(near, 1 << k).otherwise(0)).alias("left"))
    found = graph.named(at.where("left = 0").select("of", "hops", F.col("at").alias("n"))).withColumnsRenamed({"of": "__of", "hops": "__hops", "sha": "__up"})
    rows = asked.withColumn("__n", _number(F.col("sha"), graph._hashed[0]))
    rows = rows.join(found, (F.col("__n") == F.col("__of")) & (F.col("hops") == F.col("__hops")), "left")
    return rows.withColumn("ancestor", F.when(F.col("hops") == 0, F.col("sha")).otherwise(F.col("__up"))).drop("__n", "__of", "__hops", "__up")


def _reached(graph: Graph, tips: DataFrame) -> DataFrame:
    """(n): what is reachable from the tips (sha)."""
    own, others = graph._hashed[1], graph.others
    seen = None
    front = kept(graph.numbered(tips.select("sha").distinct()).select("n"))
    while not front.isEmpty():
        # the anchors above, doubling
        above = graph.exits(front).select(F.col("to").alias("n")).distinct()
        above = kept(above if seen is None else above.join(seen, "n", "left_anti"))  # what is above a commit that is seen is seen too
        level = 0
        while (jump := graph.jump(level)) is not None:
            more = above.join(jump, "n").select(F.col("to").alias("n")).distinct().join(above, "n", "left_anti")
            more = kept(more if seen is None else more.join(seen, "n", "left_anti"))
            if more.isEmpty():  # farther ones are above those that are known
                break
            above = above.unionByName(more)
            level += 1
        # and all between them
        new = kept(front.unionByName(above).distinct())
        for step in graph.steps:
            new = new.unionByName(kept(new.join(step, "n").select(F.col("to").alias("n"))))
        new = new.distinct()
        new = kept(new if seen is None else new.join(seen, "n", "left_anti"))
        merged = new.join(others.withColumnRenamed("child", "n"), "n").select(F.col("to").alias("n")).distinct()
        seen = new if seen is None else seen.unionByName(new)
        front = kept(merged.join(seen, "n", "left_anti"))
    return own.select("n").limit(0) if seen is None else seen


def reachable(graph: Graph, tips: DataFrame) -> DataFrame:
    """(sha): the tips that are commits, and all that their parents lead to."""
    return graph.named(_reached(graph, tips))


def commit_range(graph: Graph, since: DataFrame, until: DataFrame) -> DataFrame:
    """(sha): what is reachable from ``until`` and not from ``since`` (both (sha))."""
    return graph.named(_reached(graph, until).join(_reached(graph, since), "n", "left_anti"))


def rev_parse(graph: Graph, refs: DataFrame, revisions: DataFrame, shortest: int = 4) -> DataFrame:
    """(rev) -> (rev, sha, error): HEAD, HEAD^n, a name, a commit or the beginning of one, each with ~n for the n-th first parent.

    HEAD^n is the n-th first parent as well, and HEAD^ the first.
    """
    number = r"[0-9]{1,9}"
    base = F.regexp_extract("rev", r"^([^~]+)(?:~|$)", 1)
    tilde = F.when(F.contains(F.col("rev"), F.lit("~")), F.regexp_extract("rev", rf"^[^~]+~({number})$", 1)).otherwise("0")
    caret = F.when(base.startswith("HEAD^"), F.when(base == "HEAD^", "1").otherwise(F.regexp_extract(base, rf"^HEAD\^({number})$", 1))).otherwise("0")
    parsed = revisions.select("rev").distinct().withColumn("name", F.when(base.startswith("HEAD^"), F.lit("HEAD")).otherwise(base))
    parsed = parsed.withColumn("hops", tilde.try_cast("long") + caret.try_cast("long"))
    bad = F.when(F.col("rev").isNull() | (F.col("name") == "") | F.col("hops").isNull(), "malformed")
    named = parsed.withColumn("error", bad).join(refs.select("name", F.col("sha").alias("__ref")), "name", "left")
    full = graph.commits.select(F.col("sha").alias("__sha"), F.left("sha", F.lit(shortest)).alias("__head"))
    long = (F.length("name") >= shortest) & F.col("__ref").isNull() & F.col("error").isNull()
    met = named.where(long).join(full, (F.left("name", F.lit(shortest)) == F.col("__head")) & F.startswith(F.col("__sha"), F.col("name")))
    found = met.groupBy(F.col("rev").alias("__rev")).agg(F.count(F.lit(1)).alias("__n"), F.min("__sha").alias("__one"), F.max((F.col("__sha") == F.col("name")).cast("int")).alias("__whole"), F.max(F.when(F.col("__sha") == F.col("name"), F.col("__sha"))).alias("__same"))
    at = named.join(found, F.col("rev") == F.col("__rev"), "left")
    several = (F.col("__n") > 1) & (F.col("__whole") == 0)
    sha = F.coalesce("__ref", "__same", F.when(F.col("__n") == 1, F.col("__one")))
    start = at.select("rev", F.when(F.col("error").isNull(), sha).alias("sha"), "hops", F.coalesce("error", F.when(several, "ambiguous"), F.when(sha.isNull(), "unknown")).alias("error"))
    out = ancestors(graph, cut(start))
    return out.select("rev", F.col("ancestor").alias("sha"), F.coalesce("error", F.when(F.col("ancestor").isNull(), "not enough parents")).alias("error"))


def log(commits: DataFrame, only: DataFrame | None = None, no_merges: bool = False, since: Column | None = None, until: Column | None = None, author: str | None = None, limit: int | None = None) -> DataFrame:
    """Commits (among those of ``only`` (sha), where it is given) that pass the filters; with a limit the newest ones, ties by sha.

    since and until include their own moment; author is a pattern without case.
    """
    rows = commits if only is None else commits.join(only.select("sha"), "sha", "left_semi")
    if no_merges:
        rows = rows.where(F.coalesce(F.size("parents"), F.lit(0)) <= 1)
    if since is not None:
        rows = rows.where(F.col("time") >= since)
    if until is not None:
        rows = rows.where(F.col("time") <= until)
    if author is not None:
        rows = rows.where(F.col("author").rlike(f"(?i){author}"))
    return rows if limit is None else rows.orderBy(F.desc("time"), "sha").limit(limit)


def under(path: Column, specs: list[str]) -> Column:
    """Whether a path is one of the given ones or lies under it, without case; any path where none are given."""
    out = F.lit(not specs)
    for spec in specs:
        s = spec.rstrip("/").lower()
        out = out | (F.lower(path) == s) | F.lower(path).startswith(s + "/")
    return out


def show(commits: DataFrame, changes: DataFrame, shas: DataFrame, statuses: str = "", specs: tuple[str, ...] = ()) -> DataFrame:
    """(sha, author, time, message, files, added, deleted, changes) of some commits (sha): header, totals and changes by path.

    Only changes of the given status letters and paths count, where these are given; a commit without any is shown too.
    """
    own = changes.join(shas.select("sha").distinct(), "sha", "left_semi").where(under(F.col("path"), list(specs)))
    if statuses:
        own = own.where(F.instr(F.lit(statuses), F.col("status")) > 0)
    per = own.groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sort_array(F.collect_list(F.struct("path", "status", "added", "deleted"))).alias("changes"))
    head = commits.join(shas.select("sha").distinct(), "sha", "left_semi").select("sha", "author", "time", "message")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "added", "deleted")]
    return head.join(per, "sha", "left").select("sha", "author", "time", "message", *zero, F.coalesce("changes", F.array().cast("array<struct<path:string,status:string,added:bigint,deleted:bigint>>")).alias("changes"))


def _renames(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(old, path): files of equal content that went and came, paired in the order of their paths."""
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    return gone.select("hash", F.col("path").alias("old"), nth.alias("n")).join(come.select("hash", "path", nth.alias("n")), ["hash", "n"]).select("old", "path")


def status(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """(path, staged, unstaged, old) of files (path, hash) that differ between the last commit, the index and the folder.

    A added, M changed, D deleted, R renamed from old, ? unknown to the index; blank where a side has no change.
    """

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("path", F.col("hash").alias("before")).join(b.select("path", F.col("hash").alias("after")), "path", "full_outer")
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("s", F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").otherwise("M"))

    staged, unstaged = differ(head, index), differ(index, work)
    moved = _renames(staged.where("s = 'D'").select("path", F.col("before").alias("hash")), staged.where("s = 'A'").select("path", F.col("after").alias("hash")))
    staged = staged.select("path", "s").join(moved.select("path", "old"), "path", "left").withColumn("s", F.when(F.col("old").isNotNull(), "R").otherwise(F.col("s")))
    staged = staged.join(moved.select(F.col("old").alias("path")), "path", "left_anti").withColumnRenamed("s", "staged")
    unstaged = unstaged.select("path", F.when(F.col("s") == "A", "?").otherwise(F.col("s")).alias("unstaged"))
    both = staged.join(unstaged, "path", "full_outer")
    unknown = F.coalesce(F.col("unstaged") == "?", F.lit(False)) & F.col("staged").isNull()
    return both.select("path", F.when(unknown, "?").otherwise(F.coalesce("staged", F.lit(" "))).alias("staged"), F.coalesce("unstaged", F.lit(" ")).alias("unstaged"), "old")
