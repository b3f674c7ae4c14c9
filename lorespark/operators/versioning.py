"""Branch-versioned records: upserts, deletes, expiry, changes and conflicts.

Tables are copied on write; keys are (repository_url, branch_name, id) unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.scoring import conflict_severity
from lorespark.operators.documents import last_of

# --- fixed values: seconds that records of a branch in some state are kept
TTL = {"active": 30 * 86400, "merged": 30 * 86400, "stale": 7 * 86400, "deleted": 86400}
BRANCH_FIELDS = ("branch_name", "branch", "git_context.branch_name", "git_context.branch", "metadata.branch", "partition.branch")
# --- end of fixed values
KEY = ["repository_url", "branch_name", "id"]


def ttl_of(state: Column) -> Column:
    out = F.lit(TTL["stale"])
    for name, seconds in TTL.items():
        out = F.when(state == name, seconds).otherwise(out)
    return out


def upsert(table: DataFrame, changes: DataFrame, now: Column, keys: list[str] = KEY, ttl: int | None = None) -> DataFrame:
    """Rows of changes replace those with their keys; created_at stays what it was."""
    old = table.select(*keys, F.col("created_at").alias("__created"))
    new = changes.join(old, keys, "left").withColumn("created_at", F.coalesce("__created", now)).withColumn("updated_at", now).drop("__created")
    if ttl is not None:
        new = new.withColumn("ttl", F.lit(ttl))
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def on_branch(table: DataFrame, repository: str, branch: str, extra: str | None = None) -> DataFrame:
    """One partition; extra is a further SQL condition."""
    out = table.filter((F.col("repository_url") == repository) & (F.col("branch_name") == branch))
    return out if extra is None else out.filter(extra)


def across_branches(table: DataFrame, repository: str, branches: list[str] | None = None, extra: str | None = None) -> DataFrame:
    out = table.filter(F.col("repository_url") == repository)
    out = out if branches is None else out.filter(F.col("branch_name").isin(branches))
    return out if extra is None else out.filter(extra)


def unexpired(table: DataFrame, now: Column) -> DataFrame:
    """Rows without a ttl never expire."""
    return table.filter(F.col("ttl").isNull() | (F.col("updated_at") + F.make_dt_interval(secs=F.col("ttl")) > now))


def marked_for_cleanup(table: DataFrame, repository: str, branch: str, state: str, now: Column) -> DataFrame:
    here = (F.col("repository_url") == repository) & (F.col("branch_name") == branch)
    return table.withColumn("ttl", F.when(here, ttl_of(F.lit(state))).otherwise(F.col("ttl"))).withColumn("updated_at", F.when(here, now).otherwise(F.col("updated_at")))


def purged(table: DataFrame, repository: str, branch: str) -> DataFrame:
    """Without the rows of a branch, whichever of the known fields names it."""
    names = [f for f in BRANCH_FIELDS if f.split(".")[0] in table.columns]
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(f) == branch, F.lit(False)) for f in names), F.lit(False))
    return table.filter(~(hit & F.coalesce(F.col("repository_url") == repository, F.lit(False))))


def soft_deleted(entities: DataFrame, paths: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities with deleted_at for those of the paths, audit rows)."""
    gone = entities.join(paths.select("path").distinct().withColumn("__gone", F.lit(True)), "path", "left")
    marked = gone.withColumn("deleted_at", F.when(F.col("__gone"), now)).drop("__gone")
    audit = marked.filter("deleted_at is not null").select(F.col("id").alias("entity_id"), F.lit("soft_delete").alias("operation"), "deleted_at")
    return marked, audit


def cascade(deleted: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes with deleted file versions (id): their entities, and the edges with either end among these."""
    gone = entities.join(deleted.select(F.col("id").alias("file_version_id")), "file_version_id", "left_semi")
    ends = gone.select(F.col("id").alias("end")).distinct()
    by_source = edges.join(ends, F.col("source_id") == F.col("end"), "left_semi")
    by_target = edges.join(ends, F.col("target_id") == F.col("end"), "left_semi")
    return gone, by_source.unionByName(by_target).distinct()


def latest_commits(states: DataFrame) -> DataFrame:
    """The last commit of every branch."""
    return last_of(states, ["repository_url", "branch_name"], [F.col("committed_at"), F.col("sha")])


def commits_since(commits: DataFrame, sha: str | None) -> DataFrame:
    """Those after the given one, oldest first; all of them if it is unknown."""
    if sha is not None:
        found = commits.filter(F.col("sha") == sha).agg(F.max("sequence").alias("__at"))
        commits = commits.join(F.broadcast(found), (F.col("sequence") > F.col("__at")) | F.col("__at").isNull()).drop("__at")
    return commits.orderBy("sequence")


def changed_paths(changes: DataFrame) -> DataFrame:
    """(path, action) of changes (change_type, old_path, path): a rename deletes the old path and adds the new one."""
    renamed = F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("action")), F.struct(F.col("path").alias("path"), F.lit("update").alias("action")))
    kind = F.col("change_type")
    one = F.array(F.struct(F.col("path").alias("path"), F.when(kind == "D", "delete").otherwise("update").alias("action")))
    return changes.select(F.explode(F.when(kind == "R", renamed).otherwise(one)).alias("c")).select("c.path", "c.action").distinct()


def incremental(entities: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities of changed paths replaced by the freshly extracted ones."""
    return entities.join(changed_paths(changes).select("path").distinct(), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_conflicts(changes: DataFrame, source: str, target: str) -> DataFrame:
    """Paths changed on both branches since they parted; severity by their number."""
    both = changes.filter(F.col("branch_name").isin(source, target)).groupBy("path").agg(F.max((F.col("branch_name") == source).cast("int")).alias("s"), F.max((F.col("branch_name") == target).cast("int")).alias("t")).filter("s = 1 and t = 1").select("path")
    return both


def conflict_summary(changes: DataFrame, source: str, target: str) -> DataFrame:
    return merge_conflicts(changes, source, target).agg(F.count(F.lit(1)).alias("conflicts")).withColumn("severity", conflict_severity(F.col("conflicts")))


def branch_states(branches: DataFrame, now: Column) -> DataFrame:
    """Branches with the seconds that are left to them."""
    left = ttl_of(F.col("state")) - (F.unix_seconds(now) - F.unix_seconds("last_activity"))
    return branches.withColumn("seconds_left", F.greatest(F.lit(0), left)).withColumn("expired", left <= 0)
