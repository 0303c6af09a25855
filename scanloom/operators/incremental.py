"""Processing only what is new or changed since the last successful run.

Current records and the state saved by the last run are compared as Merkle trees over ranges of the
key's hash.  Only leaves whose digests differ are opened; the changed records in them are extracted.
``IncrementalStore`` reads the current records once, then publishes a run's output, the entries and nodes of the key
ranges that changed, together by one atomic step, so a run that fails anywhere leaves the last published version in
force, and a record that arrives during a run is left to the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.functions.paths import path_form
from scanloom.operators import merkle
from scanloom.workdir import delete, exists, materialise


def hash_form(value: Column) -> Column:
    """A content hash in lower case without the ``sha256:`` prefix."""
    return F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")


def is_json_array(text: Column) -> Column:
    """Whether the whole text is one JSON array; null and truncated texts are none.

    The text is parsed as a member of an object, so that anything after the array fails.  An object that
    names a member twice counts as not parsing.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"w":1}')))
    return F.coalesce(text.rlike(r"^[ \t\r\n]*\[") & (F.try_variant_get(whole, "$.w", "int") == 1), F.lit(False))


def current_versions(source: DataFrame) -> DataFrame:
    """file_path, content_hash of each file's version with the latest ``modified_at``, deleted ones left out.

    Ties of ``modified_at`` go to the later delivery.  A null path is no file; a null flag means not deleted.
    """
    return (
        source.where("file_path is not null")
        .groupBy(path_form(F.col("file_path")).alias("file_path"))
        .agg(
            F.max_by(
                F.struct(hash_form(F.col("content_hash")).alias("content_hash"), F.coalesce("is_deleted", F.lit(False)).alias("gone")),
                F.struct("modified_at", "delivered_at"),
            ).alias("v")
        )
        .where("not v.gone")
        .select("file_path", "v.content_hash")
    )


def finished_versions(cache: DataFrame) -> DataFrame:
    """file_path, content_hash of each file's finished row with the latest ``cached_at``."""
    return (
        cache.where("file_path is not null")
        .select(path_form(F.col("file_path")).alias("file_path"), hash_form(F.col("content_hash")).alias("content_hash"), "cached_at", is_json_array(F.col("vulns_json")).alias("ok"))
        .where("ok")
        .groupBy("file_path")
        .agg(F.max_by(F.struct("content_hash"), F.struct("cached_at", "content_hash")).alias("v"))
        .select("file_path", "v.content_hash")
    )


def keyed(df: DataFrame, key: str, value: str, coll: str, depth: int) -> DataFrame:
    """Rows in the form the trees need: coll, depth, node, key, value, h1, h2."""
    h1, h2 = merkle.digest(F.col(key), F.col(value))
    return df.select(
        F.lit(coll).alias("coll"), F.lit(depth).alias("depth"), merkle.node_at(F.xxhash64(key), F.lit(depth)).alias("node"),
        F.col(key).alias("key"), F.col(value).alias("value"), h1.alias("h1"), h2.alias("h2"),
    )


_PAIR = "pair int, cur string, prev string"


def differing_nodes(current: DataFrame, saved: DataFrame, spark: SparkSession, depth: int, current_tree: DataFrame | None = None, saved_tree: DataFrame | None = None) -> DataFrame:
    """node: the leaves in which ``current`` and ``saved`` (``keyed``) differ; trees that are known may be given."""
    if current_tree is None and saved_tree is None:
        nodes = merkle.tree(merkle.leaves(current.unionByName(saved)), depth)
    else:
        sides = [merkle.tree(merkle.leaves(rows), depth) if t is None else t for rows, t in ((current, current_tree), (saved, saved_tree))]
        nodes = sides[0].unionByName(sides[1])
    pairs = spark.createDataFrame([(0, "current", "saved")], _PAIR)
    return merkle.differing_leaves(materialise(nodes, "tree"), pairs, depth).select("node")


def changed_in(current: DataFrame, saved: DataFrame, dirty: DataFrame) -> DataFrame:
    """key, value: keys of ``current`` that ``saved`` lacks or has with another value, looked for in the leaves ``dirty`` alone."""
    both = current.unionByName(saved).join(dirty, "node", "left_semi")
    is_cur = F.col("coll") == "current"
    return (
        both.groupBy("key")
        .agg(F.count_if(is_cur).alias("n"), F.max(F.when(is_cur, F.col("value"))).alias("value"), F.count_if(~is_cur).alias("m"), F.max(F.when(~is_cur, F.col("value"))).alias("old"))
        .where("n > 0 and (m = 0 or not (value <=> old))")
        .select("key", "value")
    )


def unprocessed_files(source: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose current version no finished run has: file_path, content_hash, each file once.

    ``source``: file_path, content_hash, modified_at, delivered_at, is_deleted; ``cache``: file_path,
    content_hash, vulns_json, cached_at.  Other columns are ignored.  Empty sources give no rows; an empty
    cache gives every current file; null hashes equal each other only.
    """
    spark = source.sparkSession
    current = materialise(current_versions(source), "current")
    depth = merkle.depth_for(current.count())
    current = keyed(current, "file_path", "content_hash", "current", depth)
    saved = materialise(keyed(finished_versions(cache), "file_path", "content_hash", "saved", depth), "saved")
    return changed_in(current, saved, differing_nodes(current, saved, spark, depth)).select(F.col("key").alias("file_path"), F.col("value").alias("content_hash"))


#: Runs whose deltas are read together; the next one writes everything anew.
MAX_CHAIN = 16


class IncrementalStore:
    """Entries, tree and output of successive runs under one folder.

    ``root/v-N-<id>/{entries,leaves,nodes,output}`` hold what run N made: the entries of the leaves that changed, the
    numbers of those leaves and the nodes whose digests changed.  ``root/_committed/N.json`` names the folders that
    together give the state (the last full one and the deltas since).  Creating the N-th commit file, which fails if it
    exists, is the only step that publishes, so a run that stops before it has no effect, and two runs at once can't
    both publish.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the last published run; 0 if none."""
        fs, p = self._fs(f"{self.root}/_committed")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        row = self.spark.read.text(f"{self.root}/_committed/{version}.json", wholetext=True).first()
        return json.loads(row[0])

    def output(self) -> DataFrame | None:
        """Everything published so far, one output folder per run."""
        at = [self.manifest(v)["folder"] + "/output" for v in range(1, self.version() + 1)]
        at = [p for p in at if exists(self.spark, p)]
        return self.spark.read.parquet(*at) if at else None

    def _chain(self, part: str, version: int) -> DataFrame:
        """Rows of one part of the folders that give a version's state, with the folder's place as ``at``."""
        folders = self.manifest(version)["chain"]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{f}/{part}").withColumn("at", F.lit(n)) for n, f in enumerate(folders)])

    def entries(self) -> DataFrame | None:
        """node, key, value, h1, h2 of the last published state; None before the first run.

        A leaf's entries are those of the latest folder that lists it.
        """
        n = self.version()
        if not n:
            return None
        rows = self._chain("entries", n)
        if len(self.manifest(n)["chain"]) == 1:
            return rows.drop("at")
        last = self._chain("leaves", n).groupBy("node").agg(F.max("at").alias("at"))
        return rows.join(last, ["node", "at"], "left_semi").drop("at")

    def _tree(self, version: int) -> DataFrame:
        rows = self._chain("nodes", version)
        if len(self.manifest(version)["chain"]) > 1:
            rows = rows.groupBy("level", "node").agg(F.max_by(F.struct("depth", "d1", "d2"), "at").alias("v")).select("level", "node", "v.*").where("d1 is not null")
        return rows.select(F.lit("saved").alias("coll"), "depth", "node", "d1", "d2", "level")

    def run(self, current: DataFrame, key: str, value: str, process: Callable[[DataFrame], DataFrame]) -> int:
        """Give ``process`` the new and changed records of ``current``; publish what it returns.

        ``current`` holds each key once, with ``value`` its version; it is read once, before anything else.  Returns the
        new version's number.  The tree's depth stays that of the first run unless the record count has outgrown it.
        """
        n, spark = self.version(), self.spark
        old = self.manifest(n) if n else None
        folder = f"{self.root}/v-{n + 1}-{uuid.uuid4().hex[:8]}"
        current = materialise(current, "current")
        fit = merkle.depth_for(current.count())
        depth = max(fit, old["depth"]) if old else fit
        now = keyed(current, key, value, "current", depth)
        tree = materialise(merkle.tree(merkle.leaves(now), depth), "nodes").select("coll", "depth", "node", "d1", "d2", "level")
        saved, saved_tree = now.limit(0), tree.limit(0)
        if old:
            saved = self.entries().select(F.lit("saved").alias("coll"), F.lit(depth).alias("depth"), "node", "key", "value", "h1", "h2")
            if old["depth"] == depth:
                saved_tree = materialise(self._tree(n), "nodes")
            else:
                saved, saved_tree = materialise(keyed(saved, "key", "value", "saved", depth), "saved"), None
        dirty = materialise(differing_nodes(now, saved, spark, depth, tree, saved_tree), "dirty")
        changed = changed_in(now, saved, dirty)
        todo = current.join(changed.select(F.col("key").alias(key)), key, "left_semi")
        delta = bool(old) and old["depth"] == depth and len(old["chain"]) < MAX_CHAIN
        entries, leaves, nodes = now, now.select("node").distinct(), tree
        if delta:
            entries, leaves = now.join(dirty, "node", "left_semi"), dirty
            was = saved_tree.select("level", "node", F.lit(depth).alias("_depth"), F.col("d1").alias("_1"), F.col("d2").alias("_2"))
            nodes = tree.join(was, ["level", "node"], "full_outer").where("not (d1 <=> _1 and d2 <=> _2)").withColumn("depth", F.coalesce("depth", "_depth"))
        try:
            process(todo).write.parquet(f"{folder}/output")
            entries.select("node", "key", "value", "h1", "h2").write.parquet(f"{folder}/entries")
            leaves.select("node").write.parquet(f"{folder}/leaves")
            nodes.select("depth", "level", "node", "d1", "d2").write.parquet(f"{folder}/nodes")
            self._publish(n + 1, {"folder": folder, "depth": depth, "chain": [*old["chain"], folder] if delta else [folder]})
        except BaseException:
            delete(spark, folder)
            raise
        return n + 1

    def _publish(self, version: int, manifest: dict) -> None:
        """Write the manifest beside its place and move it there; the move fails if the place is taken."""
        path = self._jvm.org.apache.hadoop.fs.Path
        fs, tmp = self._fs(f"{self.root}/_staged-{uuid.uuid4().hex}.json")
        fs.mkdirs(path(f"{self.root}/_committed"))
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(tmp), fs.makeQualified(path(f"{self.root}/_committed/{version}.json")), options)
