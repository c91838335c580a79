"""The trie of conversation prefixes by prefix-doubling names.

Turns get dense numbers, then blocks of two, four, eight turns: a block's number names the pair of its halves. A prefix of
d turns is the blocks of d's binary digits, so two prefixes are equal if these few numbers are. Nodes are groups of equal prefixes.

Sums over subtrees need no walk: a conversation owns the nodes whose smallest member it is, a stretch at the end of its
own path; what a node's members own at and below its depth, added up, is the subtree.

No step gathers a conversation, a group of copies or a first turn in one task: places in a conversation come from a global sort,
numbers of frequent keys are broadcast (fewer than keyed.HOT of them), and sums along a path go by stretches of STRETCH turns.

Edge cases: null turns come first; turns that repeat a number are ordered by role and then by a hash of their text, so equal rows
stay and count twice; null role or text is empty; rows without conv_id belong to no conversation and are left out; conv_id % 5 has the sign
of conv_id, as in SQL; an empty table has no node, not even a root. Role and text are compared by SHA-256 of both. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc
from clauseframe.llm.keyed import named, numbered

STRETCH = 4096
#: Turns from another conversation, at most.
MOST_TAKEN = 8


def rebuilt(conversations: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 0, digest, bytes, size) of the turns of all rebuilt conversations, and (conv_id, size), turnless ones too; both written.

    A conversation begins with the first h turns of the one at the multiple of five at or before it, h by a hash, and goes on with
    its own turns after its first h.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.octet_length(text).cast("long").alias("bytes"), digest.alias("digest"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # every turn gets its place in the order of the whole table; a conversation may lie over many partitions
    turns = turns.where("conv_id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    turns = tc.written(numbered(turns.select("conv_id", "digest", "bytes"), "place", spark)[0], spark)
    convs = tc.written(turns.groupBy("conv_id").agg(F.min("place").alias("begins"), F.count("*").alias("n")), spark)
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = convs.selectExpr("*", "crc32(string(conv_id)) % 9 AS h", "conv_id - conv_id % 5 AS base").join(base, "base", "left")
    convs = convs.withColumn("taken", F.expr("least(h, coalesce(there, 0L))")).withColumn("size", F.expr("taken + greatest(n - h, 0L)"))
    convs = tc.written(convs.select("conv_id", "begins", "n", "h", "taken", "size"), spark)
    # joined by stretches of the table, so that a long conversation isn't one key
    stretches = convs.withColumn("stretch", F.explode(F.expr(f"sequence(begins div {STRETCH}, (begins + n - 1) div {STRETCH})")))
    placed = turns.withColumn("stretch", F.expr(f"place div {STRETCH}")).join(stretches, ["conv_id", "stretch"]).withColumn("pos", F.expr("place - begins"))
    own = placed.where("pos >= h").selectExpr("conv_id", "pos - h + taken AS pos", "digest", "bytes", "size")
    given = placed.where(f"conv_id % 5 = 0 AND pos < {MOST_TAKEN}").select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    given = given.withColumn("conv_id", F.explode(F.expr("transform(sequence(-4L, 4L), k -> try_add(base, k))"))).where("conv_id - conv_id % 5 = base")
    given = given.join(convs.select("conv_id", "h", "size"), "conv_id").where("pos < h")
    return tc.written(own.unionByName(given.select("conv_id", "pos", "digest", "bytes", "size")), spark), convs.select("conv_id", "size")


def prefixes(turns: DataFrame, convs: DataFrame, spark: SparkSession) -> DataFrame:
    """(conv_id, depth, names, bytes, size) for each prefix of each conversation: equal prefixes have equal depths and names.

    Round k names blocks of 2**k turns that begin at a multiple of it, by the names of their halves. A prefix gets one name for each binary digit of its depth.
    """
    longest = convs.agg(F.max("size")).first()[0] or 0
    blocks = tc.written(named(turns, ["digest"], "name", spark).select("conv_id", F.col("pos").alias("j"), "name", "size", "bytes"), spark)
    none = F.lit(None).cast("struct<level:int,name:long>")
    parts = blocks.selectExpr("conv_id", "j + 1 AS depth", "bytes", "size").withColumn("part", none)
    for k in range(longest.bit_length()):
        if k:
            pairs = blocks.where(f"shiftleft((j | 1L) + 1, {k - 1}) <= size").groupBy("conv_id", F.expr("j div 2").alias("j"))
            pairs = tc.written(pairs.agg(F.max(F.expr("if(j % 2 = 0, name, null)")).alias("left"), F.max(F.expr("if(j % 2 = 1, name, null)")).alias("right"), F.first("size").alias("size")), spark)
            blocks = tc.written(named(pairs, ["left", "right"], "name", spark).select("conv_id", "j", "name", "size"), spark)
        # an even block is the last or an inner part of the prefixes from its end on, up to the end of its neighbour
        ends = blocks.where("j % 2 = 0").selectExpr("conv_id", "size", f"shiftleft(j + 1, {k}) AS lo", f"least(size, shiftleft(j + 2, {k}) - 1) AS hi", f"named_struct('level', {-k}, 'name', name) AS part")
        ends = ends.withColumn("lo", F.explode(F.expr(f"sequence(lo, hi, {STRETCH}L)")))
        if 2**k > STRETCH:
            ends = ends.repartition("conv_id", "lo")
        ends = ends.withColumn("depth", F.explode(F.expr(f"sequence(lo, least(hi, lo + {STRETCH - 1}))")))
        parts = parts.unionByName(ends.select("conv_id", "depth", F.lit(None).cast("long").alias("bytes"), "size", "part"))
    whole = parts.groupBy("conv_id", "depth").agg(F.expr("transform(sort_array(collect_list(part)), p -> p.name)").alias("names"), F.max("bytes").alias("bytes"), F.first("size").alias("size"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.expr("cast(array() AS array<bigint>)").alias("names"), F.lit(0).cast("long").alias("bytes"), "size")
    return tc.written(whole.unionByName(roots), spark)


def _chunks(batches):
    """Of (node, conv_id) in order: the conv_ids of a node as text, many at a time."""
    for batch in batches:
        nodes, ids = batch.column("node").to_numpy(), batch.column("conv_id").to_pylist()
        cut = [0, *(i for i in range(1, len(ids)) if nodes[i] != nodes[i - 1]), len(ids)]
        rows = [(int(nodes[a]), ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cut, cut[1:]) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["node", "first", "ids"])


def _hashes(batches):
    """Of chunks in order, a hash for each node; only its state is kept."""
    node, state = None, None
    for batch in batches:
        done = []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def member_hashes(members: DataFrame) -> DataFrame:
    """(node, conv_id) -> (node, ends_sha256): the hash of each node's conv_ids in order, joined by commas.

    Sorted over all tasks, the conv_ids become chunks of text; the task that hashes a node reads a row for each chunk.
    """
    chunks = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunks, "node long, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node long, ends_sha256 string")


def trie(paths: DataFrame, spark: SparkSession) -> DataFrame:
    """prefixes -> a row for each node, by its smallest member and depth."""
    paths = paths.withColumn("ends", F.expr("int(depth = size)"))
    paths = named(paths, ["depth", "names"], "node", spark, n_convs=F.count("*"), owner=F.min("conv_id"), n_ends=F.sum("ends"))
    paths = tc.written(paths.select("conv_id", "depth", "node", "n_convs", "owner", "ends", F.expr("if(owner = conv_id, (n_convs - 1) * bytes, 0L)").alias("saved"), F.expr("int(owner = conv_id AND n_ends = n_convs)").alias("leaf"), F.expr(f"depth div {STRETCH}").alias("stretch")), spark)
    own = paths.where("owner = conv_id")
    above = paths.selectExpr("conv_id", "depth + 1 AS depth", "node AS parent", "owner AS parent_conv_id")
    nodes = tc.written(own.select("node", "conv_id", "depth", "n_convs").join(above, ["conv_id", "depth"], "left"), spark)
    # what a conversation owns at a place of its path and below it: in the place's stretch, and in those after it
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = paths.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    stretches = stretches.select("conv_id", "stretch", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("more"), F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaves"))
    here = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = paths.join(stretches, ["conv_id", "stretch"]).select("node", (F.col("more") + F.sum("saved").over(here)).alias("saved"), (F.col("leaves") + F.sum("leaf").over(here)).alias("leaf"), F.lit(0).alias("child"))
    children = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(0).alias("saved"), F.lit(0).alias("leaf"), F.lit(1).alias("child"))
    sums = below.unionByName(children).groupBy("node").agg(F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = member_hashes(paths.where("ends = 1").select("node", "conv_id"))
    out = nodes.join(sums, "node").join(ends, "node", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> the nodes of the trie of rebuilt conversations."""
    turns, convs = rebuilt(conversations, spark)
    return trie(prefixes(turns, convs, spark), spark)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(tc.read_table(spark, sf_dir, "conversations"), spark)


# crc32 byte by byte: -1 stands for one step of its shift register, other numbers for a byte
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], flatten([[ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"

SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
u AS (SELECT c.conv_id, 0 AS src, pos, turn FROM c JOIN t ON t.conv_id = c.base AND pos < h UNION ALL SELECT c.conv_id, 1, pos, turn FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
r AS (SELECT conv_id, coalesce(list(turn ORDER BY src, pos) FILTER (pos IS NOT NULL), []) AS turns FROM c LEFT JOIN u USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, len(turns) AS n, depth, turns[1:depth] AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM r)),
v AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ids,
  CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(prefix[-1].text) END AS saved FROM p GROUP BY depth, prefix),
k AS (SELECT a.depth, a.prefix, min(b.conv_id) AS parent_conv_id FROM v a JOIN v b ON b.depth = a.depth - 1 AND b.prefix = a.prefix[1:a.depth - 1] GROUP BY ALL),
m AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN m ON m.depth = v.depth AND m.prefix = v.prefix),
s AS (SELECT a.depth, a.prefix, sum(b.saved) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM w a JOIN w b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY ALL)
SELECT w.conv_id, w.depth, k.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.prefix = w.prefix LEFT JOIN k ON k.depth = w.depth AND k.prefix = w.prefix
"""
