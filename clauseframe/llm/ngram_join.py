"""Exact Jaccard self-join on word shingles, as a token-group matrix.

Similar documents are put into groups, every group keeps the union of its tokens, and a document is held
only against the groups whose union covers enough of it; just those are opened and compared set by set.

How no link is lost while most documents never leave their own row:

* Two sets with J >= t overlap in at least t times the larger one. With one global token order (the hash),
  the first |A| - ceil(t|A|) + l tokens of either set then share l tokens, for every l. Each document emits
  these with l = 1 + floor(.05|A|). Tokens that one document alone emits cannot link, and a document that
  keeps fewer than 1 + floor(.05 t |A|) emitted tokens has no partner (t|A| is a partner's least size).
* What is left is collapsed by the digest of the set (equal sets are one node), and tested again with longer
  prefixes (l = 1 + floor(.25|A|)).
* Groups: documents that share a least token under one of several hash orders are compared inside chunks of
  bounded size (a hot key is salted into many chunks, and gets a second turn with its most central
  documents in each); links found give the first components.
* Token-group matrix: components are cut into groups of bounded size. Tokens of one component alone cannot link it to
  another; with these first and the rest by their number of documents, the larger set of a linked pair shares
  one of its first |A| - ceil(t|A|) + 1 tokens with the first |B| - ceil(2t|B| / (1 + t)) + 1 of the smaller. The
  matrix has the groups of the latter tokens; a document that meets a group of another component there is held against the
  union of all the group's tokens, and opens it if the union covers t|A| of its tokens. The members of an opened
  group are compared exactly, in the group's own task, until one links. Pairs inside one component need no test, as they are connected already.

Tokens are 64-bit hashes of shingles. Equal hashes count as equal shingles.

Edge cases: null or blank text has no shingle, links with nothing and is its own component; fewer than five words are
one shingle; rows with the same doc_id are one node of the graph, and each such row is returned; a null doc_id
gives a null component and links nothing; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc
from clauseframe.llm.components import connected_components

CHUNK_DOCS, CHUNK_TOKENS = 128, 500_000
ORDERS = 4
CENTRES = 8
QUERIES = 256
BROADCAST_IDS = 4_000_000  # 32 MB of ids; beyond it the join is shuffled


def _sets(column):
    for _, _, data, offsets in tc.text_blocks(column):
        words, counts = tc.word_hashes(data, offsets)
        yield tc.sorted_sets(*tc.shingle_hashes(words, counts))


def _missable(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that a linked set can lack."""
    return n - -(-percent * n // 100)


def _cut(tokens: np.ndarray, at: np.ndarray, take: np.ndarray) -> pa.ListArray:
    """The first take[i] tokens of each set."""
    ends = np.concatenate([[0], np.cumsum(take)])
    where = np.repeat(at[:-1] - ends[:-1], take) + np.arange(int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[where]))


def _prefix(n: np.ndarray, percent: int, slack: float) -> np.ndarray:
    return np.minimum(n, np.where(n > 0, _missable(n, percent) + 1 + np.floor(slack * n).astype(np.int64), 0))


def _needed(slack: float, percent: int):
    return lambda n: F.lit(1) + F.floor(F.lit(slack * percent / 100) * F.col(n))


def _emit_prefixes(percent: int, slack: float):
    def run(batches):
        tc.release()
        for batch in batches:
            row = 0
            for tokens, at in _sets(batch.column("text")):
                n = np.diff(at)
                ids = batch.column("doc_id").slice(row, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), _cut(tokens, at, _prefix(n, percent, slack))], ["doc_id", "n", "tokens"])
                row += len(n)

    return run


def _emit_sets(batches):
    """Size and digest for every row; the set itself only where `wanted`."""
    tc.release()
    for batch in batches:
        row = 0
        for tokens, at in _sets(batch.column("text")):
            n = np.diff(at)
            ids, wanted = (batch.column(c).slice(row, len(n)) for c in ("doc_id", "wanted"))
            keep = np.where(wanted.to_numpy(zero_copy_only=False).astype(bool), n, 0)
            digests = [hashlib.blake2b(tokens[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if keep[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digests, pa.binary()), _cut(tokens, at, keep)], ["doc_id", "n", "digest", "tokens"])
            row += len(n)


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as arrays; nothing is copied."""
    lists = column.combine_chunks()
    at, flat = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _overlap(x: np.ndarray, y: np.ndarray, percent: int) -> int | None:
    """Common tokens of two sorted sets; None if their sizes alone rule a link out."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return None
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _local_links(percent: int):
    def run(key, table):
        """A chunk's links, found with as few comparisons as its components need, and its most central node.

        The centre, whose tokens most of the chunk has, is a row without v; centres are compared first.
        """
        tc.release()
        nodes, sets = table.column("node").to_pylist(), _rows(table.column("tokens"))
        # a centre may stand in its own chunk again; rows of one doc_id with other texts stay
        once: dict[tuple[int, bytes], int] = {}
        for i in np.lexsort((nodes, -table.column("first").to_numpy())).tolist():
            once.setdefault((nodes[i], sets[i].tobytes()), i)
        nodes, sets = [nodes[i] for i in once.values()], [sets[i] for i in once.values()]
        parent = list(range(len(nodes)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        found = []
        for i in range(1, len(nodes)):
            for j in range(i):
                a, b = root(i), root(j)
                if a == b:
                    continue
                both = _overlap(sets[i], sets[j], percent)
                if both is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(a, b)] = min(a, b)
                    found.append((nodes[i], nodes[j], None))
        tokens, often = np.unique(np.concatenate(sets), return_counts=True)
        central = [often[np.searchsorted(tokens, x)].mean() for x in sets]
        best = int(np.argmax(central))
        found.append((nodes[best], None, central[best] / len(sets)))
        u, v, score = zip(*found)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "central": pa.array(score, pa.float64()), "chunk": pa.repeat(key[0], len(found))})

    return run


def _cross_links(percent: int):
    def run(table):
        """One link of each query to a member of the opened group, if there is any: the members are one component already."""
        tc.release()
        nodes, sets, member = table.column("node").to_pylist(), _rows(table.column("tokens")), np.array(table.column("member").to_pylist())
        found = []
        for i in np.flatnonzero(~member):
            for j in np.flatnonzero(member):
                both = _overlap(sets[i], sets[j], percent)
                if both is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    found.append((nodes[i], nodes[j]))
                    break
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _small(df: DataFrame, spark: SparkSession, rows: int | None = None) -> DataFrame:
    """A slim table, written once; broadcast only if its number of rows is within the bound. rows: as for in_few_files."""
    df = tc.written(df if rows is None else tc.in_few_files(df, rows), spark)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _shared(tokens: DataFrame, need) -> DataFrame:
    """Nodes of (node, n, token) that keep enough tokens which another node has too."""
    common = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    kept = tokens.join(common, "token", "left_semi").groupBy("node", "n").agg(F.count("*").alias("c"))
    return kept.where(F.col("c") >= need("n")).select("node")


def _parts(spark: SparkSession, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part) for all nodes: the smallest node that each is linked to, by any path."""
    found = connected_components(spark, links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def _joined(spark: SparkSession, parts: DataFrame, owned: DataFrame, links: DataFrame, n_rows: int) -> DataFrame:
    """(node, part) for the nodes of both tables, after links between the parts: components are joined as wholes, their own links are not looked at again."""
    parts = parts.select("node", "part")
    for end in ("u", "v"):
        links = links.join(parts.select(F.col("node").alias(end), "part"), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    found = _small(connected_components(spark, links).select(F.col("node").alias("part"), "component"), spark, n_rows)
    others = owned.select("node").distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("part"))
    return parts.union(others).join(found, "part", "left").select("node", F.coalesce("component", "part").alias("part"))


def _grouped_links(spark: SparkSession, nodes: DataFrame, percent: int) -> DataFrame:
    """Links inside chunks of nodes that share a least token in one of several orders.

    A key with more than one chunk gets a second turn, in which the centres of its chunks stand in every chunk: what
    lies around one centre is then connected, wherever its parts were dealt.
    """
    orders = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"array_min(transform(tokens, x -> xxhash64(x, {k})))").alias("key")) for k in range(ORDERS)])
    keyed = tc.written(nodes.select("node", "n", F.explode(orders).alias("o")).select("node", "n", "o.k", "o.key"), spark)
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1")
    chunks = F.greatest(F.ceil(F.col("c") / CHUNK_DOCS), F.ceil(F.col("s") / CHUNK_TOKENS))
    placed = keyed.drop("n").join(sizes.select("k", "key", chunks.alias("chunks")), ["k", "key"]).select("node", "k", "key", "chunks", F.xxhash64("k", "key", F.pmod(F.xxhash64("node", "k"), "chunks")).alias("chunk"), F.lit(0).alias("first"))
    rows_placed = ORDERS * nodes.count()
    placed = tc.written(tc.in_few_files(placed, rows_placed), spark)
    schema = "u long, v long, central double, chunk long"

    def turn(rows: DataFrame) -> DataFrame:
        rows = _small(rows.select("node", "chunk", "first"), spark, rows_placed)
        return tc.written(nodes.select("node", "tokens").join(rows, "node").groupBy("chunk").applyInArrow(_local_links(percent), schema), spark)

    found = turn(placed)
    links = found.where("v IS NOT NULL").select("u", "v")
    many = placed.where("chunks > 1")
    if not many.isEmpty():
        dealt = many.select("k", "key", "chunk").distinct()
        centres = found.where("v IS NULL").join(dealt, "chunk").groupBy("k", "key", F.pmod("chunk", F.lit(CENTRES)).alias("slice")).agg(F.max_by("u", F.struct("central", "u")).alias("node"))
        again = many.select("node", "chunk", "first").union(centres.join(dealt, ["k", "key"]).select("node", "chunk", F.lit(1).alias("first")))
        links = links.union(turn(again).where("v IS NOT NULL").select("u", "v"))
    return links


def _open_links(spark: SparkSession, grouped: DataFrame, percent: int) -> DataFrame:
    """The token-group matrix: links between components. grouped: (node, n, tokens, part, group)."""
    tokens = grouped.select("node", "n", "part", "group", F.explode("tokens").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("token", "f")
    ranked = tokens.join(known, "token").groupBy("node", "n", "part", "group").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("open"))
    # tokens of one component alone come first in the order, then the others by their number of documents
    for name, least in (("probe", f"ceil({percent} * n / 100)"), ("index", f"ceil({2 * percent} * n / {100 + percent})")):
        ranked = ranked.withColumn(name, F.expr(f"transform(slice(open, 1, cast(greatest(0, n - {least} + 1 - (n - size(open))) as int)), x -> x.token)"))
    ranked = tc.written(ranked.where("size(probe) > 0").select("node", "n", "part", "group", "probe", "index"), spark)
    matrix = ranked.select(F.explode("index").alias("token"), F.col("group").alias("other")).distinct()
    near = ranked.select("node", "n", "part", F.explode("probe").alias("token")).join(matrix, "token").where("part <> other.part").select("node", "n", "other").distinct()
    near = tc.written(near, spark)
    unions = grouped.join(near.select(F.col("other").alias("group")).distinct(), "group", "left_semi").select(F.col("group").alias("other"), F.explode("tokens").alias("token")).groupBy("other").agg(F.collect_set("token").alias("union"))
    bound = near.join(grouped.select("node", "tokens"), "node").join(unions, "other").where(f"100 * size(array_intersect(tokens, union)) >= {percent} * n")
    opened = tc.written(bound.select("node", "other").distinct(), spark)
    slices = opened.groupBy("other").agg(F.ceil(F.count("*") / QUERIES).alias("slices"))
    asked = opened.join(slices, "other").withColumn("slice", F.pmod(F.xxhash64("node"), "slices")).drop("slices")
    place = ["other.part", "other.slot", "slice"]
    queries = asked.join(grouped.select("node", "tokens"), "node").select(*place, "node", "tokens", F.lit(False).alias("member"))
    members = asked.select("other", "slice").distinct().join(grouped.select(F.col("group").alias("other"), "node", "tokens"), "other").select(*place, "node", "tokens", F.lit(True).alias("member"))
    found = queries.union(members).groupBy("part", "slot", "slice").applyInArrow(_cross_links(percent), "u long, v long")
    return tc.written(found, spark)


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row for each row of docs."""
    docs = tc.text_only(docs)
    known = docs.where("doc_id IS NOT NULL")

    # 1. documents with enough shared tokens in their prefixes
    emitted = known.mapInArrow(_emit_prefixes(percent, 0.05), "doc_id long, n long, tokens array<long>")
    rows = emitted.select(F.col("doc_id").alias("node"), "n", F.explode("tokens").alias("token"))
    ids = _small(_shared(rows, _needed(0.05, percent)).distinct().withColumn("wanted", F.lit(True)), spark)
    marked = docs.join(ids, docs["doc_id"] == ids["node"], "left").select(docs["doc_id"], docs["text"], F.coalesce("wanted", F.lit(False)).alias("wanted"))
    table = marked.mapInArrow(_emit_sets, "doc_id long, n long, digest binary, tokens array<long>")
    table = tc.written(table.withColumn("rid", F.monotonically_increasing_id()), spark)
    n_rows = table.count()

    # 2. equal sets are one node, the smallest doc_id
    member = table.where("digest IS NOT NULL").select("doc_id", "digest").distinct()
    same = tc.written(tc.in_few_files(table.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("head")).select("digest", F.col("head.doc_id").alias("node"), F.col("head.rid").alias("rid")), n_rows), spark)
    heads = table.join(_small(same.select("rid"), spark, n_rows), "rid", "left_semi").select(F.col("doc_id").alias("node"), "n", "tokens")
    first = heads.select("node", "n", F.explode(F.expr(f"slice(tokens, 1, cast(least(n, n - ceil({percent} * n / 100) + 1 + floor(0.25 * n)) as int))")).alias("token"))
    likely = _small(_shared(first, _needed(0.25, percent)).distinct(), spark, n_rows)
    # nodes with one doc_id (repeated rows with other texts) are one node of the graph, but sets of their own
    nodes = tc.written(heads.join(likely, "node", "left_semi"), spark)

    # 3. groups, 4. token-group matrix
    links = _grouped_links(spark, nodes, percent)
    names = nodes.groupBy("node").agg(F.sum("n").alias("n"))
    parts = tc.written(tc.in_few_files(_parts(spark, names, links).join(names, "node"), n_rows), spark)
    slots = parts.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("n") / CHUNK_TOKENS)).alias("slots"))
    dealt = _small(parts.drop("n").join(slots, "part").select("node", "part", F.struct("part", F.pmod(F.xxhash64("node"), "slots").alias("slot")).alias("group")), spark, n_rows)
    grouped = nodes.join(dealt, "node").select("node", "n", "tokens", "part", "group")
    far = _open_links(spark, grouped, percent)
    # a doc_id with several texts links the nodes of all of them
    several = member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    owned = tc.written(tc.in_few_files(member.join(several, "doc_id", "left_semi").join(same, "digest").select("doc_id", "node").distinct(), n_rows), spark)
    own = owned.join(owned.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").where("u <> node").select("u", F.col("node").alias("v"))
    if far.isEmpty() and own.isEmpty():
        final = parts.select("node", "part")
    else:
        final = _joined(spark, parts, owned, tc.written(far.union(own), spark), n_rows)

    # 5. back to the rows
    classes = same.join(final, "node", "left").select("digest", F.coalesce("part", "node").alias("part"))
    whole = member.join(classes, "digest").groupBy("doc_id").agg(F.min("part").alias("component_id"))
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, tc.read_table(spark, sf_dir, "documents"))
