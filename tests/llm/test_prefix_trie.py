"""The trie of conversation prefixes against plain dictionaries and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from clauseframe.llm import keyed, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, size int, node string"


def plain(rows):
    """rows (conv_id, turn, role, text) -> rows of COLUMNS."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), role or "", digest, text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], sha(ends[n])) for n in members), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        n = rng.randint(1, 7)
        rows += [(c, t, "user" if t % 2 else "system", rng.choice(["hi", "é 日", "", "go on"]) if t else rng.choice(["start", "start", "other"])) for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 240) for t in range(3)]  # a group of copies
    rows += [(300, t, "user", str(t % 3)) for t in range(70)] + [(301, t, "user", str(t % 3)) for t in range(64)]  # long ones
    rows += [(400, None, None, None), (400, None, "user", "b"), (400, 2, "user", "x"), (400, 2, "user", "x"), (400, 2, "a", "y"), (400, 1, "user", None)]
    rows += [(404, 0, "user", "gone"), (None, 0, "user", "nobody"), (None, None, None, None), (406, 0, "", "z" * 5000)]
    return [r for r in rows if r[0] is None or r[0] != 20]  # 21 to 24 have no conversation to begin with


@pytest.mark.parametrize("stretch", [4, 4096])
def test_nodes_equal_plain_dictionaries(spark, monkeypatch, stretch):
    """Null turns, roles, texts and ids, ties, repeated rows, turnless and long conversations, copies, columns of other names."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = table()
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA).repartition(5)
    got = rows_of(prefix_trie.prefix_trie(docs, spark))
    assert got == plain(rows)
    assert any(r[3] >= 40 for r in got[1:]) and any(r[1] >= 64 for r in got)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    assert rows_of(prefix_trie.op13_prefix_trie(spark, "/root/testdata/sf0.001")) == sorted(con.sql(prefix_trie.SQL).fetchall(), key=str)


def test_empty_table(spark):
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), spark)) == []


def test_numbers_are_dense_and_hot_keys_are_found(spark, tmp_path):
    """Most rows have one key; every row gets the number of its key, and aggregates of all rows with it."""
    rows = spark.range(5000).selectExpr("id", "if(id % 10 < 9, 'hot', 'k' || id) AS key", "1 AS key_rows")
    rows.write.parquet(f"{tmp_path}/rows")
    from pyspark.sql import functions as F

    got = keyed.named(spark.read.parquet(f"{tmp_path}/rows"), ["key"], "name", spark, least=F.min("id")).collect()
    names = {r["key"]: r["name"] for r in got}
    assert len(got) == 5000 and sorted(names.values()) == list(range(501)) and all(names[r["key"]] == r["name"] for r in got)
    assert all(r["least"] == (0 if r["key"] == "hot" else r["id"]) for r in got)
