"""The n-gram join and decontamination against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from clauseframe.llm import components, decontaminate, ngram_join
from tests.llm.conftest import sentence


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size=5):
    w = words(text)
    return [tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))] if w else []


def brute_components(rows):
    sets = [(i, set(shingles(t))) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def near_copies():
    """A centre that links to all, whose copies hardly link to one another; chains; passages; edges of the threshold."""
    base = sentence(9, 200).split()
    rows = [(100, " ".join(base))]
    for i in range(40):  # each copy has another tenth of the words changed, in two runs
        w = list(base)
        for at in (5 * i % 200, (5 * i + 60) % 200):
            w[at : at + 8] = [f"new{i}x{k}" for k in range(8)]
        rows.append((200 + i, " ".join(w)))
    passage = sentence(10, 60)
    rows += [(400 + i, passage + " " + sentence(500 + i, 15)) for i in range(15)]
    rows += [(450 + i, sentence(600 + i, 300) + " " + passage) for i in range(5)]
    chain = sentence(11, 160).split()
    rows += [(500 + i, " ".join(chain[6 * i : 6 * i + 80])) for i in range(12)]
    return rows


def test_components(spark, docs, texts):
    for rows, df in ((texts, docs), (near_copies(), spark.createDataFrame(near_copies(), "doc_id long, text string"))):
        got = ngram_join.jaccard_components(spark, df).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_components(rows)
        sizes = Counter((i, len(set(shingles(t)))) for i, t in rows)
        assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes


def test_small_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = near_copies()
    got = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_no_documents(spark, none):
    assert ngram_join.jaccard_components(spark, none).count() == 0


def test_blocks_leave_few_pairs_and_lose_none():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), items, decontaminate.RADIUS)
    windows = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(200)]
    windows += [np.concatenate([items[k][:35], windows[k][:5]]) for k in range(100)]
    prints = np.concatenate([decontaminate.fingerprints(w, np.array([0]), np.array([40])) for w in windows])
    distance = np.array([[int(np.bitwise_count(p ^ q).sum()) for q in index.prints] for p in prints])
    w, k, d = index.near(prints)
    assert set(zip(w.tolist(), k.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS))))
    assert {(200 + i, i) for i in range(100)} <= set(zip(w.tolist(), k.tolist()))
    agreeing = (np.bitwise_count(prints[:200, None] ^ index.prints[None]) <= decontaminate.WITHIN).sum(axis=2)
    assert (agreeing >= index.need).mean() < 0.01


def test_cells_leave_few_items_and_lose_none(monkeypatch):
    """A window of a large benchmark meets about a hundredth of the items, and all that it is similar to; other cells change nothing."""
    rng = np.random.default_rng(2)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    items = [fresh(40) for _ in range(20_000)]
    items[1] = np.concatenate([items[0][:38], items[0][:2]])
    cells = decontaminate.Cells(list(range(len(items))), items, decontaminate.RADIUS, 75)
    for k in range(0, 20_000, 400):
        text = np.concatenate([fresh(30), items[k][:17], fresh(5), items[k][22:], fresh(9)])
        hits = np.concatenate([np.arange(30, 47), np.arange(52, 70)])
        asked = list(cells.of(text, hits, np.arange(25, 36), 40))
        assert any(k in index.names and 5 in windows for index, windows in asked)
        assert sum(len(index.names) for index, _ in asked) < 400
    few = [(k, h) for k, h in enumerate(items[:60])] + [(k, fresh(25)) for k in range(60, 70)]
    text = np.concatenate([part for k in range(0, 70, 3) for part in (fresh(20), few[k][1][: -(k % 4) or None])])
    got = []
    for cell in (1, 4, 1000):
        monkeypatch.setattr(decontaminate, "CELL", cell)
        group = decontaminate.Items(5, few, decontaminate.RADIUS, 75)
        got.append(sorted(group.search(text, group.known(text), 75, len(text))))
    assert got[0] == got[1] == got[2] and {1} | set(range(0, 70, 3)) == {k for k, *_ in got[0]}


def test_a_passage_is_asked_for_items_of_the_sizes_it_may_hold(monkeypatch):
    """Every shingle of a long item's passage stands in the benchmark, but in no item of most sizes: those get no fingerprints. As brute force, with items in items, repeated shingles and short texts."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1, 1 << 63, n).astype(np.uint64)
    items = [(size, fresh(size)) for size in range(8, 120)]
    long = items[-1][1]
    items += [(200, long[20:70]), (201, np.tile(long[30:34], 9)), (202, np.concatenate([long[40:52], long[80:92]]))]
    group = decontaminate.Items(5, items, decontaminate.RADIUS, 75)
    asked = []

    def counted(hashes, starts, ends, make=decontaminate.fingerprints):
        asked.append(len(starts))
        return make(hashes, starts, ends)

    monkeypatch.setattr(decontaminate, "fingerprints", counted)
    texts = [np.concatenate([fresh(50), long[:60], fresh(3), long[63:], fresh(50)]), long[:100], np.concatenate([long[40:52], long[80:91], np.tile(long[30:34], 8)]), long[:6], fresh(90)]
    for text in texts:
        want = {}
        for name, item in items:
            counts, span = Counter(item.tolist()), min(len(item), len(text))
            both = max((Counter(text[k : k + span].tolist()) & counts).total() for k in range(len(text) - span + 1))
            if 100 * both >= 75 * (span + len(item) - both):
                want[name] = round(both / (span + len(item) - both), 9)
        found = group.search(text, group.known(text), 75, len(text))
        assert {name: round(similarity, 9) for name, _, _, similarity, _ in found} == want
    assert 0 < sum(asked) < 300


@pytest.mark.parametrize("block", [decontaminate.BLOCK_TEXT, 300])
def test_decontamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_TEXT", block)
    items = [(i, sentence(800 + i, 15 + 5 * i)) for i in range(8)] + [(20, "three short words"), (21, None), (22, " ")]
    rows = [(i, sentence(i, 200) + " " + items[i][1].upper() + "\n" + sentence(i + 50, 90)) for i in range(8)]
    edited = items[7][1].split()
    edited[25] = "changed"
    rows += [(30, sentence(30, 40) + " " + " ".join(edited) + " " + sentence(31, 30)), (31, items[6][1]), (32, "has three short words inside"), (33, " ".join(items[5][1].split()[:12]) + " " + sentence(33, 50)), (34, sentence(34, 300)), (35, None), (36, ""), (37, "three short")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        for j, b in items:
            n = len(words(b))
            if not n or not words(t):
                continue
            size = min(5, n)
            a, c = shingles(t, size) if len(words(t)) >= size else [], Counter(shingles(b, size))
            m = sum(c.values())
            best = max(((Counter(a[k : k + m]) & c).total() / (min(m, len(a)) + m - (Counter(a[k : k + m]) & c).total()) for k in range(max(len(a) - m + 1, 1)) if a), default=0)
            if best >= 0.75:
                want[i, j] = round(best, 9)
    got = decontaminate.contamination(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want and len(want) >= 11
    kept = decontaminate.without_contaminated(df.selectExpr("*", "1 AS similarity"), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want} and kept.columns == ["doc_id", "text", "similarity"]
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_reads_documents_once_in_blocks(spark, monkeypatch):
    """Repeated items and documents, items over several blocks and stretches: as one block gives them, from one pass over the documents."""
    items = [(i, sentence(900 + i, 12 + i % 9)) for i in range(40)] + [(3, sentence(903, 15)), (4, sentence(990, 30)), (50, sentence(930, 60)), (None, sentence(991, 20))]
    rows = [(i // 2, " ".join(t for k in range(i % 4) for t in (sentence(i + k, 40), items[(7 * i + k) % 40][1]))) for i in range(60)]
    rows += [(70, items[5][1] + " gap " * 50 + items[5][1]), (71, items[41][1] + " " + items[43][1]), (71, None), (None, items[42][1])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter(map(tuple, decontaminate.contamination(df, bench).collect()))
    assert len(want) > 60 and any(i is None for _, i, *_ in want)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(decontaminate, "BLOCK_TEXT", 500)
    got = decontaminate.contamination(df.mapInArrow(counted, df.schema), bench).collect()
    assert Counter(map(tuple, got)) == want and seen.value == len(rows)
    kept = [tuple(r) for r in decontaminate.without_contaminated(df, bench).collect()]
    monkeypatch.undo()
    assert Counter(kept) == Counter(tuple(r) for r in decontaminate.without_contaminated(df, bench).collect()) and (71, None) in kept


def test_large_ids_and_repeated_ids(spark):
    """Ids that doubles can't hold, beside null; a doc_id whose texts link to two others joins them."""
    base, big = sentence(21, 60), 2**53
    other = sentence(22, 60)
    rows = [(big + 1, base), (big + 3, base.replace(base.split()[30], "x", 1)), (big + 5, base.replace(base.split()[50], "y", 1)), (None, base), (big + 7, sentence(23, 60))]
    rows += [(3, other), (5, other), (5, sentence(24, 60)), (7, sentence(24, 60) + " more"), (9, sentence(25, 40)), (9, sentence(26, 40)), (2, sentence(26, 40))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(big + 1, big + 1), (big + 3, big + 1), (big + 5, big + 1), (None, None), (big + 7, big + 7), (3, 3), (5, 3), (7, 3), (9, 2), (2, 2)}


def test_the_driver_plans_no_round_for_stars_and_one_step_at_a_time(spark, monkeypatch):
    """Each round is more than a thousand tasks on many partitions, which the driver keeps account of."""
    plans = []

    def written(df, session, write=components.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return write(df, session)

    monkeypatch.setattr(components, "written", written)
    stars = [(k, 1) for k in range(2, 60)] + [(1, 70), (100, 90), (90, 101)]
    got = components.connected_components(spark, spark.createDataFrame(stars, "u long, v long")).collect()
    assert dict(map(tuple, got)) == {**{k: 1 for k in range(1, 60)}, 70: 1, 90: 90, 100: 90, 101: 90} and len(got) == 63
    assert len(plans) == 1
    path = [(k, k + 1) for k in range(1, 40)] + [(60, 50), (60, 40), (200, 201), (201, 200), (300, 300)]
    got = components.connected_components(spark, spark.createDataFrame(path, "u long, v long")).collect()
    assert dict(map(tuple, got)) == {**{k: 1 for k in range(1, 41)}, 50: 1, 60: 1, 200: 200, 201: 200} and len(got) == 44
    assert max(plans) <= 6


def test_components_are_joined_as_wholes(spark, monkeypatch):
    """Links inside a component are not looked at again when components are linked."""
    seen = []

    def connected(session, links, find=components.connected_components):
        seen.append({tuple(sorted(r)) for r in links.collect() if r[0] != r[1]})
        return find(session, links)

    monkeypatch.setattr(ngram_join, "connected_components", connected)
    one, two = sentence(31, 90), sentence(32, 90)
    rows = [(10 + i, one.replace(one.split()[9 * i], "x", 1)) for i in range(1, 9)] + [(30 + i, two.replace(two.split()[9 * i], "y", 1)) for i in range(1, 9)]
    rows += [(5, one), (6, two), (50, one), (50, two)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys([i for i, _ in rows], 5)
    assert len(seen) == 2 and len(seen[0]) >= 16 and seen[1] == {(5, 6)}
