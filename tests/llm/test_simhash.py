import random
import re

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as S


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    """nodes: (id, fp) pairs."""
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (k, _) in enumerate(nodes):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(nodes))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a B", "A b C", "Ünï É a b c", "x " * 5000, "a\x0bb\x85c d e f g"])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == brute_fingerprint(text)


def clustered(rnd, n):
    out = []
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 30])):
            value = base
            for _ in range(rnd.randrange(5)):
                value ^= 1 << rnd.randrange(64)
            out.append(value)
    return sorted(set(out[:n]))


@pytest.mark.parametrize("n", [2, 3, 64, 65, 700])
def test_links_are_those_of_brute_force(n):
    rnd = random.Random(n)
    values = np.array([v & ~0xFF | 7 for v in clustered(rnd, n)], dtype=np.uint64)
    values = np.unique(values)
    bucket = np.sort(np.array([rnd.randrange(3) for _ in values]))
    a, b = S.links(values, bucket, range(0, 8))
    assert all((int(values[x]) ^ int(values[y])).bit_count() <= 2 and bucket[x] == bucket[y] for x, y in zip(a, b))
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        assert find(x) != find(y), "a cycle"
        parent[find(y)] = find(x)
    for i in range(len(values)):
        for j in range(i):
            if bucket[i] == bucket[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2:
                assert find(i) == find(j)


@pytest.mark.parametrize("most", [1 << 14, 5])
def test_components_of_fingerprints(spark, most):
    rnd = random.Random(9)
    values = clustered(rnd, 300)
    ids = rnd.sample(range(10_000), len(values))
    rows = [(v - (1 << 64) if v >> 63 else v, i) for v, i in zip(values, ids)]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    got = {r.node: r.component for r in S.components(S.near_links(distinct, most=most)).collect()}
    want = brute_components(list(zip(ids, values)))
    assert [got.get(i, i) for i in ids] == want


def test_large_buckets_across_batches(spark):
    """One bucket over many Arrow batches goes by the linear way and loses no link."""
    rnd = random.Random(4)
    values = sorted({rnd.getrandbits(12) << 22 | 3 for _ in range(900)})
    rows = [(v, i) for i, v in enumerate(values)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        distinct = spark.createDataFrame(rows, "fp long, rep long")
        got = {r.node: r.component for r in S.components(S.near_links(distinct, most=150)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got.get(i, i) for _, i in rows] == brute_components([(i, v) for v, i in rows])


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(40):
        text = rnd.choices(vocabulary, k=rnd.choice([1, 2, 5, 200, 600]))
        docs.append(" ".join(text))
        for _ in range(rnd.randrange(4)):
            near = list(text)
            near[rnd.randrange(len(near))] = "changed"
            docs.append(rnd.choice([" ", "\n"]).join(near).upper())
    docs += [None, "", "  ", docs[0], docs[3]]
    rows = list(enumerate(docs)) + [(5, docs[5]), (None, docs[7]), (None, "a text of its own")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op8(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    nodes = [(i, brute_fingerprint(t)) for i, t in enumerate(docs)]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(nodes, brute_components(nodes))}
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
