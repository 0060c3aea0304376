"""Snapshot collapse, order MinHash and spherical caps against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gridloom.llm import caps, chat, minhash
from tests.llm.common import DIR, QUERIES, awkward, empty, with_tables

CONV = "conv_id long, turn long, role string, text string, rendered string"


def test_snapshots_collapse(spark, tmp_path):
    def talk(c, *texts):
        return [(c, i, "user" if i % 2 == 0 else "assistant", t, "clash") for i, t in enumerate(texts)]

    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a") + talk(None, "q", None) + talk(7, "q") + [(8, None, None, None, None)]
    out = chat.collapsed_chats(spark.createDataFrame(rows, CONV)).collect()
    assert {r["conv_id"] for r in out} == {2, 4, None, 8}
    assert next(r for r in out if r["conv_id"] == 4)["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    none = spark.createDataFrame([], CONV)
    assert QUERIES["op4_snapshot_collapse"](spark, with_tables(spark, tmp_path, conversations=none)).count() == 0


def kmers(text):
    hashes, _ = minhash.word_hashes(pa.array([text or ""], pa.string()))
    return minhash.labelled_kmers(hashes)


def brute_classes(docs):
    """Class of each doc_id by comparing all pairs, with a plain dynamic program as the alignment's check."""
    texts = sorted({(r["text"] or "") for r in docs})
    made = [kmers(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(made[i]), len(made[j])) >= 0.8 * max(len(made[i]), len(made[j])) and minhash.similarity(made[i], made[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for r in docs:
        g = root(texts.index(r["text"] or ""))
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], least.get(root(texts.index(r["text"] or "")))) for r in docs)


def test_near_duplicates_brute_force(spark, tmp_path):
    for where in (DIR, with_tables(spark, tmp_path, documents=awkward(spark))):
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        out = QUERIES["op3_order_minhash"](spark, where).collect()
        assert Counter((r["doc_id"], r["class_id"]) for r in out) == brute_classes(docs)
    assert QUERIES["op3_order_minhash"](spark, with_tables(spark, tmp_path, documents=empty(spark))).count() == 0


def test_chains_of_copies_and_a_shared_passage(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    fresh = lambda n: list(rng.choice(words, n))
    base, passage, rows = fresh(120), fresh(60), []
    for i in range(40):  # each copy differs from the last one, so that the ends are far apart
        rows.append((i, " ".join(base)))
        base = list(base)
        base[(7 * i) % 120] = f"new{i}"
    for i in range(40, 80):  # unlike but for one passage
        rows.append((i, " ".join(fresh(60) + passage + fresh(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicate_classes(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == brute_classes([{"doc_id": a, "text": b} for a, b in rows])


def test_keep_one_keeps_columns_and_one_row(spark):
    docs = awkward(spark)
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    # 1 stands for both rows of 6; 2 for the empty text
    assert got == Counter([1, 2, 4, 5, None, 8, 9])


def test_keep_one_carries_columns_of_any_name(spark):
    names = ["doc_id", "text", "_id", "_node", "node", "id", "own", "row", "kept", "n", "class_id", "_x"]
    rows = [(k, "one two three four five six seven" if k < 3 else None, *(f"{c}{k}" for c in names[2:])) for k in range(5)]
    docs = spark.createDataFrame([*rows, rows[0]], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = minhash.keep_one(docs)
    assert out.columns == names and sorted(map(tuple, out.collect())) == sorted([rows[0], rows[3]])


def test_recall_of_pairs_just_similar():
    """Texts of all lengths, edited until their similarity lies between 0.8 and 0.85, share a sketch nearly always."""
    rng = np.random.default_rng(11)
    met, tried = 0, 0
    for n in (12, 16, 20, 26, 32, 50, 100, 400, 1000):
        for _ in range(60):
            words = rng.integers(1, 1 << 60, n + 4).astype(np.uint64)
            other, last = words.copy(), None
            while minhash.similarity(a := minhash.labelled_kmers(words), b := minhash.labelled_kmers(other)) >= 0.8:
                last = b
                other = other.copy()
                at = int(rng.choice([0, len(other) - 1, rng.integers(0, len(other))], p=[0.2, 0.2, 0.6]))
                other = np.delete(other, at) if rng.random() < 0.3 else np.where(np.arange(len(other)) == at, np.uint64(rng.integers(1, 1 << 60)), other)
            if 0.8 <= minhash.similarity(a, last) <= 0.85:
                tried += 1
                met += bool(set(minhash.sketch_keys(a).tolist()) & set(minhash.sketch_keys(last).tolist()))
    assert tried > 150 and met >= 0.99 * tried, (met, tried)


def test_alignment_matches_a_plain_program():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a = rng.permutation(60).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 6))):
            i, j = rng.integers(0, 60, 2)
            b[i], b[j] = b[j], b[i]
        b = np.delete(b, rng.integers(0, 60, int(rng.integers(0, 4))))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        exact = m / (len(a) + len(b) - m)
        found = minhash.similarity(a, b)
        assert (found >= 0.8) == (exact >= 0.8) and (exact < 0.8 or found == exact)


def brute_links(rows, least=0.98):
    ok = [(k, lab, np.array(v, float)) for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for i, a, x in ok:
        for j, b, y in ok:
            if i < j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for k, r in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        least_id = min(rows[j][0] for j in reach)
        out.append((r[0], len(links[k]), least_id, r[0] == least_id))
    return Counter(out)


def test_caps_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 6))):
            v = centre + rng.standard_normal(64) * rng.choice([0.0, 0.02, 0.1, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    one = [1.0, 2.0, 3.0]
    for v, lab in [(None, 1), ([], 1), ([0.0, 0.0], 1), ([1.0, None], 1), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1), (one, None), (one, 2), (one, 2), (one, 2), ([2.0, 4.0, 6.0], 2), ([1e30, 2e30, 3e30], 2), ([1.0, 2.0], 2)]:
        rows.append((len(rows), v, lab))
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    out = caps.embedding_components(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == brute_links(rows)
    assert caps.embedding_components(df.limit(0)).count() == 0


def test_caps_recall():
    rng = np.random.default_rng(8)
    code = caps.ProductCode(64, 8 * 20000)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    met = [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(code.decode(x), code.decode(y))]
    assert np.mean(met) >= 0.99
