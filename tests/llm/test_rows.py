"""Sharding, media, packing and mixing: one row a document or piece, exact checks against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import media, mixing, packing, sharding
from tests.llm.common import DIR, QUERIES, awkward, empty, with_tables


def check_shards(rows, n=8):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_on_documents(spark):
    rows = QUERIES["op1_label_propagation"](spark, DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    check_shards(rows)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_linked_rows_gather(spark):
    rows = [(i, f"k{i // 4}" if i < 160 else None) for i in range(400)]
    out = sharding.balanced_label_propagation(spark.createDataFrame(rows, "id long, k string"), "id", ["k"]).collect()
    check_shards(out)
    shards = defaultdict(set)
    for r in out:
        if r["k"]:
            shards[r["k"]].add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 0.9 * len(shards)


def test_propagation_cuts_fewer_links_than_random_placement_and_keeps_columns(spark):
    """Chains: a row shares k with one neighbor and m with another; columns with the operator's own names keep their values."""
    rows = [(i, i // 2, (i + 1) // 2 if (i + 1) % 12 else None, f"x{i}", -i, 2.0 * i, 99, 98) for i in range(480)]
    df = spark.createDataFrame(rows, "id long, k long, m long, _row string, _shard long, _id double, shard int, slot int")
    out = sharding.balanced_label_propagation(df, "id", ["k", "m"])
    assert out.columns == ["id", "k", "m", "_row", "_shard", "_id", "shard", "slot"]
    found = out.collect()
    check_shards(found)
    assert all((r["_row"], r["_shard"], r["_id"]) == (f"x{r['id']}", -r["id"], 2.0 * r["id"]) for r in found)
    shard = {r["id"]: r["shard"] for r in found}
    linked = [(a, b) for link in (1, 2) for a, b in zip(range(479), range(1, 480)) if rows[a][link] is not None and rows[a][link] == rows[b][link]]
    cut = sum(shard[a] != shard[b] for a, b in linked)
    assert cut < 0.5 * 7 / 8 * len(linked)


def test_equal_texts_share_a_shard(spark):
    rows = QUERIES["op1_label_propagation"](spark, DIR.replace("0.001", "0.01")).collect()
    by = defaultdict(set)
    for r in rows:
        by[(r["text_crc32"], r["size"])].add(r["shard"])
    assert max(Counter((r["text_crc32"], r["size"]) for r in rows).values()) > 1
    assert sum(len(s) > 1 for s in by.values()) <= 1


def test_one_link_of_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else None) for i in range(600)]
    out = sharding.balanced_label_propagation(spark.createDataFrame(rows, "id long, k string"), "id", ["k"]).collect()
    check_shards(out)
    assert len({r["shard"] for r in out if r["k"]}) <= 5


def test_sharding_awkward(spark, tmp_path):
    rows = QUERIES["op1_label_propagation"](spark, with_tables(spark, tmp_path, documents=awkward(spark))).collect()
    assert len(rows) == 10
    check_shards(rows)
    assert QUERIES["op1_label_propagation"](spark, with_tables(spark, tmp_path, documents=empty(spark))).count() == 0


def test_media_round_trip(spark, tmp_path):
    for where in (DIR, with_tables(spark, tmp_path, documents=awkward(spark))):
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        rows = QUERIES["op2_interleaved_media"](spark, where).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
        texts = {r["doc_id"]: r["text"] for r in docs}
        for r in rows:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
            assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(payload[-64:])
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert QUERIES["op2_interleaved_media"](spark, with_tables(spark, tmp_path, documents=empty(spark))).count() == 0


def test_page_order_and_captions():
    a, b = "a" * 64, "b" * 64
    page = f'<p>Lead</p><figure><img src="sha256:{a}" alt="x"><figcaption>Cap &amp; one</figcaption></figure>tail <b>bold</b><img src="sha256:{b}" alt="two"><script>no</script><p>end'
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.read_page(page)]
    assert got == [(0, "text", "Lead", None, None), (1, "media", f"sha256:{a}", a, "Cap & one"), (2, "text", "tail bold", None, None), (3, "media", f"sha256:{b}", b, "two"), (4, "text", "end", None, None)]
    assert media.read_page(None) == media.read_page("") == []


def test_sequences_keep_positions(spark):
    payload = b"x" * 64
    digest = hashlib.sha256(payload).hexdigest()
    store = media.store_media(spark.createDataFrame([(digest, payload)], "digest string, payload binary"))
    page = f'<p>one</p><img src="sha256:{digest}"><p>two</p><img src="sha256:{"0" * 64}">'
    docs = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    out = {r["page_id"]: r["sequence"] for r in media.sequences(docs, "html", ["page_id"], media.read_media(store)).collect()}
    assert [(x["position"], x["kind"], x["payload_bytes"]) for x in out[1]] == [(0, "text", None), (1, "media", 64), (2, "text", None), (3, "media", None)]
    assert out[2] == out[1] and out[3] == []


@pytest.fixture(scope="module")
def slow_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(slow_ids):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    bpe = packing.ByteBpe(packing.default_tokenizer())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet=" \n\t'sdtmé.,1aЯ日ç", max_size=40))
    def same(text):
        assert bpe.ids(text) == slow_ids(text)

    same()


def check_pieces(rows, ids_of, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc, pieces in by_doc.items():
        ids = np.array(ids_of[doc], dtype="<u4")
        copies = Counter(r["start"] for r in pieces)[0]
        assert sum(r["length"] for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    return len(by_sequence)


def test_packing(spark, tmp_path, slow_ids):
    for where in (DIR, with_tables(spark, tmp_path, documents=awkward(spark))):
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        ids = {r["doc_id"]: [*slow_ids(r["text"] or ""), 0] for r in docs}
        rows = QUERIES["op5_cost_balanced_packing"](spark, where).collect()
        assert {r["doc_id"] for r in rows} == set(ids)
        n = check_pieces(rows, ids)
        total = sum(r["length"] for r in rows)
        assert n * 1024 - total < 1024 * 4
    assert QUERIES["op5_cost_balanced_packing"](spark, with_tables(spark, tmp_path, documents=empty(spark))).count() == 0


def test_blocks_pad_less_than_a_sequence_and_cut_once_a_sequence():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 800)
    placed = packing.place(lengths, 1024, 1.0, 1 / 512)
    n = -(-int(lengths.sum()) // 1024)
    used = Counter()
    for _, _, length, at, offset in sorted(placed, key=lambda x: (x[3], x[4])):
        assert offset == used[at]
        used[at] += length
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 1024 and len(used) <= n
    assert len(placed) <= len(lengths) + n  # a cut fills its sequence


def test_mixing_brute_force(spark, tmp_path):
    for where in (DIR, with_tables(spark, tmp_path, documents=awkward(spark))):
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        rows = QUERIES["op6_systematic_mixing"](spark, where).collect()
        assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op6_systematic_mixing"](spark, where).collect()))
        size = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
        totals = defaultdict(int)
        for d in docs:
            totals[d["source"]] += size(d["text"])
        order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        want, left, open_ = dict.fromkeys(order, 0.0), float(sum(totals.values())), set(order)
        while left > 1e-9 and open_:
            share = left / sum(weight[s] for s in open_)
            left = 0.0
            for s in list(open_):
                want[s] += share * weight[s]
                if want[s] >= 3 * totals[s]:
                    left += want[s] - 3 * totals[s]
                    want[s] = 3 * totals[s]
                    open_.discard(s)
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], size(d["text"])) for d in docs)
        source = {(d["doc_id"], size(d["text"])): d["source"] for d in docs}
        taken = defaultdict(int)
        for r in rows:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == totals[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
        largest = {s: max(size(d["text"]) for d in docs if d["source"] == s) for s in order}
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in order)
    assert QUERIES["op6_systematic_mixing"](spark, with_tables(spark, tmp_path, documents=empty(spark))).count() == 0


def test_repeated_rows_follow_the_mix(spark):
    docs = awkward(spark)
    mix = mixing.systematic_mix(docs.drop("shard", "score"))
    want = Counter()
    for r in mix.collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.repeated(docs).collect())
    assert got == +want and mixing.repeated(docs).columns == docs.columns


def test_lean_keeps_all_batches():
    from gridloom.llm.workers import lean

    assert list(lean(lambda batches: (b + 1 for b in batches))(iter([1, 2, 3]))) == [2, 3, 4]
    assert list(lean(lambda batches: iter(()))(iter([]))) == []


def test_workers_forget_other_operators():
    from gridloom.llm.workers import lean

    path = packing.default_tokenizer()
    first = packing._loaded(path)

    def own(batches):
        yield packing._loaded(path) is first

    own.__module__ = packing.__name__
    assert list(lean(own)(iter([]))) == [True]
    assert list(lean(lambda batches: iter(()))(iter([]))) == []
    assert packing._loaded.cache_info().currsize == 0


def test_pipeline_bounds_batches(spark):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield b.from_arrays([[b.num_rows]], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = awkward(spark)
    for k in (0, 1, 4):
        for setting, most in ((10000, 500), (0, 500), (200, 200)):
            spark.conf.set(key, setting)
            try:
                corpus_pipeline.STAGES[k][1](spark, docs, DIR)
                found = [r["n"] for r in spark.range(0, 1300, 1, 1).mapInArrow(sizes, "n long").collect()]
            finally:
                spark.conf.unset(key)
            assert sum(found) == 1300 and max(found) == most


def test_sample_takes_no_python_worker(spark):
    from pyspark.sql import functions as F

    from gridloom.llm.samples import labelled_sample

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    for allowed, want in ((F.lit(True), 9), (F.lit(False), 0)):
        found, _ = labelled_sample(docs, labels, "toxic", allowed, {0: 5, 1: 4}, 10_000)
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        assert len(rows) == want and all(r["text"] == f"text {r['doc_id']}" and r["label"] == r["doc_id"] % 2 for r in rows)
