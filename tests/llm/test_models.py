"""Toxicity, personal data and quality: held-out accuracy, brute force, awkward rows; then the pipeline."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, minhash, packing, pii, quality, toxicity
from gridloom.llm.samples import labelled_sample
from tests.llm.common import DIR, QUERIES, awkward, empty, with_tables

LARGER = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score + np.random.default_rng(0).random(len(score)) * 1e-9))
    return (order[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def held_out(spark, name, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([labels[r["doc_id"]] for r in rows])


def test_toxicity_held_out(spark):
    score, predicted, y = held_out(spark, "op7_compression_toxicity", "toxic")
    assert auc(score, y) > 0.68
    assert predicted[y == 0].mean() < 0.02 and (y[predicted == 1] == 1).mean() > 0.8 and predicted[y == 1].mean() > 0.3


def test_toxicity_held_out_in_every_language(spark):
    """Labels follow word beginnings of each language that ordinary texts hardly have."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op7_compression_toxicity"](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = Counter(langs[r["doc_id"]] for r in rows if labels[r["doc_id"]])
    found = Counter(langs[r["doc_id"]] for r in rows if labels[r["doc_id"]] and r["predicted"])
    assert len(toxic) == 4 and all(found[k] >= 0.4 * n for k, n in toxic.items()), (found, toxic)
    assert found.total() >= 0.7 * toxic.total()
    assert sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 2


def plain_window(word):
    """Four bytes for each letter: a hash of the word up to it."""
    out, total, power = b"", 0, 1
    for c in f" {word} ":
        power = power * 0x9E3779B97F4A7C15 % 2**64
        total = (total + (ord(c) + 7) * power) % 2**64
        own = total * 0xD6E8FEB86659FD93 % 2**64
        out += ((own ^ own >> 32) % 2**32).to_bytes(4, "little")
    return out


def test_letters_are_coded_by_their_word_so_far():
    found = ["stark", "start", "art", "naïve", "🙂", "x" * 50, *(f"w{i}" for i in range(5000))]
    made = toxicity.coded(found)
    assert made == [plain_window(w) for w in found]
    assert made[0][:20] == made[1][:20] and made[0][20:24] != made[1][20:24] and toxicity.coded([]) == []


def plain_length(word, content):
    shared = zstandard.ZstdCompressionDict(content)
    return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(plain_window(word)))


def test_toxicity_against_a_plain_program(spark):
    """Dictionaries come from the trainer alone, and scores are those of a program that compresses word by word."""
    rng = np.random.default_rng(4)
    usual = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "st", "m")]
    bad = [f"vex{c}{d}" for c in "aeiou" for d in ("l", "mp", "g")]
    texts = [" ".join([*rng.choice(usual, 60), *(rng.choice(bad, 4) if k % 4 == 0 else [])]) for k in range(400)]
    docs = spark.createDataFrame([(k, t, 7.0) for k, t in enumerate(texts)], "doc_id long, text string, counts double")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    ordinary, (first, second) = toxicity.train([texts[k] for k in learned if k % 4], [texts[k] for k in learned if k % 4 == 0])
    assert (model.ordinary, model.toxic) == (ordinary, [first, second])
    windows = [plain_window(w) for k in learned if k % 4 == 0 for w in texts[k].split()]
    assert first == zstandard.train_dictionary(toxicity.TOXIC_BYTES, windows).as_bytes()
    rows = docs.select("*", toxicity.score(model, docs["text"]).alias("score")).collect()
    assert rows[0]["counts"] == 7.0
    for r in rows[:40]:
        x = []
        for dictionary, cuts in zip((first, second), model.thresholds):
            gains = [plain_length(w, ordinary) - plain_length(w, dictionary) for w in r["text"].split()]
            x += [np.log1p(sum(g >= cut for g in gains)) for cut in cuts]
        x.append(np.log1p(len(r["text"].split())) / 10)
        assert abs(r["score"] - 1 / (1 + np.exp(-(np.dot(x, model.beta[:-1]) + model.beta[-1])))) < 1e-9
    away = [r for r in rows if r["doc_id"] not in set(learned)]
    assert auc(np.array([r["score"] for r in away]), np.array([int(r["doc_id"] % 4 == 0) for r in away])) > 0.95


def test_words_are_found_among_hundreds_that_begin_alike():
    """A word that a dictionary of the ordinary one's size holds costs one match, wherever it stands."""
    rng = np.random.default_rng(5)
    found = sorted({"lo" + "".join(rng.choice(list("abcdefghik"), 6)) for _ in range(700)})
    content = b"".join(toxicity.coded(found))[-toxicity.ORDINARY_BYTES :]
    squeeze = toxicity._compressor(content)
    lengths = [len(squeeze(window)) for window in toxicity.coded(found) if window in content]
    assert len(lengths) > 300 and max(lengths) < 20, (len(lengths), max(lengths))


def test_gains_are_the_same_whatever_is_remembered(monkeypatch):
    found = [f"{a}{b}" for b in "xyz" for a in ("the", "vex", "war", "sun", "low")] * 3
    ordinary, toxic = b"".join(toxicity.coded(found[:4])), b"".join(toxicity.coded(found[4:9]))
    want = toxicity.Gains(ordinary, (toxic,)).of(found).tolist()
    monkeypatch.setattr(toxicity, "REMEMBERED", 4)
    monkeypatch.setattr(toxicity, "SLICE", 3)
    gains = toxicity.Gains(ordinary, (toxic,))
    assert gains.of(found).tolist() == want and any(want)
    assert len(gains.known) <= 4 + 3 and len(gains.earlier) <= 4 + 3
    before, kept = dict(gains.known), [next(iter(gains.known))]
    gains.known, gains.earlier = {}, before
    assert gains.of(kept).tolist() == [before[kept[0]]] and list(gains.known) == kept


def test_samples_take_long_texts_as_often_as_short_ones(spark):
    """A text that no longer fits ends the sample; later short ones don't take its place."""
    rows = [(k, "x" * (100 if k % 2 else 10)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(400)], "doc_id long, toxic int")
    sample, counts = labelled_sample(docs, labels, "toxic", F.lit(True), {1: 1000}, 5000)
    found = [len(r["text"]) for r in sample.collect()]
    assert counts == {1: 400} and 4890 < sum(found) <= 5000 and 0.3 < np.mean([n == 100 for n in found]) < 0.7


def test_quality_held_out(spark):
    score, predicted, y = held_out(spark, "op10_random_indexing_quality", "quality")
    assert auc(score, y) > 0.95
    assert predicted[y == 1].mean() > 0.97


def test_models_stand_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for name in ("op7_compression_toxicity", "op10_random_indexing_quality"):
        for k, lab in enumerate((labels, none)):
            where = with_tables(spark, tmp_path / f"{name}{k}", documents=awkward(spark), labels=lab)
            rows = QUERIES[name](spark, where).collect()
            assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        where = with_tables(spark, tmp_path / f"{name}e", documents=empty(spark), labels=labels)
        assert QUERIES[name](spark, where).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, expression in PLAIN.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "x@foo.com_y@bar.com a@b.c@d.e a@b c..d@e-f.g.h. @z.z",
    "1.2.3.4.5.6.7.8 999.1.1.1 1..2.3.4.5 a1.2.3.4b 001.002.003.255 1.2.3.4444444444444444444444",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x 79927398713 0000000000000000",
    "+1 (843) 555-7672 +12345 ++1 234 567 890 +1 (2)) . +1234567890123456789 +49.30.123456",
    "🙂 é x@é.com ü+1 (843) 555-7672🙂 9.9.9.9 日本 4111111111111111",
    "a" * 20000 + "@" + "b" * 3000 + "." + "c." * 3000 + "d",
    "1" * 20000, "1.2." * 5000, "+1 " + "." * 20000 + "2",
]


def listing(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_seeds_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for where in (DIR, with_tables(spark, tmp_path / "a", documents=docs), with_tables(spark, tmp_path / "b", documents=awkward(spark))):
        texts = spark.read.parquet(f"{where}/documents.parquet").collect()
        rows = QUERIES["op9_bootstrapped_pii"](spark, where).collect()
        want = Counter((r["doc_id"], hashlib.sha256(listing(base_spans(r["text"])).encode()).hexdigest(), *(sum(k == kind for k, *_ in base_spans(r["text"])) for kind in PLAIN)) for r in texts)
        assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows) == want
        for r in rows:
            base = ",".join(x for x in r["spans"].split(",") if not x.startswith("secret"))
            assert r["n_learned"] or hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
            assert r["n_spans"] == sum(r[f"n_{k}"] for k in (*PLAIN, "secret", "learned")) == len([x for x in r["spans"].split(",") if x])
    assert QUERIES["op9_bootstrapped_pii"](spark, with_tables(spark, tmp_path / "c", documents=empty(spark))).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please contact mail: user{i}@mail{i}.example.com today") for i in range(30)]
    rows += [(100, "please contact mail: root@localhost today"), (101, "nothing at root@localhost else"), (102, "chapter 12 verse 7")]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["spans"] == "email:21:35" and out[100]["n_learned"] == 1 and out[100]["n_email"] == 0
    assert out[101]["spans"] == out[102]["spans"] == ""
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert hidden[3] == "please contact mail: [EMAIL] today" and hidden[100] == "please contact mail: [EMAIL] today" and hidden[102] == rows[-1][1]


def test_a_key_of_hexadecimal_digits_is_a_secret(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(0, f'token = "{key}" x'), (1, "f" * 40 + " " + "1" * 40), (2, f"z{key} {key}z {key[:31]}"), (3, f"{key}.{key}")]
    out = {r["doc_id"]: (r["n_secret"], r["spans"]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: (1, "secret:9:49"), 1: (0, ""), 2: (0, ""), 3: (2, "secret:0:40,secret:41:81")}


def test_learned_instances_support_patterns_without_seeds(spark):
    """host: has seeds and unseen values; peer: has only values that were learned there, and one more."""
    rows = [(i, f"host: 10.0.{i}.1 up") for i in range(30)] + [(100 + i, f"host: 10.0.{i}.xx up") for i in range(6)]
    rows += [(200 + i, f"peer: 10.0.{i}.xx down") for i in range(6)] + [(300, "peer: 10.9.9.zz down"), (301, "size: 10.9.8.zz down")]
    rows = [(i, t.replace(".xx", ":a").replace(".zz", ":b")) for i, t in rows]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[100 + i] == f"ip:6:{len(f'10.0.{i}:a') + 6}" for i in range(6))
    assert all(out[200 + i] == out[100 + i] for i in range(6))
    assert out[300] == "ip:6:14" and out[301] == ""


def test_learned_spans_of_a_planted_corpus(spark):
    """Recall and precision of learned spans where contexts carry identifiers that no expression finds."""
    rng = np.random.default_rng(6)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, planted = [], {}
    for i in range(600):
        text = " ".join(rng.choice(words, 12))
        at = i % 6
        if at == 0:
            text += f" call phone +1 (555) 010-{1000 + i} {rng.choice(words)}"
        elif at == 1 and i % 18 == 1:
            planted[i] = f"phone:{len(text) + 12}:{len(text) + 24}"
            text += f" call phone 555-010-{1000 + i} now"
        elif at == 2:
            text += f" password = {'%032x' % (i * 77777777777 + 16**31)} {rng.choice(words)}"
        elif at == 3 and i % 18 == 3:
            planted[i] = f"secret:{len(text) + 12}:{len(text) + 32}"
            text += f" password = Zq9-{1000 + i}-{1000 + i}-kkkkkk end"
        else:
            text += f" chapter {i} of {rng.choice(words)} 555-01{i}"
        rows.append((i, text))
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    learned = {i: r["spans"] for i, r in out.items() if r["n_learned"]}
    assert learned == planted


def test_contexts_have_no_limit(spark):
    long = "w" * 3000
    rows = [(i, f"x {long} {long} user{i}@mail.example.com") for i in range(12)] + [(50, f"x {long} {long} root@localhost"), (51, f"x {long[1:]} {long} root@localhost")]
    rows += [(100 + i, f"y {long} here{i} 7{i}") for i in range(40)]
    uses = pii.extracted(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    before = {r["doc_id"]: [u["before"] for u in r["uses"]] for r in uses}
    assert before[3] == before[50] == [f"{long} {long}"] and before[51] == [f"{long[1:]} {long}"]
    assert before[107] == [f"y {long}", f"{long} here0"]


def test_very_many_matches(spark):
    text = " ".join(f"10.0.{i % 200}.{i % 250} x{i} token{i}" for i in range(20000))
    began = time.time()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.personal_data(docs).collect()[0]
    assert row["n_ip"] == 20000 and row["base_sha256"] == hashlib.sha256(listing(base_spans(text)).encode()).hexdigest()
    assert pii.masked(docs).collect()[0]["text"] == re.sub(r"10\.0\.\d+\.\d+", "[IP]", text)
    assert time.time() - began < 60


def test_masking_carries_columns_of_any_name(spark):
    names = ["doc_id", "text", "learned", "_id", "_h", "_x", "_seeds", "seeds", "uses", "tokens", "row", "h", "_chunks", "kind", "start", "a.b", "clean"]
    values = ["mail a.b@c.example now", *(f"v{k}" for k in range(len(names) - 2))]
    docs = spark.createDataFrame([(1, *values), (2, None, *values[1:])], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = {r[0]: r for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == names
    assert list(out[1]) == [1, "mail [EMAIL] now", *values[1:]] and list(out[2]) == [2, None, *values[1:]]


def masked_text(text):
    secrets = [("secret", m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}(?![A-Za-z0-9])", text or "")]
    spans = sorted((a, b, k) for k, a, b in base_spans(text) + secrets)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return text if not spans else "".join(out) + text[at:]


def test_pipeline_stage_by_stage(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = stages["toxicity"](spark, docs, DIR).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    gains = model.gains()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"], gains) < toxicity.THRESHOLD}
    single = stages["minhash near-dedup"](spark, kept, DIR).cache()
    classes = minhash.near_duplicate_classes(kept).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["class_id"] for r in classes})
    clean = stages["pii"](spark, single, DIR).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["text"] == masked_text(before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    mixed = stages["mixing"](spark, clean, DIR).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(copies)
    for df in (kept, single, clean, mixed):
        assert df.columns == columns
    packed = stages["packing"](spark, mixed, DIR)
    bpe = packing.ByteBpe(packing.default_tokenizer())
    total = sum(len(bpe.ids(r["text"])) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed.collect()) == total


def test_pipeline_stands_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((awkward(spark), empty(spark))):
        where = with_tables(spark, tmp_path / str(k), documents=docs, labels=labels)
        rows = corpus_pipeline.run(spark, where).collect()
        assert bool(rows) == (k == 0)


def test_words_and_windows():
    assert toxicity.words(None) == toxicity.words(" ") == []
    assert toxicity.words("A b\n c") == ["a", "b", "c"]
    rows, ends = quality.tokens(pa.array(["Hello, WORLD!! 🙂", None, "  ", "x"], pa.string()))
    assert len(rows) == 8 and ends.tolist() == [0, 6, 6, 6, 8]


def test_contexts_end_with_their_text():
    texts = ["a b c", "", "b", "c a a b"]
    total = np.zeros((quality.DIMS, quality.ROWS))
    quality.add_contexts(total, *quality.tokens(pa.array(texts)))
    want, index = np.zeros_like(total), quality.index_vectors()
    for t in texts:
        rows, _ = quality.tokens(pa.array([t]))
        for i, r in enumerate(rows):
            for j in range(max(0, i - quality.REACH), min(len(rows), i + quality.REACH + 1)):
                if i != j:
                    want[:, r] += index[:, rows[j]]
    assert (total == want).all()
