"""Quality by random-indexing word vectors and a small network.

A word gives two tokens, its letters in lower case and its shape (case and outer punctuation), each hashed to one of
ROWS rows. A row's index vector is a fixed random ternary vector; its context vector is the sum of the index vectors
of the tokens within REACH of its occurrences, over all documents: each task adds up its own and sends a row for each
row of the table that it met, Spark adds these. A document is the mean and the spread of its tokens' context
vectors, normed and centred, beside the logarithm of its length and the share of different tokens. A network of two
layers, in numpy, is fitted by Adam to a bounded sample of labelled rows, and a temperature fitted to a fifth of them
calibrates its probabilities.

The word vectors cover every document; the table has ROWS times DIMS numbers, whatever the input. The fit uses at most
TRAIN_LOW and TRAIN_HIGH labelled rows and TRAIN_BYTES bytes; scoring reads whole texts without any shuffle.

Defined cases: a null text counts as empty and has a vector of zeros; without both kinds of labels the score is the
share of good labels (0.5 without any); repeated rows score alike; other columns are untouched; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.samples import id_checksum, labelled_sample
from gridloom.llm.workers import lean

ROWS, DIMS, REACH = 1 << 14, 24, 2
#: Texts that are read at a time.
SLICE = 500
HIDDEN = 24
TRAIN_LOW, TRAIN_HIGH, TRAIN_BYTES = 3000, 5000, 32_000_000
THRESHOLD = 0.3


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """DIMS by ROWS, and a last column of zeros for the gap between texts."""
    rng = np.random.default_rng(41)
    made = rng.choice(np.array([-1.0, 0.0, 1.0]), size=(ROWS, DIMS), p=[1 / 6, 2 / 3, 1 / 6])
    return np.ascontiguousarray(np.vstack([made, np.zeros(DIMS)]).T)


_CACHE: dict[str, tuple[int, int]] = {}


def _tokens_of(word: str) -> tuple[int, int]:
    """Rows of the word's letters and of its shape; remembered for up to a million words."""
    import xxhash

    found = _CACHE.get(word)
    if found is None:
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        at = word.find(core) if core else 0
        case = "n" if not core else "u" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l"
        shape = f"{word[:at]} {case} {word[at + len(core):]}" if len(word) < 40 else f"long {case}"
        found = xxhash.xxh3_64_intdigest("w" + core.lower()) % ROWS, xxhash.xxh3_64_intdigest("s" + shape) % ROWS
        if len(_CACHE) >= 1_000_000:
            _CACHE.clear()
        _CACHE[word] = found
    return found


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tokens of an Arrow array of texts, two for each word, and the offsets of each text's."""
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.array([_tokens_of(w) for w in words], dtype=np.int64).reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # what is left of an empty text
        real = codes != words.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return table[codes].ravel(), 2 * ends


def add_contexts(total: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> None:
    """Adds to total, DIMS by ROWS, the index vectors around each token; contexts end with their text."""
    gap = np.repeat(np.arange(1, len(ends)), np.diff(ends)) * REACH
    padded = np.full(len(rows) + REACH * len(ends), ROWS)
    padded[np.arange(len(rows)) + gap] = rows
    for d, index in enumerate(index_vectors()):
        values = index[padded]
        around = np.zeros(len(padded))
        for k in range(1, REACH + 1):
            around[k:] += values[:-k]
            around[:-k] += values[k:]
        total[d] += np.bincount(padded, weights=around, minlength=ROWS + 1)[:ROWS]


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Normed and centred context vectors of all rows, from every document."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((DIMS, ROWS))
        met = np.zeros(ROWS, dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows, ends = tokens(batch.column(0).slice(at, SLICE))
                met[rows] = True
                add_contexts(total, rows, ends)
        keys = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(total[d, keys], pa.float64()) for d in range(DIMS))], names=["row", *(f"d{d}" for d in range(DIMS))])

    parts = docs.select(docs[text_col]).mapInArrow(lean(run), "row long, " + ", ".join(f"d{d} double" for d in range(DIMS)))
    # at most ROWS rows; sums of whole numbers, so their order doesn't matter
    summed = parts.groupBy("row").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS))).collect()
    vectors = np.zeros((ROWS, DIMS), dtype=np.float32)
    for r in summed:
        vectors[r["row"]] = r[1:]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    met = norm[:, 0] > 0
    if met.any():
        vectors[met] -= vectors[met].mean(axis=0)
    return vectors


def pooled(texts, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each of an Arrow array of texts."""
    rows, ends = tokens(texts)
    out = np.zeros((len(ends) - 1, 2 * DIMS + 2))
    for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if a == b:
            continue
        own, n = rows[a:b], b - a
        found = vectors[own]
        mean = found.sum(axis=0, dtype=np.float64) / n
        square = np.einsum("ij,ij->j", found, found, dtype=np.float64) / n
        different = np.count_nonzero(np.bincount(own, minlength=ROWS))
        out[k, :DIMS], out[k, DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        out[k, -2:] = np.log1p(n) / 5, np.log1p(different / np.sqrt(n))
    return out


class QualityModel:
    """Word vectors, network and temperature."""

    def __init__(self, vectors: np.ndarray, x: np.ndarray, y: np.ndarray, counts: dict[int, int], epochs: int = 400, seed: int = 3):
        total = sum(counts.values())
        self.vectors, self.rate, self.net = vectors, counts.get(1, 0) / total if total else 0.5, None
        if len(set(y.tolist())) < 2:
            return
        share = {k: counts[k] / total / max(1, (y == k).sum()) for k in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        net = [rng.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
        w = weight[used] / weight[used].sum()
        for step in range(1, epochs + 1):
            h = np.tanh(z[used] @ net[0] + net[1])
            p = 1 / (1 + np.exp(-np.clip(h @ net[2] + net[3], -30, 30)))
            out = w * (p - y[used])
            back = out[:, None] * net[2] * (1 - h * h)
            grads = [z[used].T @ back + 1e-4 * net[0], back.sum(axis=0), h.T @ out + 1e-4 * net[2], np.array([out.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] = net[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.net, self.temperature = net, 1.0
        if len(held):
            logits, v = self._logits(x[held]), weight[held]
            loss = lambda t: (v * (np.logaddexp(0, logits / t) - y[held] * logits / t)).sum()
            self.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.net[0] + self.net[1])
        return h @ self.net[2] + self.net[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model of labels.quality, learned from rows that are not held out."""
    import pyarrow as pa

    vectors = word_vectors(docs, text_col)
    allowed = F.pmod(id_checksum("doc_id"), F.lit(5)) != 0
    sample, counts = labelled_sample(docs, labels, "quality", allowed, {0: TRAIN_LOW, 1: TRAIN_HIGH}, TRAIN_BYTES, id_col, text_col)
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    parts = [pooled(pa.array([r["text"] for r in rows[at : at + SLICE]], pa.string()), vectors) for at in range(0, len(rows), SLICE)]
    x = np.concatenate(parts) if parts else np.zeros((0, 2 * DIMS + 2))
    return QualityModel(vectors, x, np.array([r["label"] for r in rows], dtype=np.int64), counts)


def score(model: QualityModel, text: Column) -> Column:
    """The probability that a text is good; the model, 1.5 MB, is sent with the function."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        import pyarrow as pa

        made = [model.score(pooled(pa.array(texts.iloc[at : at + SLICE], pa.string()), model.vectors)) for at in range(0, len(texts), SLICE)]
        return pd.Series(np.concatenate(made) if made else [], dtype="float64")

    return scored(text)
