"""Toxicity by compression distance.

Texts are put in lower case and cut into windows of one word with the spaces around it; each letter becomes four bytes, a
hash of its word up to it, so equal bytes are equal beginnings of words and literals are dear. Three zstandard dictionaries are
trained by the library's trainer on windows as they come, without any choice of words: an ordinary one on windows of ordinary
texts, a first toxic one on all windows of toxic texts, and a second toxic one on those windows of toxic texts which the
first shortens most against the ordinary one (few windows of a toxic text are toxic). A window's gains are its compressed
lengths under the ordinary dictionary less those under either toxic one. Thresholds are quantiles of the gains in ordinary
texts; the numbers of windows at or above them are the features of a logistic regression with the base rate
restored, so scores are probabilities. Toxic dictionaries are small, so that they hold what is frequent; the ordinary one is
larger, and its entries are searched through a tree.

The fit uses at most most_toxic and most_ordinary labelled rows, most_bytes bytes of text and TRAINED windows a dictionary.
FOLDS + 1 parts train on it, one after another, the last one on all rows; the others score the rows that they left out, which calibrates the
thresholds and weights on windows that no dictionary has seen. Only dictionaries and counts of gains come back to the driver.
Scoring reads every whole text, one at a time, without any shuffle; equal windows are compressed once a worker as far as
REMEMBERED of them go.

Defined cases: a null text counts as empty and has no windows; a very long text is one row of counts, whatever its length;
without both kinds of labels the score is the share of toxic labels (0 without any); repeated rows and ties score alike;
score is an expression, so other columns stay as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.samples import id_checksum, labelled_sample
from gridloom.llm.workers import forget, give_back, remembered

#: Hundreds of words in a dictionary begin alike. In one of more than 16 KB, lower levels look at a few of those places only and miss
#: words that are there, so that windows seem to gain by chance; from 11 on the search goes through a tree.
LEVEL = 12
#: The ordinary dictionary is three times as large, so that it holds the ordinary words which a toxic one holds too.
ORDINARY_BYTES, TOXIC_BYTES = 24 << 10, 1 << 13
#: Windows that train a dictionary, evenly spread over the sample; windows of toxic texts that train the second one gain as
#: much as this share of ordinary ones doesn't.
TRAINED, KEPT_SHARE = 240_000, 0.98
QUANTILES = (0.9, 0.99, 0.997, 0.999, 0.9997, 0.9999)
#: Gains are counted up to this many bytes; larger ones count as this many.
MOST_GAIN = 63
FOLDS = 3
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 1500, 4500, 24_000_000
#: Words whose gains a worker remembers, twice as many at the utmost, and words that are looked up at a time; both bound memory and
#: change no result.
REMEMBERED, SLICE = 100_000, 1 << 14
THRESHOLD = 0.7

_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def coded(found: list[str]) -> list[bytes]:
    """The window of each word: four bytes for each letter and the spaces around it, a hash of the word up to it."""
    out = []
    for k in range(0, len(found), 4096):
        text = f" {'  '.join(found[k : k + 4096])} "
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum([len(w) + 2 for w in found[k : k + 4096]])
        starts = ends - np.diff(ends, prepend=0)
        begin = np.repeat(starts, ends - starts)
        total = np.cumsum((points + np.uint64(7)) * _POWERS[np.minimum(np.arange(len(points)) - begin, len(_POWERS) - 1)], dtype=np.uint64)
        own = (total - np.where(begin > 0, total[begin - 1], np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93)
        raw = (own ^ (own >> np.uint64(32))).astype(np.uint32).tobytes()
        out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
    return out


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


@remembered
@lru_cache(maxsize=3)
def _compressor(content: bytes):
    shared = zstandard.ZstdCompressionDict(content)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Gains:
    """The gains of words, under each toxic dictionary; found when first asked for."""

    def __init__(self, ordinary: bytes, toxic: tuple[bytes, ...]):
        self.ordinary, self.toxic = _compressor(ordinary), [_compressor(t) for t in toxic]
        self.known: dict[str, int] = {}
        self.earlier: dict[str, int] = {}

    def of(self, found: list[str]) -> np.ndarray:
        """A number for each word, six bits for each toxic dictionary."""
        if len(found) > SLICE:
            return np.concatenate([self.of(found[at : at + SLICE]) for at in range(0, len(found), SLICE)])
        if len(self.known) > REMEMBERED:
            # words used since the last change stay; the others go
            self.earlier, self.known = self.known, {}
        new = []
        for word in set(found).difference(self.known):
            if (code := self.earlier.get(word)) is None:
                new.append(word)
            else:
                self.known[word] = code
        for word, window in zip(new, coded(new)):
            plain, code = len(self.ordinary(window)), 0
            for k, squeeze in enumerate(self.toxic):
                code |= min(MOST_GAIN, max(0, plain - len(squeeze(window)))) << (6 * k)
            self.known[word] = code
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))

    def counts(self, text: str | None) -> np.ndarray:
        """How many windows have each gain: one row of MOST_GAIN + 1 numbers for each toxic dictionary."""
        total = np.zeros((len(self.toxic), MOST_GAIN + 1), dtype=np.int64)
        found = words(text)
        codes = self.of(found)
        for k in range(len(self.toxic)):
            total[k] += np.bincount(codes >> (6 * k) & MOST_GAIN, minlength=MOST_GAIN + 1)
        return total


@remembered
@lru_cache(maxsize=1)
def _remembered(ordinary: bytes, toxic: tuple[bytes, ...]) -> Gains:
    """One for all tasks of a worker that score under the same dictionaries."""
    return Gains(ordinary, toxic)


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few for the trainer."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8, b"\0")


def _spread(texts: list[str], most: int) -> Iterator[str]:
    """Words of the texts, evenly spread, most of them at the utmost."""
    every = max(1, -(-sum(len(words(t)) for t in texts) // most))
    at = 0
    for text in texts:
        found = words(text)
        yield from found[-at % every :: every]
        at += len(found)


def train(ordinary: list[str], toxic: list[str]) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary and the two toxic ones of the texts."""
    plain = dictionary(ORDINARY_BYTES, coded(list(_spread(ordinary, TRAINED))))
    windows = coded(list(_spread(toxic, TRAINED)))
    first = dictionary(TOXIC_BYTES, windows)
    gains = Gains(plain, (first,))
    usual = list(_spread(ordinary, TRAINED))
    least = np.quantile(gains.of(usual), KEPT_SHARE) if usual else 1
    kept = [w for w, gain in zip(windows, gains.of(list(_spread(toxic, TRAINED))).tolist()) if gain >= max(1, least)]
    return plain, [first, dictionary(TOXIC_BYTES, kept)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients, the last one constant, by Newton steps; the ridge weighs as much as one row, so more rows say more."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    penalty = np.eye(x.shape[1]) / len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


class ToxicityModel:
    """Dictionaries, thresholds of the gains and the coefficients of the counts."""

    def __init__(self, rate: float, ordinary: bytes = b"", toxic: list[bytes] | None = None, counts: np.ndarray | None = None, y: np.ndarray | None = None, weight: np.ndarray | None = None):
        """counts: rows by dictionaries by gains, each row's under dictionaries that haven't seen it."""
        self.rate, self.beta = rate, None
        if counts is None:
            return
        self.ordinary, self.toxic = ordinary, toxic
        usual = counts[y == 0].sum(axis=0).cumsum(axis=1)
        self.thresholds = [sorted({max(1, int(np.searchsorted(row, q * row[-1]))) for q in QUANTILES}) for row in usual]
        self.beta = fit_logistic(np.array([self.features(c) for c in counts]), y, weight)

    def features(self, counts: np.ndarray) -> np.ndarray:
        reach = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        return np.concatenate([*(np.log1p(row[cuts]) for row, cuts in zip(reach, self.thresholds)), [np.log1p(counts[0].sum()) / 10]])

    def gains(self) -> Gains | None:
        return None if self.beta is None else _remembered(self.ordinary, tuple(self.toxic))

    def score(self, text: str | None, gains: Gains | None) -> float:
        if gains is None:
            return self.rate
        z = float(self.features(gains.counts(text)) @ self.beta[:-1] + self.beta[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _trained(sample: DataFrame) -> DataFrame:
    """(part, doc_id, label, counts, dictionaries): what each part's dictionaries say of the rows that they left out."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(FOLDS)).cast("int")
    # one task: a part takes some 250 MB while it trains, and parts side by side would add up in an executor
    copies = sample.repartition(1).withColumn("fold", fold).withColumn("part", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))))

    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        part = int(rows["part"].iloc[0])
        texts = lambda label: rows["text"][(rows["fold"] != part) & (rows["label"] == label)].tolist()
        ordinary, toxic = train(texts(0), texts(1))
        if part == FOLDS:
            return pd.DataFrame({"part": [part], "doc_id": [None], "label": [None], "counts": [None], "dictionaries": [[ordinary, *toxic]]})
        rest = rows[rows["fold"] == part]
        gains = Gains(ordinary, tuple(toxic))
        counts = [gains.counts(t).ravel().tolist() for t in rest["text"]]
        return pd.DataFrame({"part": part, "doc_id": rest["doc_id"], "label": rest["label"], "counts": pd.Series(counts, index=rest.index, dtype=object), "dictionaries": None})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        forget(__name__)
        made = trained(rows)
        give_back()
        return made

    return copies.groupBy("part").applyInPandas(run, "part int, doc_id long, label int, counts array<long>, dictionaries array<binary>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = TRAIN_TOXIC, most_ordinary: int = TRAIN_ORDINARY, most_bytes: int = TRAIN_BYTES) -> ToxicityModel:
    """A model of labels.toxic, learned from rows that are not held out."""
    allowed = F.pmod(id_checksum("doc_id"), F.lit(3)) != 1
    sample, counts = labelled_sample(docs, labels, "toxic", allowed, {0: most_ordinary, 1: most_toxic}, most_bytes, id_col, text_col)
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    # a row of counts for each row of the sample, and the last part's dictionaries
    rows = _trained(sample).collect() if min(counts.get(0, 0), counts.get(1, 0)) else []
    seen = sorted((r for r in rows if r["counts"] is not None), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in seen], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(rate)
    share = {k: counts[k] / total / (y == k).sum() for k in (0, 1)}
    ordinary, *toxic = next(bytes_of for r in rows if (bytes_of := r["dictionaries"]))
    found = np.array([r["counts"] for r in seen]).reshape(len(seen), len(toxic), MOST_GAIN + 1)
    return ToxicityModel(rate, bytes(ordinary), [bytes(t) for t in toxic], found, y, np.where(y == 1, share[1], share[0]))


def score(model: ToxicityModel, text: Column) -> Column:
    """The probability that a text is toxic; the model, 50 KB, is sent with the function."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget(__name__)
        gains = model.gains()
        for texts in batches:
            yield pd.Series([model.score(t, gains) for t in texts], dtype="float64")
        give_back()

    return scored(text)
