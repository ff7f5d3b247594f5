"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of its hash beside the scaled sum of the embeddings of the
character n-grams inside it. Gated recurrent units read each window in both directions, attention pools their
states, and a logistic unit scores the window. All overlapping windows of a whole text are
scored; a calibrated combination of them scores the document. A word over 48 bytes, as a run of
text without blanks is, counts as several words: pieces that overlap so that each n-gram of the
run is whole in one of them, alike in training and scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 64, 48
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN, ATTEND = 1 << 15, 1 << 16, 16, 8, 8
WORD = re.compile(r"[^\W_]+")
#: Bytes of a word at most, and characters that two pieces of a longer one share.
LONGEST, SHARED = 48, 4
#: Documents of each label, and windows of a document, that training takes at most by default.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 6


#: Share of words whose own embedding is left out of a training step.
DROPPED = 0.5


def cut(word: str) -> list[str]:
    """The word, or its overlapping pieces of ``LONGEST`` bytes at most, whole characters each."""
    if len(word.encode("utf-8", "surrogatepass")) <= LONGEST:
        return [word]
    size = LONGEST // len(max(word).encode("utf-8", "surrogatepass"))  # the last code point is the widest
    return [word[at:at + size] for at in range(0, len(word) - SHARED, size - SHARED)]


def words_of(text: str | None) -> list[str]:
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONGEST // 4:
        return words
    return [p for w in words for p in (cut(w) if len(w) > LONGEST // 4 else (w,))]


def starts_of(n: int) -> range:
    """Starts of the overlapping windows that cover ``n`` words."""
    return range(0, max(1, n - (WINDOW - STEP)), STEP) if n else range(0)


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character n-grams (3 and 5 bytes, edges marked) of all words, and each word's first."""
    marked = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # bytes to the word's end, its own included
    owner = np.repeat(np.arange(len(words)), sizes)
    padded = np.concatenate([flat, np.zeros(5, np.uint64)])
    ids, whose = [], []
    for n in (3, 5):
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x100000001B3) + padded[at + i]
        ids.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % GRAM_ROWS)
        whose.append(owner[at])
    ids, whose = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return ids[order], np.searchsorted(whose[order], np.arange(len(words)))


def word_ids(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words], np.int64)


def inputs(model: dict, words: list[str]) -> np.ndarray:
    """One input row per word: its own embedding, and its n-grams' sum over the root of their number."""
    grams, first = gram_ids(words)
    number = np.diff(np.append(first, len(grams)))
    total = np.add.reduceat(model["grams"][grams], first, axis=0) / np.sqrt(number)[:, None]
    return np.concatenate([model["words"][word_ids(words)], total], axis=1).astype(np.float32)


def fresh(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)

    def dense(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    model = {"words": np.zeros((WORD_ROWS, WIDTH), np.float32),
             "grams": (0.1 * rng.standard_normal((GRAM_ROWS, WIDTH))).astype(np.float32)}
    for way in "fb":
        model |= {f"W{way}": dense(2 * WIDTH, 3 * HIDDEN), f"U{way}": dense(HIDDEN, 3 * HIDDEN),
                  f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
    return model | {"A": dense(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": dense(ATTEND),
                    "w": dense(2 * HIDDEN), "k": np.zeros(1, np.float32)}


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(projected: np.ndarray, rows: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """States of one direction, ``[time, window, hidden]``, and what a gradient needs."""
    n, length = rows.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, saved = np.empty((length, n, HIDDEN), np.float32), []
    for t in range(length - 1, -1, -1) if back else range(length):
        x, g = projected[rows[:, t]], h @ u
        gates = _gate(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        m = mask[:, t, None]
        if keep:
            saved.append((t, h, g, z, r, new, m))
        h = h + m * (1 - z) * (new - h)
        states[t] = h
    return states, saved


def forward(model: dict, projected: dict, rows: np.ndarray, keep: bool = False):
    """Logits of windows given as rows of the projected inputs; row 0 is padding."""
    mask = (rows > 0).astype(np.float32)
    parts = [_read(projected[way], rows, mask, model[f"U{way}"], way == "b", keep) for way in "fb"]
    states = np.concatenate([p[0] for p in parts], axis=2)
    look = np.tanh(states @ model["A"] + model["a"])
    score = np.where(mask.T > 0, look @ model["v"], -1e9)
    share = np.exp(score - score.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[:, :, None] * states).sum(axis=0)
    logit = pooled @ model["w"] + model["k"][0]
    return (logit, (mask, parts, states, look, share, pooled)) if keep else logit


def project(model: dict, x: np.ndarray) -> dict:
    x = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
    return {way: x @ model[f"W{way}"] + model[f"c{way}"] for way in "fb"}


def gradients(model: dict, x: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean log loss: of the dense weights, and of each input row."""
    logit, (mask, parts, states, look, share, pooled) = forward(model, project(model, x), rows, keep=True)
    p = _gate(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    d = ((p - labels) / len(labels)).astype(np.float32)
    out = {"w": pooled.T @ d, "k": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * model["w"]
    d_states = share[:, :, None] * d_pooled
    d_share = (states * d_pooled).sum(axis=2)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    d_look = d_score[:, :, None] * model["v"] * (1 - look * look)
    out["v"] = (d_score[:, :, None] * look).sum(axis=(0, 1))
    out["A"] = np.einsum("tnh,tna->ha", states, d_look)
    out["a"] = d_look.sum(axis=(0, 1))
    d_states = d_states + d_look @ model["A"].T
    padded = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
    d_x = np.zeros_like(padded)
    for i, way in enumerate("fb"):
        u, d_h = model[f"U{way}"], np.zeros((len(labels), HIDDEN), np.float32)
        d_u, d_rows = np.zeros_like(u), np.zeros((len(padded), 3 * HIDDEN), np.float32)
        for t, h, g, z, r, new, m in reversed(parts[i][1]):
            d_h = d_h + d_states[t][:, i * HIDDEN:(i + 1) * HIDDEN]
            d_new = m * d_h * (1 - z) * (1 - new * new)
            d_z = m * d_h * (h - new) * z * (1 - z)
            d_r = d_new * g[:, 2 * HIDDEN:] * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], axis=1)
            d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_rows, rows[:, t], d_in)
            d_u += h.T @ d_g
            d_h = d_h * (1 - m * (1 - z)) + d_g @ u.T
        d_rows[0] = 0
        out[f"U{way}"], out[f"W{way}"], out[f"c{way}"] = d_u, padded.T @ d_rows, d_rows.sum(axis=0)
        d_x += d_rows @ model[f"W{way}"].T
    return out, d_x[1:], loss


def train(windows: list[list[str]], labels: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 5) -> dict:
    """The network fitted to labelled windows: Adam on the dense weights, Adagrad on embeddings."""
    model, rng = fresh(), np.random.default_rng(seed)
    dense = [k for k in model if k not in ("words", "grams")]
    first, second = ({k: np.zeros_like(model[k]) for k in dense} for _ in range(2))
    seen = {"words": np.full(WORD_ROWS, 1e-6, np.float32), "grams": np.full(GRAM_ROWS, 1e-6, np.float32)}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            known: dict[str, int] = {}
            rows = np.zeros((len(own), WINDOW), np.int64)
            for i, j in enumerate(own):
                for t, w in enumerate(windows[j]):
                    rows[i, t] = known.setdefault(w, len(known) + 1)
            if not known:
                continue
            words = list(known)
            x = inputs(model, words)
            # Some words go by their characters alone, so that these learn what forms have in common.
            known_word = rng.random(len(words)) >= DROPPED
            x[:, :WIDTH] *= known_word[:, None]
            grads, d_x, _ = gradients(model, x, rows, labels[own].astype(np.float32))
            d_x[:, :WIDTH] *= known_word[:, None]
            step += 1
            for k in dense:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            grams, begin = gram_ids(words)
            number = np.diff(np.append(begin, len(grams)))
            for table, ids, grad in (
                ("words", word_ids(words), d_x[:, :WIDTH]),
                ("grams", grams, np.repeat(d_x[:, WIDTH:] / np.sqrt(number)[:, None], number, axis=0)),
            ):
                rows_, inverse = np.unique(ids, return_inverse=True)
                total = np.zeros((len(rows_), WIDTH), np.float32)
                np.add.at(total, inverse, grad)
                seen[table][rows_] += (total**2).mean(axis=1)
                model[table][rows_] -= 0.05 * total / np.sqrt(seen[table][rows_])[:, None]
    return model


class Scorer:
    """Logits of all windows of texts; the projection of a known word is kept, up to ``cache`` words."""

    def __init__(self, model: dict, cache: int = 150_000):
        self.model, self.size = model, cache
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = {w: v for w, v in project(self.model, np.zeros((0, 2 * WIDTH), np.float32)).items()}
        self.used = 1

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            more = project(self.model, inputs(self.model, new))
            for way in "fb":
                if self.used + len(new) > len(self.table[way]):
                    grown = np.empty((2 * (self.used + len(new)), 3 * HIDDEN), np.float32)
                    grown[:self.used] = self.table[way][:self.used]
                    self.table[way] = grown
                self.table[way][self.used:self.used + len(new)] = more[way][1:]
            self.known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def logits(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """One array of window logits per text, in batches of windows of bounded size."""
        out: list[list[np.ndarray]] = []
        owners, windows = [], []

        def flush() -> None:
            if windows:
                rows = np.stack(windows)
                for owner, logit in zip(owners, forward(self.model, self.table, rows)):
                    out[owner].append(logit)
                owners.clear()
                windows.clear()

        for k, text in enumerate(texts):
            out.append([])
            words = words_of(text)
            for part in range(0, len(words), STEP * 1024):  # long texts go through in parts
                if len(self.known) > self.size:
                    flush()
                    self._clear()
                rows = self._rows(words[part:part + STEP * 1024 + WINDOW - STEP])
                for s in starts_of(len(rows)):
                    if part and s + part >= max(1, len(words) - (WINDOW - STEP)):
                        break
                    row = np.zeros(WINDOW, np.int64)
                    row[:min(WINDOW, len(rows) - s)] = rows[s:s + WINDOW]
                    windows.append(row)
                    owners.append(k)
                    if len(windows) == 1024:
                        flush()
        flush()
        return [np.array(x, np.float64) for x in out]


def features(logits: np.ndarray) -> np.ndarray:
    """What the document's score combines: highest logit, mean and sum of probabilities, length."""
    if not len(logits):
        return np.array([-8.0, 0.0, 0.0, 0.0])
    logits = np.clip(logits, -8, 8)
    p = 1 / (1 + np.exp(-logits))
    return np.array([logits.max(), p.mean(), np.log1p(p.sum()), np.log(len(logits))])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton's method, constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
    return b


def fit(
    docs: DataFrame, id_: str, text: str, labels: DataFrame, label: str, sample_docs: int = SAMPLE_DOCS,
    sample_windows: int | None = SAMPLE_WINDOWS,
) -> tuple | None:
    """Model and calibration from labelled rows whose crc32 of the id modulo 5 is not 0.

    At most ``sample_docs`` documents of each label, those of the least id hash, are used, and of
    each at most ``sample_windows`` evenly spaced windows (None: all); the driver gets these
    words only. A fifth of them calibrates instead of training, on all windows of the whole
    text. None if either label is absent.
    """
    known = labels.select(F.col(id_).alias("id"), F.col(label).cast("int").alias("y")).filter("y is not null and id is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not (total.get(0) and total.get(1)):
        return None
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy("h", "id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("tune", F.pmod(F.shiftright("h", 20), F.lit(5)) == 0)
    texts = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    @F.pandas_udf("array<string>")
    def spread(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for value in part:
                words = words_of(value)
                starts = np.array(starts_of(len(words)))
                if sample_windows is not None and len(starts) > sample_windows:
                    starts = starts[np.linspace(0, len(starts) - 1, sample_windows).astype(int)]
                out.append([" ".join(words[s:s + WINDOW]) for s in starts])
            yield pd.Series(out, dtype=object)

    rows = texts.filter("not tune").select("id", "y", spread("text").alias("windows")).toPandas().sort_values("id", kind="stable")
    pool: dict[str, str] = {}  # one object per word
    windows = [[pool.setdefault(w, w) for w in window.split(" ")] for own in rows["windows"] for window in own]
    truth = np.repeat(rows["y"].to_numpy(), rows["windows"].map(len))
    if len(set(truth)) < 2:
        return None
    model = train(windows, truth)
    tuned = _features(texts.filter("tune").select("id", "y", "text"), "text", model).select("id", "y", "found").toPandas()
    tuned = tuned.sort_values("id", kind="stable")
    if tuned["y"].nunique() < 2:
        return model, np.array([-1.0, 1.0, 1.0, 0.0, 0.0])
    y = tuned["y"].to_numpy()
    share = {k: total[k] / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.array([share[k] for k in y])
    return model, calibrate(np.stack(tuned["found"]), y, weight * len(y) / weight.sum())


def held_out(id_) -> object:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(5)) == 0


def _features(docs: DataFrame, text: str, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in parts:
            yield pd.Series([features(x) for x in scorer.logits(part)], dtype=object)

    return docs.withColumn("found", found(F.col(text)))


def score(docs: DataFrame, text: str, fitted: tuple | None, out: str = "score") -> DataFrame:
    """``docs`` with the probability ``out`` that each whole text is toxic.

    Nothing but the text enters. Null and empty texts, and all texts if nothing could be
    fitted, score 0; very long texts pass in parts, every window scored; repeated rows score
    alike; an empty table stays empty; other columns pass through, one named ``out`` is
    replaced. Rows are scored where they are read: no shuffle.
    """
    if fitted is None:
        return docs.withColumn(out, F.lit(0.0))
    model, b = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in parts:
            logits = scorer.logits(part)
            z = np.array([b[0] + features(x) @ b[1:] if len(x) else -np.inf for x in logits], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z))

    return docs.withColumn(out, toxic(F.col(text)))
