"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes. One recurrent layer
runs forward, one backward; from both states every byte gets a probability per
language, and a document's probabilities are the mean over all its bytes. The
network is trained here in numpy by backpropagation through time, with the
language of the document as every position's label.

Learning uses every language that has a text that is not held out and not empty,
and of each at most SAMPLE documents, the first by a hash of the id, and of a
document at most CHARS characters from a place that the hash gives; many
languages share ROWS documents, at least FEWEST each. These bound what is learned
from, never what is labelled. The states grow with the
languages. Windows that a text's end leaves partial are learned with a mask. Prediction
reads every byte of every text; windows, not texts, are the unit of work, so
that very long texts need no more memory.

Defined cases: null texts and texts without a letter are `und` with score 0; a
null lang is not learned from; repeated rows are predicted each; ties go to the
first language in order; if nothing can be learned every text is `und`; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import held_out, id_text, ids

WINDOW = 64
HIDDEN = 8
SAMPLE = 400
#: Documents that all languages share, and the least that each has.
ROWS = 28_000
FEWEST = 16
#: Characters that one document gives to learning.
CHARS = 4000
STEPS = 220
BATCH = 256
RATE = 0.02
SEED = 5
#: Windows that are run at once.
WIDTH = 4096

Model = dict[str, np.ndarray]


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (time, window), valid bytes of each window, and each window's text."""
    raw = [(t or "").encode() for t in texts]
    counts = np.array([-(-len(b) // WINDOW) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(c * WINDOW, b"\0") for b, c in zip(raw, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raw)), counts)
    valid = np.full(len(flat), WINDOW, np.int64)
    ends = np.cumsum(counts)
    for i, b in enumerate(raw):
        if len(b) % WINDOW:
            valid[ends[i] - 1] = len(b) % WINDOW
    return flat.T, valid, owner


def hidden_for(n_languages: int) -> int:
    """States of a layer: HIDDEN up to 8 languages, then one more for every 2, at most 64."""
    return int(min(64, max(HIDDEN, HIDDEN + (n_languages - 8) // 2)))


def new_model(n_languages: int) -> Model:
    r = np.random.default_rng(SEED)
    h = hidden_for(n_languages)
    draw = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
    return {
        "wf": draw(3 * h, 256, scale=0.5), "uf": draw(3 * h, h, scale=h**-0.5), "wb": draw(3 * h, 256, scale=0.5), "ub": draw(3 * h, h, scale=h**-0.5),
        "v": draw(n_languages, 2 * h, scale=(2 * h) ** -0.5), "c": np.zeros((n_languages, 1), np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _step(w: np.ndarray, u: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a gated recurrent unit for bytes x and states h: the new state and what backpropagation needs."""
    k = u.shape[1]
    g, a = np.take(w, x, axis=1), u @ h
    zr = _sigmoid(g[: 2 * k] + a[: 2 * k])
    z, r = zr[:k], zr[k:]
    n = np.tanh(g[2 * k :] + r * a[2 * k :])
    return n + z * (h - n), z, r, n, a[2 * k :]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def position_sums(model: Model, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """(language, window): the sum of each window's position probabilities."""
    t_all, b = x.shape
    size = model["uf"].shape[1]
    state = np.zeros((size, b), np.float32)
    ahead = np.empty((t_all, size, b), np.float32)
    for t in range(t_all):
        state = ahead[t] = _step(model["wf"], model["uf"], x[t], state)[0]
    out = np.zeros((len(model["v"]), b), np.float32)
    state = np.zeros((size, b), np.float32)
    vf, vb = model["v"][:, :size], model["v"][:, size:]
    whole = valid.min(initial=t_all)
    for t in range(t_all - 1, -1, -1):
        if t >= whole:  # padding leaves the backward state at zero
            state = _step(model["wb"], model["ub"], x[t], state)[0] * (t < valid)
            out += _softmax(vf @ ahead[t] + vb @ state + model["c"]) * (t < valid)
        else:
            state = _step(model["wb"], model["ub"], x[t], state)[0]
            out += _softmax(vf @ ahead[t] + vb @ state + model["c"])
    return out


def _run(w: np.ndarray, u: np.ndarray, x: np.ndarray, mask: np.ndarray) -> list[tuple]:
    """Steps through x (time, window); where mask is 0 the state is zero."""
    h = np.zeros((u.shape[1], x.shape[1]), np.float32)
    tape = []
    for row, keep in zip(x, mask, strict=True):
        new, *rest = _step(w, u, row, h)
        new = new * keep
        tape.append((row, h, *rest, new))
        h = new
    return tape


def _back(w: np.ndarray, u: np.ndarray, tape: list[tuple], d_out: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u by backpropagation through time; d_out: the loss's gradient at each step's state."""
    dw, du = np.zeros_like(w), np.zeros_like(u)
    carry = np.zeros_like(tape[0][1])
    steps, grads = [], []
    for (x, h, z, r, n, a, _), d, keep in zip(reversed(tape), reversed(d_out), mask[::-1], strict=True):
        d = (d + carry) * keep
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        through = np.concatenate([dz, dr, dn * r])
        du += through @ h.T
        carry = d * z + u.T @ through
        steps.append(x)
        grads.append(np.concatenate([dz, dr, dn]))
    x, g = np.concatenate(steps), np.concatenate(grads, axis=1)
    for row in range(len(w)):
        dw[row] = np.bincount(x, weights=g[row], minlength=256)
    return dw, du


def gradients(model: Model, x: np.ndarray, labels: np.ndarray, valid: np.ndarray | None = None) -> tuple[float, Model]:
    """Mean cross-entropy over all valid positions of windows x (time, window), and its gradients; windows are full if valid is not given."""
    mask = np.arange(len(x))[:, None] < (np.full(x.shape[1], len(x)) if valid is None else valid)
    mask = mask.astype(np.float32)
    n, size = int(mask.sum()), model["uf"].shape[1]
    f, b = _run(model["wf"], model["uf"], x, mask), _run(model["wb"], model["ub"], x[::-1], mask[::-1])
    v, one_hot = model["v"], np.eye(len(model["v"]), dtype=np.float32)[labels].T
    dv, dc, loss, df, db = np.zeros_like(v), np.zeros_like(model["c"]), 0.0, [], []
    for t in range(len(x)):
        h = np.concatenate([f[t][-1], b[len(x) - 1 - t][-1]])
        p = _softmax(v @ h + model["c"])
        loss -= float(np.log(np.maximum((p * one_hot).sum(0), 1e-12)) @ mask[t])
        d = (p - one_hot) * mask[t] / n
        dv += d @ h.T
        dc += d.sum(1, keepdims=True)
        dh = v.T @ d
        df.append(dh[:size])
        db.append(dh[size:])
    dwf, duf = _back(model["wf"], model["uf"], f, df, mask)
    dwb, dub = _back(model["wb"], model["ub"], b, db[::-1], mask[::-1])
    return loss / n, {"wf": dwf, "uf": duf, "wb": dwb, "ub": dub, "v": dv, "c": dc}


def fit(texts: list[str], labels: list[int], n_languages: int) -> Model | None:
    """Train on windows drawn evenly over languages; no model without a window."""
    x, valid, owner = windows_of(texts)
    model = new_model(n_languages)
    lab = np.array(labels)[owner]
    pools = [p for k in range(n_languages) if len(p := np.flatnonzero(lab == k))]
    if not pools:
        return None
    r = np.random.default_rng(SEED)
    m, s = ({k: np.zeros_like(w) for k, w in model.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = np.concatenate([r.choice(p, max(4, -(-BATCH // len(pools)))) for p in pools])
        _, grad = gradients(model, x[:, pick], lab[pick], valid[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grad.items():
            g = (g / max(1.0, norm)).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame) -> tuple[list[str], Model | None]:
    """Learn from a bounded sample of documents that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.col("text") != ""))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return [], None
    most = min(SAMPLE, max(FEWEST, ROWS // len(languages)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # top-k by hash, of ids alone
    chosen = known.select("lang", "doc_id").withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= most).select("lang", "doc_id")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).filter(F.col("text") != "")
    rows = [(r["lang"], r["doc_id"], r["t"]) for r in texts.select("lang", "doc_id", F.substring("text", at, F.lit(CHARS)).alias("t")).dropDuplicates(["lang", "doc_id"]).collect()]
    rows.sort()
    if not rows:
        return languages, None
    return languages, fit([t for _, _, t in rows], [languages.index(k) for k, _, _ in rows], len(languages))


def predict(texts: list[str | None], languages: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and mean probability of each whole text."""
    lettered = [model is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not any(lettered):
        return names, scores
    sums, sizes = np.zeros((len(languages), len(texts))), np.zeros(len(texts))
    for lo, hi in _slices(texts):
        x, valid, owner = windows_of(texts[lo:hi])
        width = max(64, min(WIDTH, WIDTH * 128 // len(languages)))
        for i in range(0, x.shape[1], width):
            got = position_sums(model, np.ascontiguousarray(x[:, i : i + width]), valid[i : i + width])
            own = owner[i : i + width] + lo
            for k in range(len(languages)):
                sums[k] += np.bincount(own, weights=got[k], minlength=len(texts))
            sizes += np.bincount(own, weights=valid[i : i + width], minlength=len(texts))
    mean = sums / np.maximum(sizes, 1)
    best = mean.argmax(0)
    for i, ok in enumerate(lettered):
        if ok:
            names[i], scores[i] = languages[best[i]], float(min(1.0, mean[best[i], i]))
    return names, scores


def _slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    languages, model = train(docs)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores = predict(pdf["text"].where(pdf["text"].notna(), None).tolist(), languages, model)
            yield pd.DataFrame({"doc_id": ids(pdf["doc_id"]), "held_out": pdf["held_out"], "lang_pred": names, "score": scores})

    rows = docs.select(id_text("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(label, "doc_id long, held_out boolean, lang_pred string, score double")
