"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all windows of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.llm.common import labelled_sample

#: Words in a window, and from one window's start to the next; neighbours overlap by the difference.
WINDOW, STRIDE = 32, 16
#: Widths of the word input, the character input and the recurrent state of each direction.
WORD, CHAR, STATE = 8, 8, 8
#: Slots of the hashed character n-grams; most words of the vocabulary, and in how many sample texts one must stand.
GRAMS, VOCABULARY, LEAST_TEXTS = 1 << 14, 20_000, 3
#: Contexts a word or n-gram must have for a leaning: a rare one would only repeat the labels of its own texts.
LEAST_CONTEXTS = 8
#: Most distinct words whose inputs a task keeps, and windows run at once.
CACHE, BATCH = 300_000, 8192

#: Most characters of a token, and how many of them the next one of a longer run repeats, so that no n-gram is lost.
LONGEST, AGAIN = 64, 3

Params = dict[str, np.ndarray]


def tokens(text: str | None) -> list[str]:
    """The words of a text, lower-cased; a longer run without white space is several tokens that overlap."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k:k + LONGEST] for w in words for k in range(0, max(1, len(w) - AGAIN), LONGEST - AGAIN)]


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of every 3- and 4-gram of the words' UTF-8 bytes between boundary marks, by word."""
    raw = np.frombuffer("".join(f"<{bare(w)}>" for w in words).encode("utf-8", "surrogatepass"), np.uint8)
    # Boundary marks inside a word would look like its end; the lengths say where words begin.
    sizes = np.array([len(bare(w).encode("utf-8", "surrogatepass")) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    h, slots, owners = np.zeros(len(raw), np.uint32), [], []
    for n in range(4):
        part = raw[n:].astype(np.uint32) + np.uint32(1)
        h = (h[:len(part)] ^ part) * np.uint32(0x01000193)
        if n >= 2:
            own = word[:len(part)]
            ok = own == word[n:]
            slots.append(((h ^ (h >> np.uint32(15))) % np.uint32(GRAMS))[ok].astype(np.int64))
            owners.append(own[ok])
    # A word without letters is its two marks: slot 0.
    none = np.flatnonzero(sizes < 3)
    slot, owner = np.concatenate([*slots, np.zeros(len(none), np.int64)]), np.concatenate([*owners, none])
    order = np.argsort(owner, kind="stable")
    return slot[order], owner[order]


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE words until one reaches the end; one for an empty text too."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def spread(tokens_: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW) token numbers, `pad` behind the end."""
    at = windows(len(tokens_))[:, None] + np.arange(WINDOW)
    return np.where(at < len(tokens_), np.append(tokens_, pad)[np.minimum(at, len(tokens_))], pad)


def initial(words: int, seed: int) -> Params:
    r = np.random.default_rng(seed)
    width = WORD + CHAR
    p = {"word": r.normal(0, 0.1, (words + 1, WORD)), "gram": r.normal(0, 0.1, (GRAMS, CHAR)), "b": np.zeros(1)}
    p["word"][0] = 0
    for d in "fb":
        p[f"wx{d}"] = r.normal(0, width**-0.5, (width, 3 * STATE))
        p[f"bx{d}"] = np.zeros(3 * STATE)
        p[f"uh{d}"] = r.normal(0, STATE**-0.5, (STATE, 3 * STATE))
        p[f"out{d}"] = r.normal(0, STATE**-0.5, (STATE, 2))  # attention score and value
    return {k: v.astype(np.float32) for k, v in p.items()}


def leanings(key: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` keys, how far its count in toxic texts is from what its count alone makes likely.

    log(1 + |z|) with the sign of z, z = (count - expected) / sqrt(expected + 1); 0 for keys with fewer than LEAST_CONTEXTS.
    """
    of_toxic = np.bincount(key[toxic], minlength=size).astype(np.float64)
    every = np.bincount(key, minlength=size)
    expected = every * (toxic.sum() / max(1, len(toxic)))
    z = np.where(every >= LEAST_CONTEXTS, (of_toxic - expected) / np.sqrt(expected + 1), 0)
    return np.sign(z) * np.log1p(np.abs(z))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def inputs(p: Params, known: np.ndarray, flat: np.ndarray, of: np.ndarray) -> np.ndarray:
    """(distinct words, WORD + CHAR): the word's own vector beside the sum of its character n-grams' vectors over
    the root of their number."""
    n = np.bincount(of, minlength=len(known)).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum(n[:-1])]).astype(np.int64)
    chars = np.add.reduceat(p["gram"][flat], begin, axis=0) / np.sqrt(n)[:, None] if len(flat) else np.zeros((len(known), CHAR), np.float32)
    return np.concatenate([p["word"][known], chars], axis=1)


def pooled(s: np.ndarray, y: np.ndarray, mask: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights and logits from (T, B) scores and values; a window without words has only the bias."""
    s = np.where(mask, s, -np.inf)
    top = s.max(axis=0)
    a = np.exp(s - np.where(np.isfinite(top), top, 0))
    a /= np.maximum(a.sum(axis=0), 1e-30)
    return a, (a * y).sum(axis=0) + b[0]


def logits(p: Params, projected: dict[str, np.ndarray], index: np.ndarray, pad: int) -> np.ndarray:
    """Logit of each window of token numbers; `projected` holds each token's gate inputs in either direction."""
    mask = (index != pad).T
    s = y = 0
    for d in "fb":
        u, out = p[f"uh{d}"], p[f"out{d}"]
        u_gate, u_new = np.ascontiguousarray(u[:, :2 * STATE]), np.ascontiguousarray(u[:, 2 * STATE:])
        gate_in, new_in = projected[f"gate{d}"], projected[f"new{d}"]
        h = np.zeros((len(index), STATE), np.float32)
        both = np.zeros((WINDOW, len(index), 2), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            if not mask[t].any():
                continue
            k = index[:, t]
            g = h @ u_gate
            g += gate_in[k]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            n = h @ u_new
            n *= g[:, :STATE]
            n += new_in[k]
            np.tanh(n, out=n)
            h -= n
            h *= g[:, STATE:]
            h += n
            h *= mask[t][:, None]
            both[t] = h @ out
        s, y = s + both[:, :, 0], y + both[:, :, 1]
    return pooled(s, y, mask, p["b"])[1]


def gradients(p: Params, known: np.ndarray, flat: np.ndarray, of: np.ndarray, index: np.ndarray, pad: int, target: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the mean logistic loss over the windows, and the windows' logits."""
    x = inputs(p, known, flat, of)
    mask = (index != pad).T
    keep: dict[str, list] = {}
    s = y = 0
    for d in "fb":
        a = np.vstack([x @ p[f"wx{d}"] + p[f"bx{d}"], np.zeros((1, 3 * STATE), np.float32)])
        h, steps, both = np.zeros((len(index), STATE), np.float32), [], np.zeros((WINDOW, len(index), 2), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            k, u = a[index[:, t]], h @ p[f"uh{d}"]
            g = sigmoid(k[:, :2 * STATE] + u[:, :2 * STATE])
            r, z, c = g[:, :STATE], g[:, STATE:], u[:, 2 * STATE:]
            n = np.tanh(k[:, 2 * STATE:] + r * c)
            new = (n + z * (h - n)) * mask[t][:, None]
            steps.append((t, h, r, z, c, n, new))
            h = new
            both[t] = h @ p[f"out{d}"]
        keep[d] = steps
        s, y = s + both[:, :, 0], y + both[:, :, 1]
    att, logit = pooled(s, y, mask, p["b"])
    dl = (sigmoid(logit) - target).astype(np.float32) / len(target)
    dy = att * dl
    ds = dy * (y - (att * y).sum(axis=0))
    g: Params = {"b": np.array([dl.sum()], np.float32)}
    dx = np.zeros_like(x)
    for d in "fb":
        u, out = p[f"uh{d}"], p[f"out{d}"]
        deltas = []
        du, dout, dh = np.zeros_like(u), np.zeros_like(out), np.zeros((len(index), STATE), np.float32)
        for t, h, r, z, c, n, new in reversed(keep[d]):
            dsy = np.stack([ds[t], dy[t]], axis=1)
            dout += new.T @ dsy
            dh = (dh + dsy @ out.T) * mask[t][:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            dk = np.concatenate([dr, dz, dn], axis=1)
            dup = np.concatenate([dr, dz, dn * r], axis=1)
            deltas.append((t, dk))
            du += h.T @ dup
            dh = dh * z + dup @ u.T
        at = np.concatenate([index[:, t] for t, _ in deltas])
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        da = np.zeros((len(x) + 1, 3 * STATE), np.float32)
        da[at[begin]] = np.add.reduceat(np.concatenate([k for _, k in deltas])[order], begin, axis=0)
        da = da[:-1]
        g |= {f"uh{d}": du, f"out{d}": dout, f"bx{d}": da.sum(axis=0), f"wx{d}": x.T @ da}
        dx += da @ p[f"wx{d}"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], known, dx[:, :WORD])
    g["word"][0] = 0
    g["gram"] = np.zeros_like(p["gram"])
    n = np.bincount(of, minlength=len(known)).astype(np.float32)
    np.add.at(g["gram"], flat, (dx[:, WORD:] / np.sqrt(np.maximum(n, 1))[:, None])[of])
    return g, logit


def fit(texts: list[str], labels: list[int], passes: int = 3, least_steps: int = 150, batch: int = 512, rate: float = 0.03, table_rate: float = 0.3, seed: int = 7) -> dict:
    """The network and its calibration from labelled texts (the bounded sample).

    A text's label says only that some window of it is toxic. Windows take their text's label at first; now and
    then those of toxic texts keep it only if the network finds them the likelier ones (its best window always does). In
    training a third of the words stand without their own vector, so that the characters have to tell as well. A
    text's logit is the highest of its windows; a logistic curve on it gives the score. With one class only
    there is nothing to learn and the score is that class.
    """
    if len(set(labels)) < 2:
        return {"constant": float(labels[0]) if labels else 0.0}
    split = [tokens(t) for t in texts]
    seen = Counter(w for t in split for w in {bare(x) for x in t})
    vocabulary = {w: i + 1 for i, (w, _) in enumerate(sorted(((w, n) for w, n in seen.items() if n >= LEAST_TEXTS and w), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in split]
    pad, names = len(number), list(number)
    known = np.array([vocabulary.get(bare(w), 0) for w in names] + [0], np.int64)
    flat_all, of_all = grams(names)
    first = np.searchsorted(of_all, np.arange(len(names) + 1))
    index = np.concatenate([spread(c, pad) for c in coded])
    text_of = np.repeat(np.arange(len(coded)), [len(windows(len(c))) for c in coded])
    doc = np.array(labels, np.float32)
    target = doc[text_of].copy()
    r, p = np.random.default_rng(seed), initial(len(vocabulary), seed)
    # Words and n-grams start with their leaning as first coordinate. A word counts once for each word before it, so
    # that copies of a text, which repeat its contexts, do not make all of its words lean.
    met = np.unique(np.concatenate([np.stack([np.append(-1, c[:-1]), c, np.full(len(c), int(y))], axis=1) for c, y in zip(coded, labels) if len(c)]
                                   or [np.zeros((0, 3), np.int64)]), axis=0)
    toxic = met[:, 2] == 1
    p["word"][:, 0] = leanings(known[met[:, 1]], toxic, len(vocabulary) + 1)
    p["word"][0] = 0
    many = (first[1:] - first[:-1])[met[:, 1]]
    spots = np.arange(many.sum()) + np.repeat(first[met[:, 1]] - np.cumsum(many) + many, many)
    p["gram"][:, 0] = leanings(flat_all[spots], np.repeat(toxic, many), GRAMS)
    # A small sample is gone through more often, so that the weights get as many steps as they need.
    batch = min(batch, max(32, len(index) // 8))
    epochs = max(passes, -(-least_steps // max(1, len(index) // batch)))
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0

    def scored() -> np.ndarray:
        proj = project(p, known[:-1], flat_all, of_all)
        return np.concatenate([logits(p, proj, index[k:k + BATCH], pad) for k in range(0, len(index), BATCH)])

    for epoch in range(epochs):
        for rows in np.array_split(r.permutation(len(index)), max(1, len(index) // batch)):
            own, local = np.unique(np.append(index[rows], pad), return_inverse=True)
            local, own = local[:-1].reshape(len(rows), WINDOW), own[:-1]
            if not len(own):
                continue
            many = first[own + 1] - first[own]
            of = np.repeat(np.arange(len(own)), many)
            flat = flat_all[np.arange(len(of)) + np.repeat(first[own] - np.cumsum(many) + many, many)]
            shown = known[own] * (r.random(len(own)) > 1 / 3)
            g, _ = gradients(p, shown, flat, of, local, len(own), target[rows])
            step += 1
            pace = rate * min(1, step / 20) * (1 - 0.9 * step / (epochs * max(1, len(index) // batch) + 1))
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                p[k] -= (pace * (table_rate if k in ("word", "gram") else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if epoch % max(1, epochs // passes) and epoch + 1 < epochs:
            continue
        at = scored()
        best = np.full(len(doc), -np.inf)
        np.maximum.at(best, text_of, at)
        # The likelier half between what a clean text's best window gets and this text's best one.
        clean = np.median(best[doc == 0])
        target = (doc[text_of] * (at >= np.minimum(best[text_of], (best[text_of] + clean) / 2))).astype(np.float32)
    a, b = 1.0, 0.0
    top = best
    for _ in range(200):  # logistic curve of slope a and offset b; ridge keeps it finite for classes apart
        q = sigmoid(a * top + b) - doc
        wgt = np.maximum(sigmoid(a * top + b) * (1 - sigmoid(a * top + b)), 1e-4)
        grad = np.array([(q * top).sum() + 0.1 * (a - 1), q.sum() + 0.01 * b])
        hess = np.array([[(wgt * top * top).sum() + 0.1, (wgt * top).sum()], [(wgt * top).sum(), wgt.sum() + 0.01]])
        move = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = max(0.05, a - move[0]), b - move[1]
    low, high = top[doc == 0].max(), np.quantile(top[doc == 1], 0.02)
    if low < high:
        # Classes apart: the score that decides, 0.7, lies midway between them.
        b = np.log(0.7 / 0.3) - a * (low + high) / 2
    return {"params": p, "vocabulary": vocabulary, "curve": (float(a), float(b))}


def project(p: Params, known: np.ndarray, flat: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
    """Gate inputs of distinct words in either direction, with a row of zeros at the end for the padding."""
    x, out = inputs(p, known, flat, of), {}
    for d in "fb":
        a = np.vstack([x @ p[f"wx{d}"] + p[f"bx{d}"], np.zeros((1, 3 * STATE), np.float32)])
        out[f"gate{d}"], out[f"new{d}"] = np.ascontiguousarray(a[:, :2 * STATE]), np.ascontiguousarray(a[:, 2 * STATE:])
    return out


class Inputs:
    """Gate inputs of the words met so far, numbered as they come; forgotten when there are CACHE of them."""

    def __init__(self, model: dict):
        self.model, self.number, self.new, self.tables = model, {}, [], None

    def code(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, from 1; number 0 is the padding."""
        get, out = self.number.get, []
        for w in tokens(text):
            k = get(w)
            if k is None:
                k = self.number[w] = len(self.number) + 1
                self.new.append(w)
            out.append(k)
        return np.array(out, np.int64)

    def projected(self) -> dict[str, np.ndarray]:
        if self.new or self.tables is None:
            known = np.array([self.model["vocabulary"].get(bare(w), 0) for w in self.new], np.int64)
            more = project(self.model["params"], known, *grams(self.new)) if self.new else {}
            old = self.tables or {f"{k}{d}": np.zeros((1, n * STATE), np.float32) for d in "fb" for k, n in (("gate", 2), ("new", 1))}
            self.tables = {k: np.concatenate([v, more[k][:-1]]) if self.new else v for k, v in old.items()}
            self.new = []
        return self.tables


def score(model: dict, texts: Iterator[str | None]) -> Iterator[float]:
    """Scores in order. Texts are taken together until they hold BATCH windows; a long one runs alone."""
    if "constant" in model:
        yield from (model["constant"] for _ in texts)
        return
    group, n, known = [], 0, Inputs(model)
    for text in texts:
        group.append(known.code(text))
        n += len(windows(len(group[-1])))
        if n >= BATCH:
            yield from run(model, group, known)
            group, n = [], 0
            known = known if len(known.number) < CACHE else Inputs(model)
    if group:
        yield from run(model, group, known)


def run(model: dict, group: list[np.ndarray], known: Inputs) -> list[float]:
    p, proj = model["params"], known.projected()
    index = np.concatenate([spread(c, 0) for c in group])
    at = np.concatenate([logits(p, proj, index[k:k + BATCH], 0) for k in range(0, len(index), BATCH)])
    begin = np.concatenate([[0], np.cumsum([len(windows(len(c))) for c in group])[:-1]]).astype(np.int64)
    a, b = model["curve"]
    return sigmoid(a * np.maximum.reduceat(at, begin).astype(np.float64) + b).tolist()


def train(docs: DataFrame, labels: DataFrame, bound: int = 1500, modulus: int = 3, remainder: int = 1,
          doc_id: str = "doc_id", text: str = "text", target: str = "toxic") -> dict:
    """The model of `fit` from at most `bound` labelled texts that are not held out; these reach the driver."""
    rows = labelled_sample(docs, labels, target, modulus, remainder, bound, doc_id, text).toPandas().sort_values(["_id", "text"])
    return fit(rows["text"].tolist(), rows["y"].astype(int).tolist())


def scorer(spark, model: dict):
    """Column -> column of scores of a trained model; texts stream through in bounded groups of windows."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(shared.value, iter(texts)), dtype="float64")

    return scored


def with_score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the toxicity of each whole text, 0 to 1, the highest of all its windows.

    Null text is empty: one window without words. Every row is scored from its text alone, repeated ones too; an
    empty table gives no rows; a column called `name` would be replaced.
    """
    value: Column = scorer(docs.sparkSession, model)(F.col(text))
    return docs.withColumn(name, value)
