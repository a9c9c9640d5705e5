"""Abusive, hateful or sexual content (problem 9).

A bidirectional gated recurrent network with attention pooling, written and
trained in numpy.  Its input per word is a word vector (hashed) beside the mean
of its character vectors (hashed trigrams and the word's consonants), so
spellings that hide a word still resemble it.  It scores all windows of
`WINDOW` words that begin every `STRIDE` words of the whole text.  What counts is
the geometric mean over a committee of networks of the same kind, trained from
other seeds and with other shares of swapped words: single networks err on
different windows, and one that is sure a window is clean weighs much.  Where only
scores from a threshold up are asked for, a window is dropped as soon as the
networks left could not keep its mean there; scores are at most 1, so often the
first network settles it, and the scores given out are the same.  A document's
score is that of its worst window.  Networks are fitted by `train` on at most
`TRAIN_DOCS` rated documents: in documents rated abusive the window that the
current network finds worst counts as abusive, all windows of others as clean,
and ratings the network strongly contradicts are left out of later passes.  From
the second pass on, up to `UNRATED_DOCS` documents without a rating take part
where the network is sure of them.  `fit_abuse` fits the committee of the model
file, the same on every run, and measures it on rows it never saw.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 24, 12
HIDDEN, EMBED, BUCKETS = 16, 16, 4096
TRAIN_DOCS, UNRATED_DOCS = 16_000, 20_000
THRESHOLD = 0.25
MEMO = 150_000
BATCH = 256
MODEL = Path(__file__).parent / "models" / "abuse.npz"

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгπαεορυνικτ", "aeopcyxijsdhkmtbhrnaeopyvikt")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: Signs that stand for letters (fixed values).
_SIGNS = str.maketrans("013457$@!", "oieastsai")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._-]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[$@]?[^\W_]+(?:[*@$!]+[^\W_]+)*")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{6,}$")
_VOWELS = re.compile(r"[aeiouäöüáéíóúàèâêîôû*]+")


def surface_tokens(text: str) -> list[str]:
    """Tokens of a text, letter-spaced words joined, look-alike letters made Latin."""
    if text.isascii():
        s = text.lower()
    else:
        s = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text).casefold()).translate(_LOOKALIKES)
    return _TOKEN.findall(_SPACED.sub(lambda m: re.sub(r"[ ._-]", "", m.group()), s))


def word_of(token: str) -> str:
    """The word a token stands for; numbers and hashes each become one word."""
    if token.isdigit():
        return "0"
    if _HEX.match(token):
        return "0x"
    return token.translate(_SIGNS)


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s) % BUCKETS


def _characters(word: str) -> list[int]:
    w = f"_{word}_"
    return [_hash(w[i : i + 3]) for i in range(len(w) - 2)] + [_hash("~" + _VOWELS.sub("", word))] * 2


def windows(n: int) -> list[tuple[int, int]]:
    """Ranges of the overlapping windows over `n` words; the last ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the passes through them; `d` is 'f' or 'b', forwards or backwards."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self._row: dict[str, int] = {}
        self._of_word: dict[str, int] = {}
        self._input = np.empty((4096, 6 * HIDDEN), np.float32)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        p = {"word": r.normal(0, 0.1, (BUCKETS, e)), "char": r.normal(0, 0.3, (BUCKETS, e)), "v": r.normal(0, 0.1, 2 * h), "w": r.normal(0, 0.1, 2 * h), "c": np.zeros(1)}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, (2 * e) ** -0.5, (2 * e, 3 * h)), f"b{d}": np.zeros(3 * h), f"U{d}": r.normal(0, h**-0.5, (h, 3 * h))}
        return Network(p)

    def inputs(self, tokens: list[str]) -> np.ndarray:
        """Rows of the table of projected inputs, one per token; new words are added to it."""
        if len(self._row) > MEMO:
            self._row.clear()
            self._of_word.clear()
        rows = list(map(self._row.get, tokens))
        if None in rows:
            missing = dict.fromkeys(t for t, r in zip(tokens, rows, strict=True) if r is None)
            fresh: list[str] = []
            for t in missing:
                w = word_of(t)
                r = self._of_word.get(w)
                if r is None:
                    r = self._of_word[w] = len(self._of_word)
                    fresh.append(w)
                self._row[t] = r
            self._project(fresh)
            rows = list(map(self._row.__getitem__, tokens))
        return np.array(rows, np.int32)

    def _project(self, fresh: list[str]) -> None:
        """Appends the projected inputs of new words to the table, all at once."""
        if not fresh:
            return
        upto = len(self._of_word)
        while upto > len(self._input):
            self._input = np.concatenate([self._input, np.empty_like(self._input)])
        chars = [_characters(w) for w in fresh]
        size = np.array(list(map(len, chars)))
        sums = np.add.reduceat(self.p["char"][np.concatenate(chars)], np.cumsum(size) - size)
        x = np.concatenate([self.p["word"][[_hash(w) for w in fresh]], sums / size[:, None]], 1).astype(np.float32)
        self._input[upto - len(fresh) : upto] = np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def scores(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of windows given as rows of the input table, padded at the end."""
        out = np.empty(len(rows), np.float32)
        h_ = HIDDEN
        u = np.stack([self.p["Uf"], self.p["Ub"]])
        for a in range(0, len(rows), BATCH):
            part, n = rows[a : a + BATCH], lengths[a : a + BATCH]
            size, t = len(part), int(n.max())
            full = bool((n == t).all())
            x = self._input[part[:, :t].T]  # time first
            # Both directions go side by side, the second one backwards; all in place.
            state, hu, gate, cand = (np.zeros((2, size, k), np.float32) for k in (h_, 3 * h_, 2 * h_, h_))
            hidden = np.empty((t, size, 2 * h_), np.float32)
            for i in range(t):
                j = t - 1 - i
                np.matmul(state, u, out=hu)
                np.add(hu[0, :, : 2 * h_], x[i, :, : 2 * h_], out=gate[0])
                np.add(hu[1, :, : 2 * h_], x[j, :, 3 * h_ : 5 * h_], out=gate[1])
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[:, :, h_:], hu[:, :, 2 * h_ :], out=cand)
                cand[0] += x[i, :, 2 * h_ : 3 * h_]
                cand[1] += x[j, :, 5 * h_ :]
                np.tanh(cand, out=cand)
                # h' = n + z * (h - n), kept as it was where a window has ended.
                change = hu[:, :, :h_]
                np.subtract(cand, state, out=change)
                change *= 1 - gate[:, :, :h_]
                if not full:
                    change[0] *= (n > i)[:, None]
                    change[1] *= (n > j)[:, None]
                state += change
                hidden[i, :, :h_] = state[0]
                hidden[j, :, h_:] = state[1]
            mask = (np.arange(t)[:, None] < n).astype(np.float32)[:, :, None]
            out[a : a + BATCH] = self._pool(hidden, mask)[0]
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        h_ = HIDDEN
        u = self.p[f"U{d}"]
        h = np.zeros((x.shape[1], h_), np.float32)
        out = np.empty((len(x), x.shape[1], h_), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            zr = 1 / (1 + np.exp(-(x[t, :, : 2 * h_] + hu[:, : 2 * h_])))
            z, r = zr[:, :h_], zr[:, h_:]
            n = np.tanh(x[t, :, 2 * h_ :] + r * hu[:, 2 * h_ :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * h_ :]))
            h = h + mask[t] * (new - h)
            out[t] = h
        return out

    def _pool(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = h @ self.p["v"] + (mask[:, :, 0] - 1) * 1e4
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        return _sigmoid(pooled @ self.p["w"] + self.p["c"][0]), a, pooled

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the weighted log loss for word vectors `x` (time, window, 2 * EMBED), and for `x`."""
        h_, g, kept, proj = HIDDEN, {}, {}, {}
        parts = []
        for d in "fb":
            proj[d] = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
            kept[d] = []
            parts.append(self._run(proj[d], mask, d, kept[d]))
        h = np.concatenate(parts, 2)
        q, a, pooled = self._pool(h, mask)
        loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / weight.sum())
        dl = weight * (q - y) / weight.sum()
        g["w"], g["c"] = pooled.T @ dl, np.array([dl.sum()])
        dpool = dl[:, None] * self.p["w"]
        da = np.einsum("nh,tnh->tn", dpool, h)
        ds = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnh->h", ds, h)
        dh_all = a[:, :, None] * dpool + ds[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            du, dp = np.zeros_like(u), np.empty_like(proj[d])
            carry = np.zeros((x.shape[1], h_), np.float32)
            for t, prev, z, r, n, hun in reversed(kept[d]):
                dh = carry + dh_all[t, :, k * h_ : (k + 1) * h_]
                live = dh * mask[t]
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (prev - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                into = np.concatenate([dz, dr, dn * r], 1)
                carry = dh * (1 - mask[t]) + live * z + into @ u.T
                du += prev.T @ into
                dp[t] = np.concatenate([dz, dr, dn], 1)
            g[f"U{d}"], g[f"b{d}"] = du, dp.sum((0, 1))
            g[f"W{d}"] = np.einsum("tne,tnk->ek", x, dp, optimize=True)
            dx += dp @ w.T
        return g, dx, loss


def save_model(committee: list[Network], path: str | Path = MODEL) -> None:
    np.savez_compressed(path, **{f"{i}.{k}": v.astype(np.float16) for i, net in enumerate(committee) for k, v in net.p.items()})


@lru_cache(maxsize=2)
def load_model(path: str = str(MODEL)) -> list[Network]:
    """The networks of a model file."""
    with np.load(path) as z:
        members = sorted({k.split(".")[0] for k in z.files}, key=int)
        return [Network({k.split(".")[1]: z[k] for k in z.files if k.split(".")[0] == m}) for m in members]


def document_scores(committee: list[Network], texts: list[str | None], least: float = 0.0) -> list[float]:
    """The worst window's score of each text, the committee's geometric mean; 0 without words.

    Scores from `least` up are exact; a lower one may come out higher, yet below `least`.
    """
    tokens = [surface_tokens(t) if t else [] for t in texts]
    ends = np.cumsum(list(map(len, tokens)))
    begins = [[a for a, _ in windows(len(own))] if own else [] for own in tokens]
    of = np.repeat(np.arange(len(texts)), list(map(len, begins)))
    starts = list(chain.from_iterable(begins))
    length = np.array([min(len(tokens[i]), WINDOW) for i in of], np.int64)

    def inputs(net: Network, live: np.ndarray) -> np.ndarray:
        if len(live) < len(of):
            told = [tokens[of[k]][starts[k] : starts[k] + WINDOW] for k in live]
            rows = np.zeros((len(live), WINDOW), np.int32)
            rows[np.arange(WINDOW) < length[live, None]] = net.inputs(list(chain.from_iterable(told)))
            return rows
        every = np.split(net.inputs(list(chain.from_iterable(tokens))), ends[:-1])
        cut = lambda r, at: np.pad(r, (0, WINDOW - len(r)))[None] if len(r) <= WINDOW else np.lib.stride_tricks.sliding_window_view(r, WINDOW)[at]
        return np.concatenate([cut(r, at) for r, at in zip(every, begins, strict=True) if at])

    best, live, total = np.zeros(len(texts)), np.arange(len(of)), np.zeros(len(of))
    bound = len(committee) * np.log(least) - 1e-6 if least > 0 else -np.inf
    for net in committee:
        live = live[total[live] >= bound]
        if len(live):
            total[live] += np.log(np.maximum(net.scores(inputs(net, live), length[live]), 1e-12))
    np.maximum.at(best, of, np.exp(total / len(committee)))
    return best.tolist()


def scores(documents: DataFrame, model_path: str | None = None, least: float = 0.0) -> DataFrame:
    """`doc_id, score` of every document, in one pass without a shuffle.

    Null, empty and wordless texts score 0; repeated rows give a row each.
    Scores below `least` are not exact, only below it.
    """
    path = model_path or str(MODEL)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        committee = load_model(path)
        for b in batches:
            for part in (b.slice(i, 400) for i in range(0, b.num_rows, 400)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(document_scores(committee, part.column(1).to_pylist(), least), pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "doc_id bigint, score double")


def rates(documents: DataFrame, model_path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`source, documents, abusive, rate` per source; null sources form one group."""
    scored = scores(documents, model_path, threshold)
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source").join(scored, "doc_id")
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return own.groupBy("source").agg(F.count("*").alias("documents"), hit.alias("abusive"), F.round(hit / F.count("*"), 6).alias("rate"))


def train(
    rated: list[tuple[str, int]], unrated: list[str] = (), passes: int = 4, steps: int = 1000, batch: int = 192, seed: int = 7, swaps: float = 0.1, log=lambda *x: None,  # noqa: ANN001
) -> Network:
    """Fits a network on at most `TRAIN_DOCS` pairs (text, 1 for abusive), ratings noisy."""
    r = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = []
    for text, toxic in [*rated[:TRAIN_DOCS], *((t, -1) for t in unrated[:UNRATED_DOCS])]:
        ids = np.array([vocab.setdefault(word_of(t), len(vocab)) for t in surface_tokens(text)], np.int64)
        docs.append((ids, windows(len(ids)), toxic))
    words = list(vocab)
    own = np.array([_hash(w) for w in words])
    chars = [_characters(w) for w in words]
    width = max(map(len, chars))
    grid = np.full((len(words), width), -1)
    for i, c in enumerate(chars):
        grid[i, : len(c)] = c
    many = (grid >= 0).sum(1, keepdims=True)
    flat = [(k, a, b) for k, (_, ws, _) in enumerate(docs) for a, b in ws]
    rating = np.array([docs[k][2] for k, _, _ in flat])
    label = rating
    at = np.array([k for k, _, _ in flat])
    padded = np.zeros((len(flat), WINDOW), np.int64)
    length = np.array([b - a for _, a, b in flat])
    for i, (k, a, b) in enumerate(flat):
        padded[i, : b - a] = docs[k][0][a:b]
    # First guess at the abusive windows: words met mostly in documents rated so.
    seen = np.zeros((2, len(words)))
    for ids, _, toxic in docs:
        if toxic >= 0:
            seen[toxic, np.unique(ids)] += 1
    n = np.array([sum(t == y for _, _, t in docs) for y in (0, 1)])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(0) < 4] = 0
    guess = np.array([np.sort(np.maximum(odds[padded[i, : length[i]]], 0))[-6:].sum() for i in range(len(flat))])
    guess = guess / (guess[label == 0].mean() + 3 * guess[label == 0].std() + 1e-9)
    net = Network.fresh(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, mean, counted = 0, {k: np.zeros(v.shape) for k, v in net.p.items()}, 0
    for turn in range(passes):
        worst = np.full(len(docs), -1.0)
        np.maximum.at(worst, at, guess)
        top = guess >= worst[at] - 1e-12
        limit = 1.0 if turn == 0 else 0.3
        if turn:
            label = np.where(rating >= 0, rating, np.where(worst[at] > 0.95, 1, np.where(worst[at] < 0.05, 0, -1)))
        positive = np.flatnonzero((label == 1) & top & (guess > limit))
        wrong = worst[at] > (1e9 if turn == 0 else 0.9)
        negative = np.flatnonzero((label == 0) & ~wrong)
        hard = negative[np.argsort(-guess[negative])[: 10 * len(positive)]]
        log("pass", turn, "positive", len(positive), "negative", len(negative), "left out", int(len(np.unique(at[(label == 0) & wrong]))))
        for k in range(steps):
            step += 1
            rate = 4e-3 * min(1, step / 100) * (0.3 if turn == passes - 1 and k > steps / 2 else 1)
            pick = np.concatenate([r.choice(positive, batch // 3), r.choice(hard, batch // 3), r.choice(negative, batch // 3)])
            chosen = padded[pick]
            # In clean windows some words are swapped for others of clean windows, so that none is learnt by heart.
            swap = (r.random(chosen.shape) < swaps) & (label[pick] == 0)[:, None]
            chosen[swap] = padded[r.choice(negative, int(swap.sum())), r.integers(0, WINDOW, int(swap.sum()))]
            x_words, back = np.unique(chosen.T, return_inverse=True)
            back = back.reshape(WINDOW, len(pick))
            c = grid[x_words]
            vec = np.concatenate([net.p["word"][own[x_words]], np.where(c[:, :, None] >= 0, net.p["char"][c], 0).sum(1) / many[x_words]], 1).astype(np.float32)
            # Words are dropped at random from the word table, so that characters alone must do.
            drop = r.random(len(x_words)) < 0.3
            vec[drop, :EMBED] = 0
            mask = (np.arange(WINDOW)[:, None] < length[pick]).astype(np.float32)[:, :, None]
            y = (label[pick] == 1).astype(np.float32)
            g, dx, loss = net.gradients(vec[back], mask, y, np.ones(len(pick), np.float32))
            dv = np.zeros_like(vec)
            np.add.at(dv, back, dx)
            dv[drop, :EMBED] = 0
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], own[x_words], dv[:, :EMBED])
            np.add.at(g["char"], c[c >= 0], np.repeat(dv[:, EMBED:] / many[x_words], (c >= 0).sum(1), 0))
            for q, v in g.items():
                v = v + 1e-5 * net.p[q]
                m[q] = 0.9 * m[q] + 0.1 * v
                s[q] = 0.999 * s[q] + 0.001 * v * v
                net.p[q] -= (rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(s[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if turn == passes - 1 and k > steps / 2:
                counted += 1
                for q in mean:
                    mean[q] += net.p[q]
            if k % 100 == 0:
                log("  step", k, round(loss, 4))
        table = np.concatenate([net.p["word"][own], np.where(grid[:, :, None] >= 0, net.p["char"][grid], 0).sum(1) / many], 1).astype(np.float32)
        net._input = np.concatenate([table @ net.p["Wf"] + net.p["bf"], table @ net.p["Wb"] + net.p["bb"]], 1)
        guess = net.scores(padded, length).astype(float)
    # The mean over the last steps does better on new documents than the last step alone.
    return Network({k: v / counted for k, v in mean.items()})
