"""Language of each document and of each segment of mixed ones (problem 3).

Error-correcting output codes: the six languages get the exhaustive code of 31
bits (each way of splitting them in two, once), so any two codewords differ in
16 bits.  For each bit a binary n-gram classifier gives a margin: the log odds
of hashed character 1- to 4-grams and whole words under the languages on either
side.  Margins add up over words, so a word's 31 margins are computed once per
worker and kept.  A stretch of text is decoded by the logistic loss of its mean
margins, weighted by each bit's reliability, against each codeword; the nearest
wins, and the distance to the runner-up gives the confidence and the flag for
ambiguity.  Segments are the best path over words, where changing the language
costs little at the end of a sentence, a line or a quotation and much elsewhere.

The classifiers are fitted by `train` on at most `TRAIN_ROWS` labelled rows.
Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

LANGUAGES = ["id", "en", "de", "es", "fr", "pt"]
#: Three-letter codes of these languages (fixed values).
THREE_LETTERS = {"ind": "id", "eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr", "por": "pt"}
#: Labels that name no language (fixed values).
NO_LANGUAGE = {"und", "unknown", "n/a", "na", "xx", "zxx", "mul", "mis", "none", "null", "-", "?"}
BUCKETS = 1 << 15
TRAIN_ROWS = 20_000
MEMO = 300_000
SWITCH_AT_END, SWITCH_INSIDE = 40.0, 120.0
AMBIGUOUS = 0.7
MODEL = Path(__file__).parent / "models" / "languages.npz"
#: Characters that are seen inside a word without being letters: combining marks, joiners, soft hyphens (fixed values).
_INNER = "\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff"
_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{_INNER}])*(?:['’´][^\W_](?:[^\W_]|[{_INNER}])*)*")
_DROP = re.compile(r"[\u00ad\u200b-\u200d\u2060\ufeff]")
_END = re.compile(r"[.!?…\n\r\"“”„«»()\[\]–—|]|:\s|;\s|\s-\s")
#: Codewords: row l, column b; +1 or -1.  Column b is the b-th way to split the languages.
CODE = np.array([[1 if (b >> l) & 1 else -1 for b in range(1, 32)] for l in range(len(LANGUAGES))], np.float32)


def label_language(label: str | None) -> str | None:
    """The language a label names, as a primary subtag ('nl' too), or None if it names none.

    Regions, case and three-letter codes don't matter.
    """
    s = (label or "").strip().lower()
    if not s or s in NO_LANGUAGE:
        return None
    s = re.split(r"[-_]", s)[0]
    return None if s in NO_LANGUAGE or not s else THREE_LETTERS.get(s, s)


def features(word: str) -> list[int]:
    """Hashed n-grams of one folded word, whole word included."""
    w = f"_{word}_"
    grams = {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} | set(word) | {"=" + word}
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in grams]


class LanguageModel:
    """Class distributions over hashed n-grams, and the bit classifiers made of them."""

    def __init__(self, log_p: np.ndarray, reliability: np.ndarray) -> None:
        self.log_p = log_p.astype(np.float32)
        self.reliability = reliability.astype(np.float32)
        p = np.exp(self.log_p)
        bits = []
        for b in range(CODE.shape[1]):
            side = CODE[:, b] > 0
            odds = np.log(p[:, side].mean(1)) - np.log(p[:, ~side].mean(1))
            bits.append(np.clip(odds, -3, 3))
        self.weights = np.stack(bits, 1).astype(np.float32)
        #: What a word adds to each language's path: its margins' correlation with the codewords.
        self.towards = (CODE * self.reliability).T
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._margin = np.empty((4096, CODE.shape[1]), np.float32)

    def margins(self, word: str) -> np.ndarray:
        """The 31 bit margins of a folded word: the mean over its n-grams, whole word counted threefold."""
        f = features(word)
        return (self.weights[f].sum(0) + 2 * self.weights[xxhash.xxh32_intdigest("=" + word) % BUCKETS]) / (len(f) + 2)

    def of_words(self, surface: list[str]) -> np.ndarray:
        """Margins of words as written, a row each; known words are looked up."""
        if len(self._row) > MEMO:
            self._forget()
        rows = list(map(self._row.get, surface))
        if None in rows:
            for i, (w, r) in enumerate(zip(surface, rows, strict=True)):
                if r is None:
                    r = self._row.get(w)
                    if r is None:
                        r = self._row[w] = len(self._row)
                        if r >= len(self._margin):
                            self._margin = np.concatenate([self._margin, np.empty_like(self._margin)])
                        self._margin[r] = self.margins(_DROP.sub("", fold(w)))
                    rows[i] = r
        return self._margin[rows]

    def decode(self, total: np.ndarray, n: int) -> tuple[int, float, bool]:
        """Language number, confidence and whether it is ambiguous, of summed margins of `n` words."""
        scaled = total / max(n, 1) * min(n, 16) ** 0.5
        loss = (self.reliability * np.logaddexp(0, -CODE * scaled)).sum(1)
        q = np.exp(loss.min() - loss)
        q /= q.sum()
        best = int(loss.argmin())
        return best, float(q[best]), bool(q[best] < AMBIGUOUS)


@lru_cache(maxsize=2)
def load_model(path: str = str(MODEL)) -> LanguageModel:
    with np.load(path) as z:
        return LanguageModel(z["log_p"], z["reliability"])


def segments(text: str, model: LanguageModel) -> list[tuple[int, str, float, bool]]:
    """`(start, language, confidence, ambiguous)` of each segment; neighbours differ.

    Starts are code points of the stored text.  A text without letters or
    digits has none.
    """
    marks = list(_WORD.finditer(text))
    if not marks:
        return []
    margin = model.of_words([m.group() for m in marks])
    gain = margin @ model.towards
    main = int(gain.sum(0).argmax())
    # The most that any stretch in another language could add to the path of one language.
    run = np.cumsum(gain - gain[:, main : main + 1], 0)
    most = float((run - np.minimum(np.minimum.accumulate(run, 0), 0)).max())
    path = [main] * len(marks) if most <= SWITCH_AT_END else _best_path(text, marks, gain)
    # The path cuts the text; the codeword nearest to a stretch names its language, and neighbours that agree are one.
    cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
    named = [model.decode(margin[i:j].sum(0), j - i)[0] for i, j in zip(cuts, cuts[1:], strict=False)]
    cuts = [0, *(c for c, x, y in zip(cuts[1:], named, named[1:], strict=False) if x != y), len(path)]
    named = [x for k, x in enumerate(named) if not k or x != named[k - 1]]
    out = []
    for i, j, x in zip(cuts, cuts[1:], named, strict=False):
        best, confidence, ambiguous = model.decode(margin[i:j].sum(0), j - i)
        out.append((marks[i].start(), LANGUAGES[x], confidence if best == x else 1 - confidence, ambiguous or best != x))
    return out


def _best_path(text: str, marks: list[re.Match], gain: np.ndarray) -> list[int]:
    """A language for each word: highest gain less the cost of changes."""
    k = len(LANGUAGES)
    score, back = gain[0].tolist(), []
    for i, g in enumerate(gain[1:].tolist(), 1):
        cost = SWITCH_AT_END if _END.search(text, marks[i - 1].end(), marks[i].start()) else SWITCH_INSIDE
        top = max(range(k), key=score.__getitem__)
        jump = score[top] - cost
        back.append([x if score[x] >= jump else top for x in range(k)])
        score = [max(score[x], jump) + g[x] for x in range(k)]
    path = [max(range(k), key=score.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def label_report(documents: DataFrame, row_id: str = "rec_id", text: str = "text", label: str = "language", model_path: str | None = None) -> DataFrame:
    """`rec_id, seg_start, lang, confidence, ambiguous, segments, label_ok` of every segment of every row.

    `segments` counts the segments of the row, `label_ok` says whether its label
    names its one language.  Rows whose text is null or blank, or holds no letter
    or digit, give no row; a null label counts as missing.
    """
    path = model_path or str(MODEL)
    names = ["rec_id", "seg_start", "lang", "confidence", "ambiguous", "segments", "label_ok"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for b in batches:
            rows = []
            for i, t, said in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                found = segments(t, model) if t and t.strip() else []
                ok = len(found) == 1 and label_language(said) == found[0][1]
                rows += [(i, start, lang, conf, amb, len(found), ok) for start, lang, conf, amb in found]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    narrow = documents.select(F.col(f"`{row_id}`").cast("bigint"), F.col(f"`{text}`"), F.col(f"`{label}`"))
    return narrow.mapInArrow(scan, "rec_id bigint, seg_start bigint, lang string, confidence double, ambiguous boolean, segments int, label_ok boolean")


def train(rows: list[tuple[str, str]], passes: int = 3, alpha: float = 0.5) -> LanguageModel:
    """Fits the model on at most `TRAIN_ROWS` pairs (text, label language), labels noisy.

    Texts are cut into sentences; after the first pass each sentence takes the
    language the model gives it, so wrong labels and mixed texts wash out.
    """
    data = []
    for text, lang in rows[:TRAIN_ROWS]:
        if lang in LANGUAGES:
            for s in re.split(r"(?<=[.!?])\s+|\n", text):
                ws = [fold(w) for w in _WORD.findall(s)]
                if len(ws) >= 4:
                    data.append((ws, LANGUAGES.index(lang)))
    model = None
    memo: dict[str, list[int]] = {}
    for _ in range(passes):
        counts = np.full((BUCKETS, len(LANGUAGES)), 0.0)
        right = np.zeros(CODE.shape[1])
        n = 0
        for ws, y in data:
            if model is not None:
                total = np.sum([model.margins(w) for w in ws], 0)
                y, confidence, _ = model.decode(total, len(ws))
                if confidence < 0.9:
                    continue
                right += np.sign(total) == CODE[y]
                n += 1
            for w in ws:
                f = memo.get(w)
                if f is None:
                    f = memo[w] = features(w)
                counts[f, y] += 1
        total = counts.sum(0, keepdims=True)
        # Smoothing towards the mean of the languages: rare n-grams say nothing.
        prior = (counts / total).mean(1, keepdims=True) + 1e-9
        p = (counts + alpha * 20 * prior + alpha) / (total + alpha * BUCKETS)
        reliability = np.ones(CODE.shape[1]) if not n else right / n
        model = LanguageModel(np.log(p), reliability)
    return model


def save_model(model: LanguageModel, path: str | Path = MODEL) -> None:
    np.savez_compressed(path, log_p=model.log_p.astype(np.float16), reliability=model.reliability)
