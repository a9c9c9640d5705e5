"""Fits the committee of problem 9 and measures it on rows it never saw.

    python -m claimloom.llm.fit_abuse --train DIR --held-out DIR [DIR ...] --out FILE

Rated documents of the training folder take part whose id is not divisible by
`HELD_OUT`; the others, and all rated documents of the further folders, are only
scored, once, after the fit.  Everything that varies between the networks is in
`COMMITTEE`, so a rerun on the same tables gives the same file.  Threshold and
committee are those of `abuse`; nothing here is chosen by the held-out rows.
"""

from __future__ import annotations

import argparse
import os
from concurrent.futures import ProcessPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from . import abuse

HELD_OUT = 5
#: Of each network: seed, share of swapped words.
COMMITTEE = [(7, 0.1), (11, 0.2), (23, 0.1), (31, 0.2), (41, 0.15), (53, 0.15), (61, 0.1), (71, 0.2)]
PASSES, STEPS, BATCH = 4, 900, 192


def tables(folder: str) -> tuple[dict[int, str], dict[int, int]]:
    """Texts and ratings by document; a document rated more than once counts by its most frequent rating, the milder of equals."""
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict()
    votes: dict[int, list[int]] = {}
    for i, t in zip(labels["doc_id"], labels["toxic"], strict=True):
        if t is not None:
            votes.setdefault(i, []).append(t)
    return {i: t for i, t in zip(docs["doc_id"], docs["text"], strict=True) if t}, {i: int(sum(v) * 2 > len(v)) for i, v in votes.items()}


def _fit(task: tuple[list, list, int, float]) -> dict[str, np.ndarray]:
    rated, unrated, seed, swaps = task
    return abuse.train(rated, unrated, PASSES, STEPS, BATCH, seed, swaps).p


def _scores(texts: list[str]) -> list[float]:
    committee = abuse.load_model(os.environ["CLAIMLOOM_ABUSE_MODEL"])
    return [x for i in range(0, len(texts), 400) for x in abuse.document_scores(committee, texts[i : i + 400], abuse.THRESHOLD)]


def measured(texts: list[str], toxic: list[int], workers: int) -> str:
    with ProcessPoolExecutor(workers) as pool:
        parts = [texts[i::workers] for i in range(workers)]
        got = list(pool.map(_scores, parts))
    hit = np.zeros(len(texts), bool)
    for i, p in enumerate(got):
        hit[i::workers] = np.array(p) >= abuse.THRESHOLD
    y = np.array(toxic) == 1
    return f"{int((hit & y).sum())} of {int(y.sum())} rated abusive found, {int((hit & ~y).sum())} of {int((~y).sum())} others listed"


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--train", required=True)
    p.add_argument("--held-out", nargs="*", default=[])
    p.add_argument("--out", required=True)
    p.add_argument("--workers", type=int, default=os.cpu_count())
    a = p.parse_args()
    texts, toxic = tables(a.train)
    own = sorted(i for i in toxic if i in texts)
    rated = [(texts[i], toxic[i]) for i in own if i % HELD_OUT][: abuse.TRAIN_DOCS]
    unrated = [texts[i] for i in sorted(texts) if i not in toxic and i % HELD_OUT][: abuse.UNRATED_DOCS]
    print(f"fitted on {len(rated)} rated and {len(unrated)} unrated documents", flush=True)
    with ProcessPoolExecutor(min(a.workers, len(COMMITTEE))) as pool:
        fitted = list(pool.map(_fit, [(rated, unrated, seed, swaps) for seed, swaps in COMMITTEE]))
    abuse.save_model([abuse.Network(x) for x in fitted], a.out)
    os.environ["CLAIMLOOM_ABUSE_MODEL"] = str(Path(a.out).resolve())
    kept = [i for i in own if not i % HELD_OUT]
    print("held-out part of", a.train, measured([texts[i] for i in kept], [toxic[i] for i in kept], a.workers), flush=True)
    for folder in a.held_out:
        t, y = tables(folder)
        ids = [i for i in sorted(y) if i in t]
        print(folder, measured([t[i] for i in ids], [y[i] for i in ids], a.workers), flush=True)


if __name__ == "__main__":
    main()
