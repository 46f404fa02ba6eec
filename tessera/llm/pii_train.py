"""Train the personal-information tagger and write its weights.

    python -m tessera.llm.pii_train OUT.npz SECONDS [START.npz] [FOLDER ...]

Several processes take Adam steps on windows of their own and their weights are averaged every few steps.
Each ``FOLDER`` of source code and documents gives lines without personal information (together at most
``MAX_BACKGROUND``, from at most ``MAX_FILES`` files); without one only templates are used.  Training goes on from the
weights in ``START.npz``.
"""

from __future__ import annotations

import sys
import time
from multiprocessing import get_context

import numpy as np

from tessera.llm import pii_data, pii_model as m

MAX_FILES, MAX_BACKGROUND = 6_000, 150_000
HIDDEN, LENGTH, BATCH, INNER, WORKERS = 48, 144, 40, 8, 8
_state: dict = {}


def make_batch(maker: pii_data.Maker, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((size, length), np.uint8), np.zeros((size, length), np.int64)
    for k in range(size):
        text, found = maker.window(length)
        ids[k, : len(text)] = m.encode(text)
        for a, b, kind in found:
            t = 1 + 2 * m.TYPES.index(kind)
            tags[k, a:b] = t + 1
            tags[k, a] = t
    return ids, tags


def _start(background: list[str], hard: list[str]) -> None:
    _state["background"] = background, hard


def _work(args):
    p, s, lr, seed, step = args
    maker = _state.setdefault("maker", pii_data.Maker(seed, *_state["background"]))
    losses = []
    for _ in range(INNER):
        loss, g = m.loss_and_grad(p, *make_batch(maker, BATCH, LENGTH))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        step += 1
        for k in p:
            d = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            s[k][0] = 0.9 * s[k][0] + 0.1 * d
            s[k][1] = 0.99 * s[k][1] + 0.01 * d * d
            p[k] = p[k] - lr * (s[k][0] / (1 - 0.9**step)) / (np.sqrt(s[k][1] / (1 - 0.99**step)) + 1e-8)
        losses.append(loss)
    return p, s, float(np.mean(losses))


def train(background: list[str], hard: list[str], seconds: float, seed: int = 7, start: dict | None = None, rate: float = 8e-3, log=print) -> dict[str, np.ndarray]:
    p = start or m.init(HIDDEN, seed)
    s = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    began, step, rounds = time.time(), 0, 0
    with get_context("spawn").Pool(WORKERS, _start, (background, hard)) as pool:
        while (done := (time.time() - began) / seconds) < 1:
            lr = rate * max(0.02, 0.5 * (1 + np.cos(np.pi * min(1, done)))) * min(1, (rounds + 1) / 10)
            found = pool.map(_work, [(p, s, lr, seed * 1000 + k + WORKERS * rounds, step) for k in range(WORKERS)], chunksize=1)
            p = {k: np.mean([f[0][k] for f in found], axis=0).astype(np.float32) for k in p}
            s = {k: [np.mean([f[1][k][j] for f in found], axis=0).astype(np.float32) for j in (0, 1)] for k in p}
            step += INNER
            rounds += 1
            if rounds % 10 == 0:
                log(f"{time.time() - began:.0f} s, round {rounds}, loss {np.mean([f[2] for f in found]):.3f}", flush=True)
    return p


def mine(p: dict, sentences: list[str]) -> list[str]:
    """The sentences without personal information in which the tagger nevertheless finds some."""
    hard = []
    sentences = sorted(sentences, key=len)
    for at in range(0, len(sentences), 500):
        part = sentences[at : at + 500]
        ids = np.zeros((len(part), len(part[-1]) + 2), np.uint8)
        for row, text in zip(ids, part):
            row[: len(text)] = m.encode(text)
        hard += [text for text, tags in zip(part, m.decode(p, ids)) if tags.any()]
    return hard


def score(p: dict, maker: pii_data.Maker, n: int = 400) -> tuple[float, float]:
    """Span precision and recall on fresh windows; spans that touch a cut are left out."""
    hit = told = true = 0
    for _ in range(n // 50):
        ids, tags = make_batch(maker, 50, LENGTH)
        got = m.decode(p, ids)
        for k in range(50):
            edge = lambda x: x[1] > 24 and x[2] < LENGTH - 24
            a, b = {x for x in m.spans(got[k]) if edge(x)}, {x for x in m.spans(tags[k]) if edge(x)}
            hit, told, true = hit + len(a & b), told + len(a), true + len(b)
    return hit / max(told, 1), hit / max(true, 1)


def main(args: list[str]) -> None:
    out, seconds, folders = args[0], float(args[1]), args[2:]
    start = None
    if folders and folders[0].endswith(".npz"):
        with np.load(folders.pop(0)) as z:
            start = {k: z[k].astype(np.float32) for k in z.files}
    background = pii_data.background(pii_data.read_texts(folders, 1, MAX_FILES), MAX_BACKGROUND, 1)
    print(len(background), "background lines", flush=True)
    p = train(background, mine(start, background) if start else [], 0.6 * seconds, seed=7 if start is None else 17, start=start, rate=8e-3 if start is None else 5e-3)
    hard = mine(p, background)
    print(len(hard), "hard lines", flush=True)
    p = train(background, hard, 0.4 * seconds, seed=8 if start is None else 18, start=p, rate=3e-3)
    print("held-out span precision, recall:", score(p, pii_data.Maker(99, background)))
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1:])
