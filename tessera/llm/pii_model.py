"""Character-level bidirectional LSTM with a linear-chain CRF, in numpy.

Inputs are character classes: printable ASCII as it is, accented letters as their base letter, a few
kinds of white space, and one class for everything else.  Tags are B/I per type and O.  Both directions
run as one batched matrix product; the input projection is a table look-up (one row per character class).
"""

from __future__ import annotations

import unicodedata

import numpy as np

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ("O",) + tuple(f"{p}-{t}" for t in TYPES for p in "BI")
K = len(TAGS)
PAD, OTHER, VOCAB = 0, 99, 100
_NEG = -1e4


def _char_table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.uint8)
    for code in range(0x3000):
        char = chr(code)
        if 32 <= code < 127:
            table[code] = code - 31
        elif char == "\n":
            table[code] = 96
        elif char == "\t":
            table[code] = 97
        elif char == "\r":
            table[code] = 98
        elif char.isspace():
            table[code] = 1
        elif unicodedata.category(char) == "Pd":
            table[code] = ord("-") - 31
        else:
            base = {"ø": "o", "Ø": "O", "ß": "s", "æ": "a", "Æ": "A", "’": "'", "ł": "l", "đ": "d"}.get(char, unicodedata.normalize("NFKD", char)[:1])
            if base and 32 <= ord(base) < 127:
                table[code] = ord(base) - 31
    return table


CHARS = _char_table()


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one per code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x3000, CHARS[np.minimum(codes, 0x2FFF)], OTHER).astype(np.uint8)


def legal() -> np.ndarray:
    """legal()[a, b]: tag b may follow tag a."""
    ok = np.ones((K, K), bool)
    for b, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, b] = False
            ok[[b - 1, b], b] = True
    return ok


def init(hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = hidden
    p = {
        "wx": rng.normal(0, 0.15, (2, VOCAB, 4 * h)),
        "wh": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)) * 0.7,
        "b": np.zeros((2, 1, 4 * h)),
        "wo": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, K)),
        "bo": np.zeros(K),
        "a": rng.normal(0, 0.1, (K, K)),
    }
    p["b"][:, :, h : 2 * h] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict, ids: np.ndarray, keep: bool = False):
    """Hidden states [T, B, 2H] of ids [B, T]; with keep also what the backward pass needs."""
    n, t_len = ids.shape
    h = p["wh"].shape[1]
    steps = np.stack([ids.T, ids[:, ::-1].T])
    scale = np.full(4 * h, 0.5, np.float32)
    scale[3 * h :] = 1
    wx, wh = (p["wx"] + p["b"]) * scale, p["wh"] * scale
    hs = np.zeros((t_len + 1, 2, n, h), np.float32)
    cs = np.zeros((t_len + 1 if keep else 2, 2, n, h), np.float32)
    gates = np.empty((t_len if keep else 1, 2, n, 4 * h), np.float32)
    tcs = np.empty((t_len if keep else 1, 2, n, h), np.float32)
    tmp = np.empty((2, n, h), np.float32)
    for t in range(t_len):
        g, tc = gates[t if keep else 0], tcs[t if keep else 0]
        c_in, c_out = (cs[t], cs[t + 1]) if keep else (cs[t % 2], cs[(t + 1) % 2])
        np.matmul(hs[t], wh, out=g)
        g[0] += wx[0][steps[0, t]]
        g[1] += wx[1][steps[1, t]]
        np.tanh(g, out=g)
        s = g[:, :, : 3 * h]
        s *= 0.5
        s += 0.5
        np.multiply(g[:, :, h : 2 * h], c_in, out=c_out)
        np.multiply(g[:, :, :h], g[:, :, 3 * h :], out=tmp)
        c_out += tmp
        np.tanh(c_out, out=tc)
        np.multiply(g[:, :, 2 * h : 3 * h], tc, out=hs[t + 1])
    out = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
    return (out, (steps, hs, cs, gates, tcs)) if keep else (out, None)


def loss_and_grad(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood per sequence and its gradient; padding (class 0) carries tag O."""
    n, t_len = ids.shape
    h = p["wh"].shape[1]
    out, (steps, hs, cs, gates, tcs) = _states(p, ids, True)
    em = out @ p["wo"] + p["bo"]
    a = np.where(legal(), p["a"], _NEG)
    ea = np.exp(a)
    top = em.max(2, keepdims=True)
    ee = np.exp(em - top)
    alpha, z = np.empty_like(em), np.empty((t_len, n, 1), np.float32)
    beta = np.empty_like(em)
    for t in range(t_len):
        x = ee[t] * (alpha[t - 1] @ ea) if t else ee[0].copy()
        z[t] = x.sum(1, keepdims=True)
        alpha[t] = x / z[t]
    beta[-1] = 1
    pair = np.zeros((K, K), np.float32)
    for t in range(t_len - 1, 0, -1):
        y = beta[t] * ee[t] / z[t]
        pair += alpha[t - 1].T @ y
        beta[t - 1] = y @ ea.T
    pair *= ea
    marg = alpha * beta
    marg /= marg.sum(2, keepdims=True)
    gold = tags.T
    rows, cols = np.indices(gold.shape)
    score = em[rows, cols, gold].sum() + a[gold[:-1], gold[1:]].sum()
    loss = float((np.log(z) + top).sum() - score) / n
    d_em = marg
    d_em[rows, cols, gold] -= 1
    d_em /= n
    np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    grad = {"a": np.where(legal(), pair / n, 0).astype(np.float32), "wo": out.reshape(-1, 2 * h).T @ d_em.reshape(-1, K), "bo": d_em.sum((0, 1))}
    d_out = d_em @ p["wo"].T
    dhs = np.stack([d_out[:, :, :h], d_out[::-1, :, h:]], axis=1)
    dg_all = np.empty_like(gates)
    dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    wht = p["wh"].transpose(0, 2, 1)
    for t in range(t_len - 1, -1, -1):
        g, tc, dg = gates[t], tcs[t], dg_all[t]
        i, f, o, u = (g[:, :, k * h : (k + 1) * h] for k in range(4))
        dh += dhs[t]
        dc += dh * o * (1 - tc * tc)
        dg[:, :, :h] = dc * u * i * (1 - i)
        dg[:, :, h : 2 * h] = dc * cs[t] * f * (1 - f)
        dg[:, :, 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dg[:, :, 3 * h :] = dc * i * (1 - u * u)
        dc *= f
        dh = dg @ wht
    flat = dg_all.transpose(1, 0, 2, 3).reshape(2, t_len * n, 4 * h)
    prev = hs[:-1].transpose(1, 0, 2, 3).reshape(2, t_len * n, h)
    grad["wh"] = prev.transpose(0, 2, 1) @ flat
    grad["b"] = flat.sum(1, keepdims=True)
    wx = np.empty_like(p["wx"])
    for d in range(2):
        one = np.zeros((t_len * n, VOCAB), np.float32)
        one[np.arange(t_len * n), steps[d].ravel()] = 1
        wx[d] = one.T @ flat[d]
    grad["wx"] = wx
    return loss, grad


def decode(p: dict, ids: np.ndarray) -> np.ndarray:
    """Viterbi tags [B, T] of ids [B, T]."""
    n, t_len = ids.shape
    em = _states(p, ids)[0] @ p["wo"] + p["bo"]
    a = np.where(legal(), p["a"], _NEG).astype(np.float32)
    back = np.empty((t_len, n, K), np.uint8)
    score = em[0]
    for t in range(1, t_len):
        step = score[:, None, :] + a.T[None]
        best = step.argmax(2)
        back[t] = best
        score = np.take_along_axis(step, best[:, :, None], 2)[:, :, 0] + em[t]
    tags = np.empty((n, t_len), np.uint8)
    tags[:, -1] = score.argmax(1)
    row = np.arange(n)
    for t in range(t_len - 1, 0, -1):
        tags[:, t - 1] = back[t][row, tags[:, t]]
    return tags


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(type number, start, end) of each B/I run of one tag sequence."""
    found: list[tuple[int, int, int]] = []
    on = np.flatnonzero(tags)
    start = kind = last = -1
    for k in on:
        tag = int(tags[k])
        if tag % 2 == 1 or k != last + 1 or (tag - 1) // 2 != kind:
            if start >= 0:
                found.append((kind, start, last + 1))
            start, kind = int(k), (tag - 1) // 2
        last = int(k)
    if start >= 0:
        found.append((kind, start, last + 1))
    return found
