"""A linear-chain conditional random field over sparse binary features, in numpy.

All sequences of a batch go through the forward, backward and Viterbi recursions together. Features
are strings; those seen in training get a weight per label, others are ignored. Training maximises
the penalised likelihood over the whole (bounded) training set by limited-memory BFGS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class ChainCRF:
    labels: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray  # (labels,)

    def numbers(self, features) -> list[int]:
        """The numbers of the features that training has seen."""
        get = self.vocabulary.get
        return [k for f in features if (k := get(f)) is not None]

    def indexed(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all positions, one after the other, and where each position's begin."""
        flat = np.fromiter((k for r in rows for k in r), dtype=np.int64, count=sum(map(len, rows)))
        return flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(positions, labels): the sum of the weights of each position's features."""
        where = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        w = self.weights[flat]
        return np.stack([np.bincount(where, weights=w[:, k], minlength=len(offsets) - 1) for k in range(len(self.labels))], axis=1)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label numbers of all positions; sequences of like length are decoded together."""
        out = np.zeros(len(scores), dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            part = part[lengths[part] > 0]
            if not len(part):
                continue
            n, b = lengths[part], begins[part]
            longest = int(n[0])
            best = scores[b] + self.start
            back = np.zeros((longest, len(part), len(self.labels)), dtype=np.int8)
            for t in range(1, longest):
                live = int(np.searchsorted(-n, -t, side="left"))  # sequences longer than t come first
                total = best[:live, :, None] + self.transitions
                back[t, :live] = total.argmax(1)
                best[:live] = total.max(1) + scores[b[:live] + t]
            now = best.argmax(1)
            few = int(n[min(len(n), 16) - 1])  # beyond this length only a few sequences go on: those one by one
            for i in range(min(len(n), 16) - 1):
                k = int(now[i])
                for t in range(int(n[i]) - 1, few - 1, -1):
                    out[b[i] + t] = k
                    k = int(back[t, i, k])
                now[i] = k
            for t in range(few - 1, -1, -1):  # the others at once; each joins in at its own end
                live = int(np.searchsorted(-n, -t, side="left"))
                out[b[:live] + t] = now[:live]
                if t:
                    now[:live] = back[t, np.arange(live), now[:live]]
        return out

    def decode(self, rows: list[list[int]], lengths: list[int]) -> list[str]:
        """The best labels of positions given by their feature numbers."""
        if not rows:
            return []
        flat, offsets = self.indexed(rows)
        best = self.viterbi(self.scores(flat, offsets), np.asarray(lengths, dtype=np.int64))
        return [self.labels[k] for k in best.tolist()]


def fit(labels: list[str], features: list[list[str]], gold: list[str], lengths: list[int], least: int = 1, rounds: int = 60, penalty: float = 1e-4) -> ChainCRF:
    """Train on sequences given one after the other: features and gold label of each position, length of each sequence.

    Features seen fewer than ``least`` times are left out. The result is the same for the same input.
    """
    counts: dict[str, int] = {}
    for fs in features:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    number = {label: i for i, label in enumerate(labels)}
    n_labels, n_features = len(labels), len(vocabulary)
    crf = ChainCRF(labels, vocabulary, np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    size = np.asarray([n for n in lengths if n], dtype=np.int64)
    if not len(size):
        return crf
    flat, offsets = crf.indexed([crf.numbers(f) for f in features])
    where = np.repeat(np.arange(len(features)), np.diff(offsets))
    y = np.asarray([number[g] for g in gold])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], begin[order]
    longest, many = int(size[0]), len(size)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    live[0] = many
    onehot = np.eye(n_labels)[y]
    observed_t = np.zeros_like(crf.transitions)
    for t in range(1, longest):
        np.add.at(observed_t, (y[begin[: live[t]] + t - 1], y[begin[: live[t]] + t]), 1)
    observed_s = onehot[begin].sum(0)
    shape = (n_features, n_labels)
    n_weights, n_transitions = n_features * n_labels, n_labels * n_labels

    def load(x: np.ndarray) -> None:
        crf.weights = x[:n_weights].reshape(shape)
        crf.transitions = x[n_weights : n_weights + n_transitions].reshape(n_labels, n_labels)
        crf.start = x[n_weights + n_transitions :]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative penalised log-likelihood per sequence, and its gradient."""
        load(x)
        s = crf.scores(flat, offsets)
        alpha = np.zeros((longest, many, n_labels))
        beta = np.zeros((longest, many, n_labels))
        alpha[0] = s[begin] + crf.start
        for t in range(1, longest):
            m = live[t]
            alpha[t, :m] = _logsumexp(alpha[t - 1, :m, :, None] + crf.transitions, 1) + s[begin[:m] + t]
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            beta[t, :m] = _logsumexp(crf.transitions + (s[begin[:m] + t + 1] + beta[t + 1, :m])[:, None, :], 2)
        z = _logsumexp(alpha[0] + beta[0], 1)
        marginal = np.zeros_like(s)
        expected_t = np.zeros_like(crf.transitions)
        for t in range(longest):
            m = live[t]
            marginal[begin[:m] + t] = np.exp(alpha[t, :m] + beta[t, :m] - z[:m, None])
            if t:
                joint = alpha[t - 1, :m, :, None] + crf.transitions + (s[begin[:m] + t] + beta[t, :m])[:, None, :] - z[:m, None, None]
                expected_t += np.exp(joint).sum(0)
        apart = (onehot - marginal)[where]
        g_w = np.stack([np.bincount(flat, weights=apart[:, k], minlength=n_features) for k in range(n_labels)], axis=1)
        grad = np.concatenate([g_w.ravel(), (observed_t - expected_t).ravel(), observed_s - marginal[begin].sum(0)])
        gain = (s * onehot).sum() + (crf.transitions * observed_t).sum() + (crf.start * observed_s).sum() - z.sum()
        return -gain / many + penalty / 2 * _dot(x, x), -grad / many + penalty * x

    load(_minimise(loss, np.zeros(n_weights + n_transitions + n_labels), rounds))
    return crf


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """A dot product in one thread: a threaded one wastes the executors' cores on vectors of this size."""
    return float(np.einsum("i,i->", a, b))


def _minimise(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q = grad.copy()
        kept = []
        for s, y, r in reversed(moves):
            a = r * _dot(s, q)
            q -= a * y
            kept.append(a)
        if moves:
            s, y, r = moves[-1]
            q *= 1 / (r * _dot(y, y))
        else:
            q /= max(1.0, float(np.abs(q).max()))
        for (s, y, r), a in zip(moves, reversed(kept)):
            q += s * (a - r * _dot(y, q))
        slope, step = -_dot(grad, q), 1.0
        if slope >= 0:
            break
        for _ in range(12):
            new_value, new_grad = loss(x - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        if (sy := _dot(s, y)) > 1e-12:
            moves = [*moves[1 - memory :], (s, y, 1 / sy)] if memory > 1 else [(s, y, 1 / sy)]
        done = value - new_value < 1e-5 * max(1e-3, abs(new_value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x
