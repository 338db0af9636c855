"""Reverse-mode gradients of the few operations that a graph layer is made of, over the rows of one subgraph; used inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    __slots__ = ("grad", "value")

    def __init__(self, value: np.ndarray):
        self.value, self.grad = np.asarray(value, float), None

    def add(self, g: np.ndarray) -> None:
        self.grad = g if self.grad is None else self.grad + g


class Tape:
    """Records operations; backward() gives every node that led to a value its gradient."""

    def __init__(self) -> None:
        self._steps: list[Callable[[], None]] = []

    def _made(self, value: np.ndarray, back: Callable[[np.ndarray], None]) -> Node:
        out = Node(value)
        self._steps.append(lambda: back(out.grad) if out.grad is not None else None)
        return out

    def backward(self, out: Node, seed: np.ndarray) -> None:
        out.add(seed)
        for step in reversed(self._steps):
            step()

    def matmul(self, a: Node, b: Node) -> Node:
        return self._made(a.value @ b.value, lambda g: (a.add(g @ b.value.T), b.add(a.value.T @ g)))

    def add(self, a: Node, b: Node) -> Node:
        """b may be one row for all."""
        return self._made(a.value + b.value, lambda g: (a.add(g), b.add(g.sum(0) if b.value.ndim < a.value.ndim else g)))

    def mul(self, a: Node, b: Node) -> Node:
        """b may be one row, or one column, for all."""

        def back(g: np.ndarray) -> None:
            a.add(g * b.value)
            gb = g * a.value
            b.add(gb.sum(0) if b.value.ndim < a.value.ndim else gb.sum(1, keepdims=True) if b.value.shape[1] < a.value.shape[1] else gb)

        return self._made(a.value * b.value, back)

    def scaled(self, a: Node, factor: np.ndarray) -> Node:
        return self._made(a.value * factor, lambda g: a.add(g * factor))

    def leaky(self, a: Node, slope: float = 0.0) -> Node:
        """relu with slope 0."""
        factor = np.where(a.value > 0, 1.0, slope)
        return self._made(a.value * factor, lambda g: a.add(g * factor))

    def columns(self, a: Node, lo: int, hi: int) -> Node:
        def back(g: np.ndarray) -> None:
            whole = np.zeros_like(a.value)
            whole[:, lo:hi] = g
            a.add(whole)

        return self._made(a.value[:, lo:hi], back)

    def row(self, a: Node, i: int) -> Node:
        """Row i as a column."""

        def back(g: np.ndarray) -> None:
            whole = np.zeros_like(a.value)
            whole[i] = g[:, 0]
            a.add(whole)

        return self._made(a.value[i][:, None], back)

    def rows(self, a: Node, n: int) -> Node:
        """One row n times."""
        return self._made(np.repeat(a.value[None], n, 0), lambda g: a.add(g.sum(0)))

    def concat(self, parts: list[Node]) -> Node:
        ends = np.cumsum([p.value.shape[1] for p in parts])[:-1]

        def back(g: np.ndarray) -> None:
            for p, piece in zip(parts, np.split(g, ends, 1), strict=True):
                p.add(piece)

        return self._made(np.concatenate([p.value for p in parts], 1), back)

    def at(self, x: Node, rows: np.ndarray) -> Node:
        """Some rows, each as often as it is asked for."""

        def back(g: np.ndarray) -> None:
            whole = np.zeros_like(x.value)
            np.add.at(whole, rows, g)
            x.add(whole)

        return self._made(x.value[rows], back)

    def pooled(self, x: Node, rows: np.ndarray, n: int) -> Node:
        """Sums of the rows of x by the number of the row that they go to."""
        out = np.zeros((n, x.value.shape[1]))
        np.add.at(out, rows, x.value)
        return self._made(out, lambda g: x.add(g[rows]))

    def gathered(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, x: Node) -> Node:
        """Weighted sums over the edges of each row."""

        def summed(a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = np.zeros_like(rows)
            np.add.at(out, a, w[:, None] * rows[b])
            return out

        return self._made(summed(src, dst, x.value), lambda g: x.add(summed(dst, src, g)))

    def largest(self, src: np.ndarray, dst: np.ndarray, x: Node) -> Node:
        """Element-wise maximum over the edges of each row; 0 where there are none. Of equal ones the first in the order of edges gets the gradient."""
        n, wide = x.value.shape
        best = np.full((n, wide), -np.inf)
        np.maximum.at(best, src, x.value[dst])
        chosen = np.full((n, wide), -1)
        edge, column = np.nonzero((x.value[dst] == best[src])[::-1])
        edge = len(src) - 1 - edge
        chosen[src[edge], column] = dst[edge]  # the last one written is the first edge

        def back(g: np.ndarray) -> None:
            whole = np.zeros_like(x.value)
            at = chosen >= 0
            np.add.at(whole, (chosen[at], np.nonzero(at)[1]), g[at])
            x.add(whole)

        return self._made(np.where(np.isfinite(best), best, 0.0), back)

    def standard(self, x: Node, axis: int, eps: float = 1e-9) -> Node:
        """Less the mean and over the population deviation of each row (axis 1) or column (axis 0)."""
        n = x.value.shape[axis]
        sd = np.sqrt(x.value.var(axis, keepdims=True) + eps)
        z = (x.value - x.value.mean(axis, keepdims=True)) / sd
        return self._made(z, lambda g: x.add((g - g.sum(axis, keepdims=True) / n - z * (g * z).sum(axis, keepdims=True) / n) / sd))

    def unit(self, x: Node, eps: float = 1e-12) -> Node:
        """Rows of length 1."""
        size = np.sqrt(np.maximum((x.value * x.value).sum(1, keepdims=True), eps))
        u = x.value / size
        return self._made(u, lambda g: x.add((g - u * (g * u).sum(1, keepdims=True)) / size))
