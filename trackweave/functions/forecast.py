"""First-order vector autoregression over rolling windows, by least squares."""

from __future__ import annotations

import numpy as np


def rolling_errors(own: np.ndarray, rest: np.ndarray | None, window: int, resid: bool = False, share: float = 0.95) -> np.ndarray:
    """Forecast error of each window of a two-column track; the last full window is left out.

    The first ``share`` of a window trains; the rest is forecast step by step
    from the last training sample, outside variables being known.  resid: the
    size of the mean training residual instead.
    """
    starts = len(own) - window
    if starts <= 0:
        return np.zeros(0)
    train = int(window * share)
    out = np.empty(starts)
    block = max(1, 4_000_000 // (window * (3 + (rest.shape[1] if rest is not None else 0))))
    for a in range(0, starts, block):
        n = min(block, starts - a)
        at = a + np.arange(n)[:, None] + np.arange(window)
        y = own[at]
        parts = [np.ones((n, train - 1, 1)), y[:, : train - 1]]
        if rest is not None:
            parts.append(rest[at][:, 1:train])
        design = np.concatenate(parts, axis=2)
        coef = np.linalg.pinv(design) @ y[:, 1:train]
        if resid:
            out[a : a + n] = np.abs((y[:, 1:train] - design @ coef).mean((1, 2)))
            continue
        state, errors = y[:, train - 1], []
        for k in range(train, window):
            row = [np.ones((n, 1)), state]
            if rest is not None:
                row.append(rest[at[:, k]])
            state = (np.concatenate(row, 1)[:, None] @ coef)[:, 0]
            errors.append((y[:, k] - state) ** 2)
        out[a : a + n] = np.mean(errors, axis=(0, 2))
    return out
