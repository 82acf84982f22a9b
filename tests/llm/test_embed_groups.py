"""Dense groups of embeddings: every link counts once, whatever the group's size, and no list of pairs is written."""

import numpy as np
import pytest

from trackweave.llm import embed


def degrees(x, labels=None):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    met = np.concatenate([(x[a : a + 1000] @ x.T >= 0.93).sum(1) - 1 for a in range(0, len(x), 1000)])
    return met


def group(rng, n, dim=64, spread=0.21, centre=None):
    centre = rng.normal(size=dim) if centre is None else centre
    return centre / np.linalg.norm(centre) + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)


def table(spark, x, label=0):
    return spark.createDataFrame([(i, v.tolist(), label) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize("spread", [0.21, 0.26, 0.1])
def test_large_narrow_group_is_counted_whole(spark, monkeypatch, spread):
    """Neighbours by the hundred thousand, in blocks: all of them, in rows of the members' number."""
    monkeypatch.setattr(embed, "NUMBERS", 64 * 1024)
    x = group(np.random.default_rng(1), 4500, spread=spread)
    want = degrees(x)
    got = {r["vec_id"]: r for r in embed.near_duplicates(table(spark, x), cell_rows=300).collect()}
    assert want.sum() > 500_000 and [got[i]["n_links"] for i in range(len(x))] == want.tolist()
    assert {r["component_id"] for r in got.values()} == {0}


def test_default_cells_on_a_hot_group(spark):
    """A third of a label are near copies, more than a cell holds; the others stand alone or in pairs."""
    rng = np.random.default_rng(6)
    lone = rng.normal(size=(14_000, 64))
    lone[1::2] = lone[::2] + rng.normal(size=(7000, 64)) * 0.2
    x = np.concatenate([lone, group(rng, 7000, spread=0.15)])
    want = degrees(x)
    got = {r["vec_id"]: r for r in embed.near_duplicates(table(spark, x)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found[:14_000].sum() >= 0.97 * want[:14_000].sum() and found[14_000:].sum() >= 0.999 * want[14_000:].sum()


def test_pairs_count_once_in_overlapping_cells(spark):
    """Several dense groups side by side, dealt to many cells."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    x = np.concatenate([group(rng, 500, spread=0.24, centre=base + 0.5 * rng.normal(size=64)) for _ in range(6)])
    want = degrees(x)
    got = {r["vec_id"]: r for r in embed.near_duplicates(table(spark, x), cell_rows=250, shard_rows=60).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() and got[0]["recall_audit"] >= 0.97


def test_short_recall_falls_back_to_blocks(spark, monkeypatch):
    """Margins that tear links apart: the audit sees it and the label is compared whole."""
    monkeypatch.setattr(embed, "MARGINS", (0.0,))
    monkeypatch.setattr(embed, "_fit", lambda reach, rows: _torn)
    rng = np.random.default_rng(3)
    x = np.concatenate([group(rng, 60, spread=0.25) for _ in range(30)])
    got = {r["vec_id"]: r["n_links"] for r in embed.near_duplicates(table(spark, x), cell_rows=400).collect()}
    assert [got[i] for i in range(len(x))] == degrees(x).tolist()


def _torn(pdf):
    import pandas as pd

    x = np.random.default_rng(0).normal(size=(8, 64))
    return pd.DataFrame([(pdf["cell"].iloc[0], 8, 0.0, x.tobytes())], columns=["cell", "fan", "margin", "centres"])
