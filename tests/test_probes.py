"""The linear probe and the priors against numpy."""

import numpy as np
import pyarrow.parquet as pq

from moetrace import catalog

SF = "/root/testdata/sf0.001"


def _arrays():
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id")
    h = np.stack(t["embedding"].to_numpy()).astype(float).reshape(len(t), 4, 16)
    own = np.argsort(-h, axis=2, kind="stable")[:, :, :4]
    hot = np.zeros(h.shape)
    np.put_along_axis(hot, own, 1, axis=2)
    return h, hot


def _recall(scores, hot):
    best = np.argsort(-scores, axis=1, kind="stable")[:, :8]
    return np.take_along_axis(hot, best, axis=1).sum(axis=1).mean() / 4


def test_linear_probe_against_numpy(spark):
    h, hot = _arrays()
    cut = 1 + int((len(h) - 1) * 0.7)
    got = {r["k"]: r["recall"] for r in catalog.queries()["linear_probe"](spark, SF).collect()}
    for k in (1, 2):
        x, y = h[:, : 4 - k], hot[:, k:]
        fit = np.hstack([x[1:cut].reshape(-1, 16), np.ones((x[1:cut].size // 16, 1))])
        w = np.linalg.solve(fit.T @ fit + np.eye(17), fit.T @ y[1:cut].reshape(-1, 16))
        test = np.hstack([x[cut:].reshape(-1, 16), np.ones((x[cut:].size // 16, 1))])
        assert abs(got[k] - _recall(test @ w, y[cut:].reshape(-1, 16))) < 1e-3


def test_persistence_prior_against_numpy(spark):
    _, hot = _arrays()
    cut = 1 + int((len(hot) - 1) * 0.7)
    rows = catalog.queries()["lookahead_priors"](spark, SF).where("prior = 'persistence'").collect()
    for r in rows:
        k = r["k"]
        assert abs(r["recall"] - _recall(hot[cut - 1 : -1, k:].reshape(-1, 16), hot[cut:, k:].reshape(-1, 16))) < 2e-6
