import numpy as np

from sourcelens.llm import quality_classifier as Q


def test_the_lasso_sees_every_distinct_path(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(Q.FEATURES)))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, 0.5, 2000) > 0.8).astype(float)
    paths, widths, grow, lasso = {}, [], Q.tree_paths, Q.lasso_logistic

    def noted(*given):
        grow(*given)
        paths.update(given[-1])

    def seen(r, *given):
        widths.append(r.shape[1])
        return lasso(r, *given)

    monkeypatch.setattr(Q, "tree_paths", noted)
    monkeypatch.setattr(Q, "lasso_logistic", seen)
    model = Q.fit(x, y)
    hits = {Q.applies(p, x).tobytes() for p in paths if 0 < Q.applies(p, x).sum() < len(x)}
    assert len(hits) > 250 and set(widths) == {len(hits)} and 0 < len(model.rules) < len(hits)
