"""Kernels of libraries that are not part of the base environment."""

from __future__ import annotations

import numpy as np

from assayline.operators.kernels.base import Predictor, Scale, Standard, Task


def fit(name: str, task: Task) -> Predictor:
    return {"XGBoost": _xgboost, "LightGBM": _lightgbm, "CatBoost": _catboost}.get(name, lambda t: _torch(name, t))(task)


# The libraries' settings and the networks' layers, as in the published study.


def _xgboost(task: Task) -> Predictor:
    from xgboost import XGBRegressor

    m = XGBRegressor(n_estimators=300, max_depth=2, min_child_weight=4, learning_rate=0.03, subsample=0.85, colsample_bytree=0.65, reg_alpha=0.1, reg_lambda=5, random_state=task.seed % 2**31, n_jobs=1)
    return m.fit(task.x, task.z).predict


def _lightgbm(task: Task) -> Predictor:
    from lightgbm import LGBMRegressor

    m = LGBMRegressor(n_estimators=300, learning_rate=0.03, num_leaves=7, max_depth=3, min_child_samples=10, subsample=0.85, colsample_bytree=0.65, reg_alpha=0.1, reg_lambda=5, random_state=task.seed % 2**31, n_jobs=1, verbose=-1)
    return m.fit(task.x, task.z).predict


def _catboost(task: Task) -> Predictor:
    from catboost import CatBoostRegressor

    m = CatBoostRegressor(iterations=300, learning_rate=0.03, depth=3, l2_leaf_reg=8, random_strength=1, loss_function="RMSE", random_seed=task.seed % 2**31, thread_count=1, verbose=False, allow_writing_files=False)
    return m.fit(task.x, task.z).predict


def _torch(name: str, task: Task, epochs: int = 140, patience: int = 18, batch: int = 16, rate: float = 1e-3, decay: float = 5e-3, held: float = 0.2) -> Predictor:
    """Trained until the held-out rows stop gaining, then again on all rows for as many epochs."""
    import torch
    from torch import nn

    if len(task.y) < 10:
        raise ValueError("a network needs at least 10 rows")
    s, own = Standard(task.x), Scale.fit("standard", task.z)
    p = task.x.shape[1]

    class Recurrent(nn.Module):
        def __init__(self):
            super().__init__()
            self.conv = nn.Sequential(nn.Conv1d(1, 16, 9, padding=4), nn.ReLU(), nn.MaxPool1d(4))
            self.gru, self.head = nn.GRU(16, 24, batch_first=True), nn.Sequential(nn.Linear(24, 32), nn.ReLU(), nn.Dropout(0.10), nn.Linear(32, 1))

        def forward(self, a):
            return self.head(self.gru(self.conv(a[:, None]).transpose(1, 2))[0][:, -1])

    def build():
        torch.manual_seed(task.seed % 2**31)
        if name == "TorchMLP":
            return nn.Sequential(nn.Linear(p, 128), nn.ReLU(), nn.Dropout(0.15), nn.Linear(128, 64), nn.ReLU(), nn.Dropout(0.10), nn.Linear(64, 1))
        if name == "Torch1DCNN":
            return nn.Sequential(nn.Unflatten(1, (1, p)), nn.Conv1d(1, 16, 9, padding=4), nn.ReLU(), nn.MaxPool1d(2), nn.Conv1d(16, 32, 7, padding=3), nn.ReLU(), nn.AdaptiveAvgPool1d(16), nn.Flatten(), nn.Linear(512, 64), nn.ReLU(), nn.Dropout(0.10), nn.Linear(64, 1))
        return Recurrent()

    x, y = torch.tensor(s(task.x), dtype=torch.float32), torch.tensor(own.forward(task.z), dtype=torch.float32)[:, None]
    rng = np.random.default_rng(task.seed)
    order = rng.permutation(len(y))
    cut = max(1, int(round(held * len(y))))

    def train(rows, n, watch=None):
        net = build()
        opt = torch.optim.AdamW(net.parameters(), lr=rate, weight_decay=decay)
        best, at, mix = np.inf, 0, np.random.default_rng(task.seed)
        for e in range(n):
            net.train()
            mixed = mix.permutation(rows)
            for i in range(0, len(mixed), batch):
                opt.zero_grad()
                nn.functional.mse_loss(net(x[mixed[i : i + batch]]), y[mixed[i : i + batch]]).backward()
                opt.step()
            if watch is not None:
                net.eval()
                with torch.no_grad():
                    loss = float(nn.functional.mse_loss(net(x[watch]), y[watch]))
                if loss < best - 1e-6:
                    best, at = loss, e + 1
                elif e + 1 - at >= patience:
                    break
        return net, at or n

    _, n = train(order[cut:], epochs, order[:cut])
    net = train(np.arange(len(y)), n)[0].eval()

    def predict(a):
        with torch.no_grad():
            return own.inverse(net(torch.tensor(s(a), dtype=torch.float32)).numpy()[:, 0].astype(float))

    return predict
