"""The catalogue of a daily equity index: 58 conditions in 13 families."""

from __future__ import annotations

from ..config import Node

#: Nodes by family: feature, and the parameters of each node by its id (fixed values).
CATALOGUE: dict[str, tuple[tuple[str, str, dict], ...]] = {
    "_base": (("baseline", "constant", {}),),
    "rsi": (
        ("rsi_7", "rsi", {"period": 7}), ("rsi_14", "rsi", {"period": 14}), ("rsi_21", "rsi", {"period": 21}), ("rsi_spread_7_14", "rsi_spread", {"fast": 7, "slow": 14}),
    ),
    "williams_r": (
        ("wr_7", "williams_r", {"period": 7}), ("wr_14", "williams_r", {"period": 14}), ("wr_21", "williams_r", {"period": 21}), ("wr_spread_7_14", "wr_spread", {"fast": 7, "slow": 14}),
    ),
    "stoch": (("stoch_7", "stoch_k", {"k_period": 7}), ("stoch_14", "stoch_k", {"k_period": 14}), ("stoch_d_14", "stoch_d", {"k_period": 14, "d_period": 3})),
    "roc": (
        ("roc_1", "roc", {"period": 1}), ("roc_3", "roc", {"period": 3}), ("roc_5", "roc", {"period": 5}), ("roc_10", "roc", {"period": 10}), ("roc_20", "roc", {"period": 20}),
        ("roc_spread_5_20", "roc_spread", {"fast": 5, "slow": 20}),
    ),
    "ma": (
        ("ma_ratio_10", "ma_ratio", {"period": 10}), ("ma_ratio_20", "ma_ratio", {"period": 20}), ("ma_ratio_50", "ma_ratio", {"period": 50}), ("ma_ratio_100", "ma_ratio", {"period": 100}),
        ("ma_ratio_200", "ma_ratio", {"period": 200}), ("ma_cross_10_50", "ma_cross", {"fast": 10, "slow": 50}), ("ma_cross_20_100", "ma_cross", {"fast": 20, "slow": 100}),
        ("ma_cross_50_200", "ma_cross", {"fast": 50, "slow": 200}),
    ),
    "macd": (
        ("macd_12_26", "macd", {"fast": 12, "slow": 26}), ("macd_9_21", "macd", {"fast": 9, "slow": 21}), ("macd_histogram_12_26", "macd_histogram", {"fast": 12, "slow": 26, "signal": 9}),
    ),
    "volatility": (
        ("realized_vol_7", "realized_vol", {"period": 7}), ("realized_vol_14", "realized_vol", {"period": 14}), ("realized_vol_21", "realized_vol", {"period": 21}),
        ("realized_vol_30", "realized_vol", {"period": 30}), ("atr_14", "atr", {"period": 14}), ("bb_pct_20", "bb_pct", {"period": 20}), ("bb_width_20", "bb_width", {"period": 20}),
        ("vol_ratio_7_21", "vol_ratio", {"fast": 7, "slow": 21}),
    ),
    "volume": (("volume_ratio_10", "volume_ratio", {"period": 10}), ("volume_ratio_20", "volume_ratio", {"period": 20}), ("volume_ratio_50", "volume_ratio", {"period": 50})),
    "drawdown": (
        ("drawdown_7", "drawdown", {"period": 7}), ("drawdown_14", "drawdown", {"period": 14}), ("drawdown_30", "drawdown", {"period": 30}), ("drawdown_60", "drawdown", {"period": 60}),
        ("drawdown_recovery_7_60", "drawdown_recovery", {"short": 7, "long": 60}),
    ),
    "vix": (
        ("vix_level", "vix_level", {}), ("vix_ma_ratio_10", "vix_ma_ratio", {"period": 10}), ("vix_ma_ratio_20", "vix_ma_ratio", {"period": 20}),
        ("vix_ret_1", "vix_ret", {"period": 1}), ("vix_ret_5", "vix_ret", {"period": 5}),
    ),
    "treasury": (
        ("tnx_level", "tnx_level", {}), ("tnx_ma_ratio_20", "tnx_ma_ratio", {"period": 20}), ("tnx_ret_1", "tnx_ret", {"period": 1}), ("tnx_ret_5", "tnx_ret", {"period": 5}),
    ),
    "dxy": (("dxy_ret_1", "dxy_ret", {"period": 1}), ("dxy_ret_5", "dxy_ret", {"period": 5}), ("dxy_ma_ratio_20", "dxy_ma_ratio", {"period": 20})),
    "day_of_week": (("day_of_week", "day_of_week", {}),),
}


def catalogue_nodes() -> list[Node]:
    return [Node(node_id, feature, params, family) for family, nodes in CATALOGUE.items() for node_id, feature, params in nodes]
