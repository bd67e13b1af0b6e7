
# Snapshot layout, in seconds: the input window, then the target window.
INPUT_END = 480
TARGET_END = 600
SECONDS_PER_SNAPSHOT = 600

# Floors.  Several stages use different epsilons, and the differences reach the results.
RV_FLOOR = 1e-4
PRICE_EPS = 1e-12
FEATURE_EPS = 1e-10
BUCKET_EPS = 1e-8
LIVE_LOG_RV = -18.0
LIVE_TARGET_LOG_RV = -10.0
RETURN_CLIP = 0.05

# Regime cut points, lower bound inclusive.
REGIME_CUTS = (0.001, 0.005, 0.02)
REGIMES = ("calm", "normal", "elevated", "stressed")
TIERS = ("Very low (<0.001)", "Low (0.001-0.005)", "Mid (0.005-0.02)", "High (>=0.02)")

# The 21 features used by the residual booster, in model order.
SELECTED_FEATURES = (
    "spread_last60", "log_rv_last60", "rv_lag_13", "ret_kurt", "log_rv_lag_14",
    "log_rv_ratio_60", "log_rv_lag_15", "rv_ratio_240", "ret_iqr", "rv_lag_std",
    "jump_ratio", "log_vol_mean", "log_rv_ratio_120", "spread_trend", "log_rv_lag_16",
    "vol_max", "har_short_long", "rv_ratio_halves", "har_med_long", "log_rv_lag_12",
    "rv_trend_slope",
)

# Cluster of each stock.
STOCK_CLUSTERS = {
    0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1,
    10: 1, 11: 1, 13: 0, 14: 1, 15: 1, 16: 1, 17: 1, 18: 1, 19: 1, 20: 1,
    21: 0, 22: 1, 23: 1, 26: 1, 27: 1, 28: 1, 29: 1, 30: 1, 31: 2, 32: 0,
    33: 1, 34: 1, 35: 2, 36: 1, 37: 1, 38: 1, 39: 1, 40: 1, 41: 0, 42: 1,
    43: 1, 44: 2, 46: 0, 47: 0, 48: 1, 50: 1, 51: 1, 52: 1, 53: 1, 55: 1,
    56: 1, 58: 1, 59: 1, 60: 1, 61: 1, 62: 1, 63: 2, 64: 1, 66: 1, 67: 1,
    68: 1, 69: 1, 70: 1, 72: 1, 73: 1, 74: 2, 75: 1, 76: 1, 77: 0, 78: 1,
    80: 1, 81: 1, 82: 1, 83: 1, 84: 1, 85: 2, 86: 2, 87: 1, 88: 1, 89: 2,
    90: 1, 93: 1, 94: 1, 95: 1, 96: 1, 97: 1, 98: 1, 99: 2, 100: 1, 101: 1,
    102: 1, 103: 1, 104: 1, 105: 2, 107: 1, 108: 0, 109: 1, 110: 1, 111: 0,
    112: 1, 113: 1, 114: 1, 115: 1, 116: 1, 118: 1, 119: 2, 120: 1, 122: 1,
    123: 1, 124: 2, 125: 0, 126: 1,
}
