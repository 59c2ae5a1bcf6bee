"""Values that define the semantics; all times are minutes unless named otherwise."""

EVENT_KEY = ("firm", "cusip", "side", "ns")
SERIES = ("firm", "cusip", "side")
MINUTE_NS = 60 * 10**9
DAY_NS = 24 * 60 * MINUTE_NS

HISTORY_GAP_MIN = 60
LOOKBACK_MIN = 30
AGE_MIN = 30.0
SYNC_MIN = 1.0
MIN_PEERS = 3
CLIP_FLOOR_BPS = 10.0
MAD_MULTIPLIER = 4.0
MAD_SCALE = 1.4826

#: Chronological split, in trade dates.
VALIDATION_DAYS, TEST_DAYS, EMBARGO_DAYS, MIN_TRAIN_DAYS = 5, 5, 2, 10

#: Deterministic case sampling.
CASE_SEED, CASES_PER_KIND = 2026, 6

#: The grid cleaner.
GRID_MIN, MAX_AGE_MIN, SESSION = 5, 30, (8 * 60, 17 * 60)
TIE_TOL_BPS, ZERO_PAIR_GAP_BPS, PEER_Z, NOISE_FLOOR_BPS = 2.0, 10.0, 4.0, 2.0
PAIR_MAX_GAP_MIN, CHANGE_LAG_MIN, MIN_MATCHED, MIN_COMMON_OBS = 5, 30, 2, 30

RULES_VERSION = "1"
