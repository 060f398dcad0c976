"""The tolerances and closed sets that results depend on (metres, square metres)."""

OVERLAP_MIN_AREA = 0.25
OVERLAP_MIN_FRACTION = 0.05
OVERLAP_ERROR_FRACTION = 0.30
DUPLICATE_IOU = 0.90
SHARED_TOL = 0.30
SHARED_MIN_LENGTH = 0.5
GAP_MAX_WIDTH = 0.5
GAP_MIN_AREA = 0.1
GAP_MIN_LENGTH = 1.0
MATCH_IOU = 0.5
MIN_PIECE_AREA = 2.0
EVAL_RES = 0.1
PAGE_MAX = 5000
COORD_PAD_DEG = 0.02
PARCEL_AREA_TOL = 0.01
FIELD_TOL = 0.5
FIELD_COVERAGE = 0.95
SMALL_AREA, LARGE_AREA, LOW_SCORE, TOUCH_DISTANCE = 20.0, 300.0, 0.7, 0.3

ORIGINS = ["ai_copy", "human_edited", "human_merged", "human_split", "human_drawn"]
STATUSES = ["suggested", "accepted", "rejected"]
FEATURE_TYPES = ["building_footprint", "road_surface", "land_cover"]
PARCEL_STATES = ["proposed", "reviewed", "field_checked", "needs_survey", "disputed"]
SPLITS = ["train", "development", "evaluation"]
VOID = 255
EPS = 1e-9  # slack for inclusive comparisons of metric distances
