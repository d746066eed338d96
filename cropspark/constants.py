"""Fixed values of the domain: tables, thresholds and wording that results depend on."""

from __future__ import annotations

# --- fixed values: crop thermal time (cumulative degree days at the end of each stage) ---
CROP_STAGES = {
    "maize": [(120, "Emergence"), (700, "Vegetative"), (1000, "Flowering"), (1500, "Grain Fill"), (1700, "Maturity")],
    "sorghum": [(130, "Emergence"), (750, "Vegetative"), (1100, "Flowering"), (1650, "Grain Fill"), (1900, "Maturity")],
    "rice": [(100, "Emergence"), (800, "Vegetative"), (1100, "Flowering"), (1600, "Grain Fill"), (1800, "Maturity")],
}
DEFAULT_CROP = "maize"
FINAL_STAGE = "Post-Harvest"
FLOWERING = "Flowering"

# --- fixed values: crop coefficient per stage ---
KC_BY_STAGE = {
    "Emergence": 0.35,
    "Vegetative": 0.75,
    "Flowering": 1.20,
    "Grain Fill": 1.05,
    "Maturity": 0.60,
    "Post-Harvest": 0.30,
}
DEFAULT_KC = 1.0

# --- fixed values: degree days ---
GDD_BASE = 10.0
GDD_CAP = 30.0
HEAT_THRESHOLD_C = 35.0
FAW_DEGREE_DAYS = 390.0

# --- fixed values: season onset and dry spells ---
WET_SPELL_MM = 20.0
WET_SPELL_DAYS = 3
FOLLOW_DAYS = 30
KILLING_DRY_DAYS = 10
DRY_DAY_MM = 1.0

# --- fixed values: leaf-wetness severity table: (low, high, [(min wet hours, value)...]), closed bands ---
SEVERITY_BANDS = [
    (7.2, 11.6, [(25, 4), (22, 3), (19, 2), (16, 1)]),
    (11.7, 15.0, [(22, 4), (19, 3), (16, 2), (13, 1)]),
    (15.1, 26.6, [(23, 4), (19, 3), (15, 2), (11, 1)]),
]
WET_RH = 90
SPRAY_THRESHOLD = 18
SEVERITY_DAYS = 15

# --- fixed values: windows, horizons, tolerances ---
WINDOW_DAYS = 90
SHORT_WINDOW_DAYS = 30
MAX_LABEL_GAP_DAYS = 45
MIN_OBSERVATIONS = 6
MIN_COHORT = 5
MIN_COHORT_SD = 1e-6
RADAR_TOLERANCE_DAYS = 20
FRESH_HOURS = 48
KEEP_DAYS = 90
LABEL_HORIZON_DAYS = 30
CONSTANT_SD = 1e-9

# --- fixed values: label cuts and the anomaly-to-hazard map ---
SEVERE_Z = -1.0
ELEVATED_Z = -0.35
ANOMALY_SOFTNESS = 0.5

# --- fixed values: vulnerability weights, gap wording, protected attributes ---
COPING_WEIGHTS = {
    "has_irrigation": 1.0,
    "has_extension_access": 0.8,
    "received_credit": 0.7,
    "used_fertilizer": 0.5,
    "crop_diversity": 0.8,
    "asset_score": 1.0,
    "market_access": 0.6,
}
COPING_GAP_CUT = 0.34
GAP_WORDING = {
    "has_irrigation": "No irrigation available",
    "has_extension_access": "No contact with an extension officer",
    "received_credit": "No access to credit",
    "used_fertilizer": "No fertiliser applied",
    "crop_diversity": "Little crop diversification",
    "asset_score": "Few productive assets",
    "market_access": "Poor market access",
}
PROTECTED_ATTRIBUTES = frozenset({"head_gender", "household_max_education", "religion", "ethnicity"})

# --- fixed values: risk composition ---
MAX_LOSS_FRACTION = 0.6
RISK_BANDS = [(65, "CRITICAL"), (35, "ELEVATED"), (15, "WATCH")]
LOWEST_BAND = "NORMAL"
CLASS_BY_BAND = {"NORMAL": 0, "WATCH": 0, "ELEVATED": 1, "CRITICAL": 2}
PRIORITY_LABELS = {0: "Low Priority", 1: "Medium Priority", 2: "High Priority"}
HEALTH_BANDS = [(70, "Healthy"), (45, "Marginal"), (25, "Stressed")]
LOWEST_HEALTH = "Severely Stressed"
PRICE_USD_PER_T = {"maize": 250.0, "sorghum": 230.0, "rice": 420.0, "cassava": 120.0}
DEFAULT_PRICE_USD_PER_T = 250.0
FALLBACK_CROP_NAME = "Maize"

# --- fixed values: advisory wording ---
NO_DRIVERS = "No critical stress drivers detected"
ACTION_SPRAY = (
    "Apply a protective fungicide within 24-48 h: accumulated blight severity has "
    "reached the spray threshold, and dispatch an agent to confirm the diagnosis."
)
ACTION_DROUGHT = (
    "Prioritise supplemental irrigation — {crop} at {stage} is in water deficit. "
    "Advise mulching and, if the deficit persists, staggered replanting."
)
ACTION_HEAT = (
    "Heat stress during flowering: advise irrigation timed to early morning to "
    "reduce canopy temperature; expect pollination loss and plan for it."
)
ACTION_DISEASE = (
    "Blight severity is accumulating on {crop} at {stage}. Scout the lower canopy "
    "for lesions now and have fungicide staged before the threshold is reached."
)
ACTION_VEGETATION = (
    "Canopy is projected to fall behind neighbouring fields. Schedule a scouting "
    "visit to identify the cause before it shows in yield."
)
ACTION_MONITOR = "Increase monitoring frequency; no single dominant hazard yet."
ACTION_DEFAULT = "Maintain the standard fertiliser and weeding schedule."
PROBABILITIES_OF = "vegetation hazard (peer-relative canopy stress, 30-day horizon)"
PROBABILITIES_OF_ENCODED = PROBABILITIES_OF + " — encoded from a scalar, not a fitted posterior"
PERSISTENCE_VERSION = "persistence-v1"
OUTCOME_TYPES = ["agent_visit", "diagnosis", "harvest"]
YIELD_BOUNDS = (0.0, 30.0)

# --- fixed values: the seven sampled zones (closed boxes, first match wins) ---
ZONES = [
    ("Kaduna_Grain_Belt", 10.2, 11.5, 7.3, 8.5),
    ("Kano_Sudan_Savannah", 11.5, 12.6, 8.0, 9.2),
    ("Benue_River_Basin", 7.0, 8.1, 8.2, 9.4),
    ("Kenya_Rift_Valley", -0.2, 1.2, 34.8, 36.1),
    ("Ethiopian_Highlands", 8.3, 9.9, 38.0, 39.6),
    ("Tanzania_Morogoro", -8.0, -6.5, 36.4, 37.8),
    ("Niger_Delta", 4.3, 5.6, 5.6, 6.9),
]

# --- fixed values: feature names; the order is the contract ---
FEATURES = [
    "gdd_90", "gdd_since_onset", "tmax_mean_30", "tmin_mean_30", "diurnal_range_30", "heat_stress_days",
    "rain_30", "rain_90", "et0_90", "water_satisfaction_30", "water_deficit_30", "dry_spell_30", "dry_spell_90",
    "rain_anomaly_30", "rh_mean_30", "radiation_90", "days_since_onset", "stage_kc",
    "ndvi", "ndmi", "evi", "vci", "ndvi_z_peer", "latitude", "longitude", "elevation",
    "rvi", "vh_vv_ratio", "rvi_z_peer",
]
UNINFORMATIVE = frozenset(
    {"vci", "water_deficit_30", "rain_anomaly_30", "longitude", "gdd_since_onset", "tmin_mean_30"}
)
CLUSTER_RELATIVE = [
    "gdd_90", "tmax_mean_30", "diurnal_range_30", "heat_stress_days", "rain_30", "rain_90", "et0_90",
    "water_satisfaction_30", "dry_spell_30", "dry_spell_90", "rh_mean_30", "radiation_90",
    "ndvi", "ndmi", "evi", "rvi", "vh_vv_ratio",
]
TWIN_SUFFIX = "_cz"
TWINS = [c + TWIN_SUFFIX for c in CLUSTER_RELATIVE]
PEER_RELATIVE = ["ndvi", "rvi"]
MODEL_FEATURES = [c for c in FEATURES if c not in UNINFORMATIVE] + TWINS
SERVABLE_FEATURES = frozenset(FEATURES) | frozenset(TWINS)
RADAR_FEATURES = frozenset({"rvi", "vh_vv_ratio", "rvi_z_peer", "rvi" + TWIN_SUFFIX, "vh_vv_ratio" + TWIN_SUFFIX})
TARGET = "forward_z"
WEATHER_VARS = ["tmax", "tmin", "rain", "et0", "rh", "radiation"]

# --- fixed values: names of the six weather variables in a landed payload, in WEATHER_VARS order ---
PAYLOAD_VARS = [
    "temperature_2m_max", "temperature_2m_min", "precipitation_sum",
    "et0_fao_evapotranspiration", "relative_humidity_2m_mean", "shortwave_radiation_sum",
]
OPTICAL_KEYS = ["ndvi", "ndwi", "evi"]
RADAR_KEYS = ["vv", "vh", "rvi"]
BAND_KEYS = ["b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12"]

# --- fixed values: embedding input layout (12 months x 17 channels) and unit changes ---
N_MONTHS = 12
CHANNELS = ["vv", "vh", *BAND_KEYS, "temp", "precip", "elevation", "slope", "ndvi"]
RADAR_SHIFT_DB, RADAR_DIV_DB = 25.0, 25.0
TEMP_SHIFT_C, TEMP_DIV = 1.0, 35.0
PRECIP_DIV_M = 0.03
ELEVATION_DIV = 2000.0
DB_FLOOR = -50.0
EMBED_BATCH = 256

# --- fixed values: evaluation protocol ---
TOP_K = [10, 25, 50]
SWEEP_MULTIPLIERS = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
SWEEP_MAX_SHARE = 0.98
MIN_TEST_ROWS = 30
N_CLASSES = 3
TEMPORAL_FOLDS = 3
TEMPORAL_START, TEMPORAL_STEP = 0.55, 0.12
SITE_SEED = 7
