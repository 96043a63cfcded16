"""Fixed values that must equal the reference application's for equal results."""

# --- fixed values: supervisor district id -> name (11 entries) -------------
DISTRICT_NAMES = {
    1: "Richmond",
    2: "Marina, Cow Hollow",
    3: "North Beach, Chinatown",
    4: "Sunset",
    5: "Haight-Ashbury, Fillmore",
    6: "SOMA, Tenderloin",
    7: "Mission, Bernal Heights",
    8: "Castro, Noe Valley",
    9: "Mission, Portola",
    10: "Potrero Hill, Bayview",
    11: "Excelsior, Outer Mission",
}

# --- fixed values: map colours by category rank (rank 1 first) -------------
CATEGORY_COLORS = [
    "#e74c3c",
    "#3498db",
    "#2ecc71",
    "#f39c12",
    "#9b59b6",
    "#1abc9c",
    "#e67e22",
    "#34495e",
    "#e91e63",
    "#00bcd4",
]

# --- fixed values: thresholds and sizes ------------------------------------
RAW_CUTOFF_DAYS = 90          # ranges longer than this are answered from rollups
GRID_SIZE = 0.01              # degrees, ~1 km
RESOLUTION_MAX_HOURS = 8760   # valid resolution: 0 <= h < 8760 (one year)
POINT_BOX = (37.5, 38.0, -123.0, -122.0)   # lat_min, lat_max, lon_min, lon_max
RAIN_DAY_MM = 0.1             # rain_day = precipitation > 0.1 mm
EVENT_NAME_MAX = 120          # event names kept when shorter than this
CLOSURE_NAME_MAX = 100        # closure names kept when shorter than this
NAME_CUT = 80                 # names longer than this are cut to 80 + ellipsis
NAMES_PER_DATE = 8            # names kept per date
ANOMALY_Z = 2.0               # z-score threshold (strictly greater)
ANOMALY_WINDOW_DAYS = 30
ANOMALY_RECENT_DAYS = 7
ANOMALY_TOP_CATEGORIES = 20
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CONSTRUCTION_PREFIX = "Construction: "
ELLIPSIS = "…"
