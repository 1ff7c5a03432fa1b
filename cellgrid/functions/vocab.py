"""Names, thresholds, colour stops and sample dimensions.

Everything here is data that results depend on, stated as is.
"""

from __future__ import annotations

# --- Fixed values: column variables and their older spellings -----------------------
VARIABLE_ALIASES = {
    "DUAOD": "DUEXTTAU",
    "BCAOD": "BCEXTTAU",
    "OCAOD": "OCEXTTAU",
    "SUAOD": "SUEXTTAU",
    "SSAOD": "SSEXTTAU",
    "TOTAOD": "TOTEXTTAU",
}
COLUMN_VARIABLES = ("TOTEXTTAU", "DUEXTTAU", "BCEXTTAU", "OCEXTTAU", "SUEXTTAU", "SSEXTTAU")
SURFACE_VARIABLES = ("PM25", "PM10", "O3", "NO2", "SO2", "CO")
DISPLAY_NAMES = {
    "DUEXTTAU": "Dust AOD",
    "TOTEXTTAU": "Total AOD",
    "BCEXTTAU": "Black carbon AOD",
    "OCEXTTAU": "Organic carbon AOD",
    "SUEXTTAU": "Sulfate AOD",
    "SSEXTTAU": "Sea salt AOD",
}

# --- Fixed values: enumerations, defaults and limits --------------------------------
INTENTS = ("health", "plume", "comparison")
LEVELS = ("surface", "column")
SOURCES = ("google", "merra2", "cams")
AGGREGATIONS = ("hourly", "daily", "monthly_mean")
VIEW_MODES = ("continuous", "exceedance")
ARCHIVE_SOURCE = "merra2"
DEFAULT_AGGREGATION = "daily"
DEFAULT_COLORMAP = "aqi"
DEFAULT_MODE = "continuous"
DEFAULT_OPACITY = 0.65
MAX_WINDOW_DAYS = {"hourly": 7, "daily": 62, "monthly_mean": 1825}
MAX_NLON, MAX_NLAT = 360, 180
ARCHIVE_LATENCY_DAYS = 45
RECENT_DAYS = 30
REQUESTS_PER_WINDOW, WINDOW_SECONDS = 30, 60.0
PIXEL_ALPHA = 235
# intent: (level, source, aggregation)
INTENT_DEFAULTS = {
    "health": ("surface", "google", "hourly"),
    "plume": ("column", "merra2", "daily"),
    "comparison": ("surface", "cams", "daily"),
}

# --- Fixed values: trigger phrase -> (variable, level) ------------------------------
TRIGGER_PHRASES = {
    "pm2.5": ("PM25", "surface"),
    "pm25": ("PM25", "surface"),
    "fine particles": ("PM25", "surface"),
    "pm10": ("PM10", "surface"),
    "coarse particles": ("PM10", "surface"),
    "smog": ("PM25", "surface"),
    "haze": ("PM25", "surface"),
    "dust": ("DUEXTTAU", "column"),
    "saharan dust": ("DUEXTTAU", "column"),
    "sandstorm": ("DUEXTTAU", "column"),
    "smoke": ("BCEXTTAU", "column"),
    "wildfire smoke": ("BCEXTTAU", "column"),
    "ash": ("DUEXTTAU", "column"),
    "volcanic": ("SUEXTTAU", "column"),
    "sulfate": ("SUEXTTAU", "column"),
    "sea salt": ("SSEXTTAU", "column"),
    "aerosol": ("TOTEXTTAU", "column"),
    "aod": ("TOTEXTTAU", "column"),
}

# --- Fixed values: health guidelines (variable, period, threshold, unit) ------------
GUIDELINES = (
    ("PM25", "annual", 5.0, "µg/m³"),
    ("PM25", "24h", 15.0, "µg/m³"),
    ("PM10", "annual", 15.0, "µg/m³"),
    ("PM10", "24h", 45.0, "µg/m³"),
    ("O3", "8h", 100.0, "µg/m³"),
    ("NO2", "annual", 10.0, "µg/m³"),
    ("NO2", "24h", 25.0, "µg/m³"),
    ("SO2", "24h", 40.0, "µg/m³"),
    ("CO", "8h", 10.0, "mg/m³"),
)

# --- Fixed values: place aliases and the sample gazetteer (w, s, e, n) --------------
PLACE_ALIASES = {
    "sahara desert": "Sahara",
    "new delhi": "Delhi",
    "la": "Los Angeles",
    "los angeles ca": "Los Angeles",
    "midwest": "US Midwest",
    "united states midwest": "US Midwest",
    "american midwest": "US Midwest",
    "amazon": "Amazon Basin",
    "amazon rainforest": "Amazon Basin",
    "gobi": "Gobi Desert",
    "indo gangetic plain": "Indo-Gangetic Plain",
    "arctic ocean": "Arctic",
    "se asia": "Southeast Asia",
    "atlanta ga": "Atlanta",
    "beijing china": "Beijing",
    "delhi india": "Delhi",
}
GAZETTEER = (
    ("Sahara", -17.0, 15.0, 35.0, 32.0),
    ("Sahel", -17.0, 10.0, 35.0, 18.0),
    ("Amazon Basin", -74.0, -12.0, -44.0, 5.0),
    ("Indo-Gangetic Plain", 68.0, 21.0, 90.0, 32.0),
    ("Delhi", 76.8, 28.4, 77.4, 28.9),
    ("Beijing", 115.7, 39.4, 117.4, 41.1),
    ("Los Angeles", -118.7, 33.7, -117.6, 34.3),
    ("California", -124.5, 32.5, -114.0, 42.0),
    ("Atlanta", -84.6, 33.6, -84.2, 34.0),
    ("US Midwest", -104.0, 36.5, -82.0, 49.0),
    ("Europe", -10.0, 35.0, 40.0, 60.0),
    ("Southeast Asia", 95.0, -5.0, 120.0, 20.0),
    ("Australia", 113.0, -44.0, 154.0, -10.0),
    ("Arctic", -180.0, 66.5, 180.0, 90.0),
    ("Gobi Desert", 88.0, 38.0, 120.0, 50.0),
)

# --- Fixed values: catalogue of known events ----------------------------------------
# (id, name, aliases, (w, s, e, n), start, end, ((source, level, intent, variable, aggregation), ...))
EVENT_CATALOG = (
    (
        "california-wildfires-2020", "2020 California wildfire season",
        ("2020 california fires", "august complex fire", "2020 california wildfires"),
        (-130.0, 30.0, -110.0, 45.0), "2020-08-15T00:00:00Z", "2020-10-31T23:59:59Z",
        (("merra2", "column", "plume", "BCEXTTAU", "daily"),
         ("cams", "surface", "health", "PM25", "daily")),
    ),
    (
        "sahara-dust-godzilla-2020", "June 2020 Saharan dust 'Godzilla' plume",
        ("godzilla dust", "2020 saharan dust plume", "june 2020 dust"),
        (-100.0, 5.0, 20.0, 35.0), "2020-06-14T00:00:00Z", "2020-06-28T23:59:59Z",
        (("merra2", "column", "plume", "DUEXTTAU", "daily"),),
    ),
    (
        "hunga-tonga-2022", "2022 Hunga Tonga volcanic eruption",
        ("hunga tonga", "tonga eruption", "2022 tonga volcano"),
        (150.0, -40.0, -120.0, 20.0), "2022-01-15T00:00:00Z", "2022-02-15T23:59:59Z",
        (("merra2", "column", "plume", "SUEXTTAU", "daily"),),
    ),
)

# --- Fixed values: colour ramps (position, colour) ----------------------------------
RENDER_RAMPS = {
    "dust": (
        (0.0, "#ffffcc"), (0.125, "#ffeda0"), (0.25, "#fed976"), (0.375, "#feb24c"), (0.5, "#fd8d3c"),
        (0.625, "#fc4e2a"), (0.75, "#e31a1c"), (0.875, "#bd0026"), (1.0, "#800026"),
    ),
    "viridis": (
        (0.0, "#440154"), (0.125, "#482878"), (0.25, "#3f4788"), (0.375, "#31688e"), (0.5, "#287d8e"),
        (0.625, "#1f968b"), (0.75, "#29af7f"), (0.875, "#5ec962"), (1.0, "#fde725"),
    ),
}
LEGEND_RAMPS = {
    "aod_sequential": (
        (0.0, "#ffffcc"), (0.2, "#ffeda0"), (0.4, "#fed976"), (0.6, "#feb24c"),
        (0.8, "#fd8d3c"), (1.0, "#fc4e2a"), (1.5, "#e31a1c"), (2.0, "#800026"),
    ),
    "aqi": (
        (0.0, "#00e400"), (12.0, "#ffff00"), (35.5, "#ff7e00"),
        (55.5, "#ff0000"), (150.5, "#8f3f97"), (250.5, "#7e0023"),
    ),
}
LEGEND_UNITS = {"surface": "µg/m³", "column": "AOD (unitless)"}
FIELD_UNITS = "dimensionless"

# --- Fixed values: granule file names -----------------------------------------------
GRANULE_PREFIX = "MERRA2_400"
GRANULE_SUFFIX = ".nc4"
GRANULE_DATE_PATTERN = r"\.(\d{8})\.nc4$"
COORDINATE_NAMES = ("time", "lat", "lon")
ITEM_SIZES = {"f4": 4, "f8": 8, "i4": 4}
