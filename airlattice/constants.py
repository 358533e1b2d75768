"""Fixed values that must equal the reference service's for the same results.

Everything here is data, stated plainly in natural order; the logic that uses it lives
in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --- Fixed values: AQI breakpoints per pollutant -------------------------------------
# (concentration ceiling, index high, index low), first band whose ceiling is >= c wins.
AQI_BREAKPOINTS = {
    "co": [
        (4.4, 50, 0),
        (9.4, 100, 51),
        (12.4, 150, 101),
        (15.4, 200, 151),
        (30.4, 300, 201),
        (40.4, 400, 301),
        (50.4, 500, 401),
    ],
    "no2": [
        (40, 50, 0),
        (90, 100, 51),
        (120, 150, 101),
        (230, 200, 151),
        (340, 300, 201),
        (1000, 400, 301),
    ],
    "o3": [
        (50, 50, 0),
        (100, 100, 51),
        (130, 150, 101),
        (240, 200, 151),
        (380, 300, 201),
        (800, 400, 301),
    ],
    "pm2_5": [
        (10, 50, 0),
        (20, 100, 51),
        (25, 150, 101),
        (50, 200, 151),
        (75, 300, 201),
        (800, 400, 301),
    ],
    "pm10": [
        (20, 50, 0),
        (40, 100, 51),
        (50, 150, 101),
        (100, 200, 151),
        (150, 300, 201),
        (1200, 400, 301),
    ],
    "so2": [
        (100, 50, 0),
        (200, 100, 51),
        (350, 150, 101),
        (500, 200, 151),
        (750, 300, 201),
        (1250, 400, 301),
    ],
}

# Pollutants whose sub-index enters the row AQI, in the reference's order.
AQI_INPUTS = ["co", "no2", "o3", "pm2_5", "pm10", "so2"]

# --- Fixed values: pollutant columns and display names -------------------------------
POLLUTANTS = {
    "aqi": "AQI",
    "co": "CO",
    "nh3": "NH3",
    "no": "NO",
    "no2": "NO2",
    "o3": "O3",
    "pm2_5": "PM2.5",
    "pm10": "PM10",
    "so2": "SO2",
}

# --- Fixed values: upstream column name -> canonical column name ---------------------
RENAMES = {
    "dt": "time",
    "temperature": "temp",
    "apparentTemperature": "feels_like",
    "dewPoint": "dew_point",
    "cloudCover": "clouds",
    "windSpeed": "wind_speed",
    "windGust": "wind_gust",
    "windBearing": "wind_deg",
    "summary": "weather.description",
    "icon": "weather.icon",
    "uvIndex": "uvi",
    "precipIntensity": "precipitation",
    "AQI": "aqi",
    "CO": "co",
    "CO2": "co2",
    "NH3": "nh3",
    "NO": "no",
    "NO2": "no2",
    "O3": "o3",
    "PM25": "pm2_5",
    "PM10": "pm10",
    "SO2": "so2",
}

# Columns dropped after renaming: any name containing this text, plus the list below.
# --- Fixed values: columns that are dropped ------------------------------------------
DROP_CONTAINING = "weather"
DROP_COLUMNS = ["precipProbability", "precipType", "ozone", "co2"]

# --- Fixed values: columns never coerced / mean-filled in the cleaning pipeline --------
NON_NUMERIC = ["aqi", "icon", "precipType", "summary"]

# --- Fixed values: supported countries ----------------------------------------------
COUNTRIES = {
    "AL": "Albania",
    "BG": "Bulgaria",
    "CH": "Switzerland",
    "CY": "Cyprus",
    "DE": "Germany",
    "DK": "Denmark",
    "GR": "Greece",
    "HR": "Croatia",
    "IE": "Ireland",
    "MD": "Moldova",
    "MK": "Macedonia",
    "NL": "Netherlands",
    "RO": "Romania",
    "RS": "Serbia",
    "US": "USA",
}

# First IANA zone of each supported country (public tz database).
COUNTRY_ZONES = {
    "AL": "Europe/Tirane",
    "BG": "Europe/Sofia",
    "CH": "Europe/Zurich",
    "CY": "Asia/Nicosia",
    "DE": "Europe/Berlin",
    "DK": "Europe/Copenhagen",
    "GR": "Europe/Athens",
    "HR": "Europe/Zagreb",
    "IE": "Europe/Dublin",
    "MD": "Europe/Chisinau",
    "MK": "Europe/Skopje",
    "NL": "Europe/Amsterdam",
    "RO": "Europe/Bucharest",
    "RS": "Europe/Belgrade",
    "US": "America/New_York",
}

# --- Fixed values: calendar features -------------------------------------------------
# Season by (month, day) inclusive ranges within a year.
SEASONS = [
    ("winter", (1, 1), (3, 20)),
    ("spring", (3, 21), (6, 20)),
    ("summer", (6, 21), (9, 22)),
    ("autumn", (9, 23), (12, 20)),
    ("winter", (12, 21), (12, 31)),
]
# Fixed season codes (alphabetical order of the four names).
SEASON_CODES = {"autumn": 0, "spring": 1, "summer": 2, "winter": 3}
SESSION_BINS = [0, 4, 8, 12, 16, 20, 24]
SESSION_LABELS = ["Late Night", "Early Morning", "Morning", "Noon", "Eve", "Night"]
DAYS_IN_MONTH = 30
QUARTERS_IN_YEAR = 4

# --- Fixed values: modelling and serving constants -----------------------------------
EARTH_RADIUS_KM = 6371.0088
NEAREST_RADIUS_KM = 2.0
PACF_THRESHOLD = 0.2
TRAIN_LAGS = 24
FORECAST_LAGS = 25
FORECAST_STEPS = 25
TAIL_ROWS = 51
TRAIN_FRACTION = 0.75
SIGNIFICANCE_LEVEL = 0.05
MODEL_LIFETIME_SECONDS = 7_889_400
HISTORY_SPAN_SECONDS = 604_800
LOOKBACK_WEEKS = 52
SEARCH_DRAWS = 50
SEARCH_FOLDS = 5
SEARCH_SEED = 42
KNN_MISSING_THRESHOLD = 0.5
