"""Table schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())

NODES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("tags", TAGS),
])
WAYS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())),
    T.StructField("tags", TAGS),
])
RELATIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", TAGS)])
MEMBERS = T.StructType([
    T.StructField("relation_id", T.LongType()), T.StructField("sequence", T.IntegerType()),
    T.StructField("member_type", T.StringType()), T.StructField("member_ref", T.LongType()),
    T.StructField("member_role", T.StringType()),
])

# ---- Fixed values: results must agree with published behaviour --------------
# speeds in m/s, waits in s, heights and distances in m
WALK_SPEED = 1.4
STEPS_SPEED = 0.5
ESCALATOR_SPEED = 0.9
ELEVATOR_SPEED = 1.4
ELEVATOR_WAIT_S = 30.0
FLOOR_HEIGHT_M = 4.0
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = 111_320.0
CLOSURE_RADIUS_M = 1000.0
STATION_PAD_M = 600.0
STOP_SNAP_M = 40.0
LEVEL_DELTA = 0.5
PLAUSIBLE_FLOOR_S = 900.0
PLAUSIBLE_DETOUR = 3.0
PLAUSIBLE_SLACK_S = 60.0
BUFFER_S = 60.0
SAME_STATION_M = 750.0
CANDIDATE_RADIUS_M = 600.0
CANDIDATE_LIMIT = 6
IMPLAUSIBLE_ABS_M = 800.0
IMPLAUSIBLE_DETOUR = 4.0
IMPLAUSIBLE_SLACK_M = 250.0
STATION_MATCH_M = 1200.0
LABEL_RADIUS_M = 160.0
QUAY_RADIUS_M = 160.0
OVERLAY_MAX_M = 1500.0
OVERLAY_MERGE_M = 300.0
FACILITY_RADIUS_M = 250.0
FACILITY_LIMIT = 25
HEALTH_MAX_PLATFORMS = 24
HEALTH_EXAMPLES = 6
RAIL_FILTER_M = 250.0
HARVEST_RADIUS_M = 700.0
HARVEST_BOX_DEG = (0.003, 0.005)
HUB_RADIUS_M = 1600.0
BOARDING_HIGH_S = 40.0
BOARDING_SOME_S = 12.0
ATTRIB_RADIUS_M = 8.0
ATTRIB_WIDE_RADIUS_M = 12.0
ATTRIB_SLACK_M = 0.6
MARKER_SNAP_M = 60.0
PLATFORM_KEEP_M = 200.0
LANDMARK_DIST_M = 15.0
LANDMARK_LIMIT = 10
MAIN_STATION_MEMBERS = 10
MAX_TRANSFER_WALK_M = 1500.0
MIN_IMPROVEMENT_S = 60.0

# verdicts and reasons
FEASIBLE, TIGHT, INFEASIBLE = "feasible", "tight", "infeasible"
UNKNOWN, PENDING = "unknown", "pending"
NO_PLATFORM_DATA = "no_platform_data"
STATION_UNRESOLVED = "station_unresolved"
CROSS_STATION = "cross_station"
NO_TIMING = "no_timing"
IMPLAUSIBLE_WALK = "implausible_walk"
PLATFORM_NOT_FOUND = "platform_not_found"
NO_COORDINATES = "no_coordinates_for_platform_nodes"
DISCONNECTED = "disconnected"
EXCEEDED = "exceeded_plausibility_bound"
CONNECTED, STITCHABLE, ISLAND = "connected", "stitchable", "island"
UNSUPPORTED_CATEGORY = "unsupported_category"
NO_POI_LAYER = "no_poi_layer"
NONE_MAPPED = "none_mapped"

# tag keys a multipolygon hands down to its untagged member ways
INHERITED_KEYS = [
    "highway", "indoor", "level", "railway", "public_transport",
    "conveying", "oneway", "foot", "layer", "area",
]
POI_CATEGORIES = ["shop", "amenity", "tourism", "office", "leisure"]
AMENITY_NOISE = [
    "bench", "waste_basket", "bicycle_parking", "vending_machine", "recycling",
    "drinking_water", "clock", "fountain", "shelter", "telephone", "post_box",
    "parking", "parking_space", "parking_entrance", "motorcycle_parking",
    "bicycle_repair_station", "grit_bin", "bbq", "smoking_area", "charging_station",
]
LANDMARK_DENIED = [
    "atm", "toilets", "shower", "taxi", "vending_machine", "charging_station",
    "bicycle_rental", "bicycle_parking", "car_rental", "motorcycle_rental",
    "mobility_hub", "information", "artwork", "clock", "drinking_water",
    "vacant", "parking", "parking_entrance", "bureau_de_change",
    "luggage_locker", "locker", "left_luggage",
]
WALK_MODES = ["WALK", "BIKE", "CAR", "BIKE_SHARING", "CAR_SHARING", "SCOOTER_SHARING"]
# facility category -> (poi category, subtypes or None for any)
FACILITY_CLAUSES = {
    "toilets": [("amenity", ["toilets"])],
    "coffee": [("amenity", ["cafe", "fast_food"]), ("shop", ["coffee"])],
    "food": [("amenity", ["restaurant", "fast_food", "food_court", "cafe"])],
    "atm": [("amenity", ["atm", "bank", "bureau_de_change"])],
    "tickets": [("shop", ["ticket"])],
    "shops": [("shop", None)],
    "pharmacy": [("amenity", ["pharmacy"]), ("shop", ["chemist"])],
    "taxi": [("amenity", ["taxi"])],
    "info": [("tourism", ["information"])],
    "luggage": [("amenity", ["luggage_locker", "left_luggage"])],
}
FACILITY_ALIASES = {
    "toilet": "toilets", "wc": "toilets", "restroom": "toilets", "restrooms": "toilets",
    "cafe": "coffee", "coffees": "coffee",
    "restaurant": "food", "restaurants": "food", "eat": "food",
    "cash": "atm", "bank": "atm", "money": "atm",
    "ticket": "tickets",
    "shop": "shops", "store": "shops", "stores": "shops",
    "chemist": "pharmacy", "drugstore": "pharmacy",
    "taxis": "taxi", "cab": "taxi",
    "information": "info", "tourist_info": "info",
    "left_luggage": "luggage", "lockers": "luggage", "locker": "luggage",
}
# survey boxes: lat_min, lat_max, lon_min, lon_max
SURVEY_REGIONS = {
    "de": (47.2, 55.1, 5.8, 15.1), "ch": (45.8, 47.9, 5.9, 10.5),
    "at": (46.3, 49.1, 9.5, 17.2), "fr": (41.3, 51.2, -5.2, 9.7),
    "nl": (50.7, 53.7, 3.3, 7.3), "be": (49.4, 51.6, 2.5, 6.5),
    "it": (36.6, 47.1, 6.6, 18.6), "es": (35.9, 43.9, -9.4, 3.4),
    "gb": (49.9, 58.7, -8.2, 1.8), "dach": (45.8, 55.1, 5.8, 17.2),
    "benelux": (49.4, 53.7, 2.5, 7.3),
}
HUB_STOPWORDS = [
    "hbf", "bf", "bhf", "bahnhof", "hauptbahnhof", "s", "u", "su", "main",
    "berlin", "hamburg", "st", "der", "am", "an",
]
HUB_MAIN_WORDS = ["hauptbahnhof", "hbf"]  # both name the main station, alone or inside a longer word
TRACK_PREFIX = r"(?i)^(gl|gleis|regio|bstg\.?|voie|quai|binario|bin\.?|spoor|via)\s+"
QUAY_LABEL = r"(?i)(?:Gleise?|Bahnsteig)\s+([0-9]+[a-zA-Z]?(?:\s*/\s*[0-9]+[a-zA-Z]?)*)"
COACH_CLASSES = {
    "REISEZUGWAGENERSTEKLASSE": "1", "REISEZUGWAGENZWEITEKLASSE": "2",
    "REISEZUGWAGENERSTEZWEITEKLASSE": "12", "HALBSPEISEWAGENERSTEKLASSE": "WR",
    "HALBSPEISEWAGENZWEITEKLASSE": "WR", "SPEISEWAGEN": "WR",
}
UNBOARDABLE = ["TRIEBKOPF", "LOK", "STEUERWAGEN"]
DELAY_SWEEP_MIN = [1, 2, 3, 4, 5, 7, 10, 15]
# -----------------------------------------------------------------------------
