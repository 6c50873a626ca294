"""The markers, the pattern rules and the rank of categories. All are small broadcast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Marker, domain, least robust standard deviation.
MARKERS = [
    ("sleep_onset_hour", "sleep", 0.5),
    ("sleep_duration_hours", "sleep", 0.4),
    ("sleep_regularity_index", "sleep", 5.0),
    ("late_night_screen_min", "screen", 15.0),
    ("total_screen_min", "screen", 30.0),
    ("app_switching_rate", "screen", 0.25),
    ("mobility_entropy", "mobility", 0.15),
    ("location_revisit_ratio", "mobility", 0.08),
    ("social_rhythm_metric", "social", 0.08),
    ("comm_reciprocity", "social", 0.1),
]
NAMES = [m for m, _, _ in MARKERS]

#: Pattern, marker, direction, whether it is required.
RULES = [
    ("phone-mediated-sleep-delay", "sleep_onset_hour", "up", True),
    ("phone-mediated-sleep-delay", "late_night_screen_min", "up", True),
    ("behavioral-withdrawal", "mobility_entropy", "down", True),
    ("behavioral-withdrawal", "location_revisit_ratio", "up", True),
    ("behavioral-withdrawal", "social_rhythm_metric", "down", False),
    ("circadian-instability", "sleep_regularity_index", "down", True),
    ("circadian-instability", "sleep_onset_hour", "up", False),
    ("circadian-instability", "social_rhythm_metric", "down", False),
    ("fragmented-attention-with-sleep-loss", "app_switching_rate", "up", True),
    ("fragmented-attention-with-sleep-loss", "sleep_duration_hours", "down", True),
]
PATTERNS = list(dict.fromkeys(r[0] for r in RULES))

#: What a finding says: marker, subject, word for more, word for less, unit, decimals (none: a clock time), factor.
SAYINGS = [
    ("sleep_onset_hour", "bedtime", "later", "earlier", "", None, 1),
    ("sleep_duration_hours", "nightly sleep", "longer", "shorter", " h", 1, 1),
    ("sleep_regularity_index", "sleep timing", "steadier", "less steady", " points", 0, 1),
    ("late_night_screen_min", "screen time at night", "higher", "lower", " min", 0, 1),
    ("total_screen_min", "screen time of a day", "higher", "lower", " min", 0, 1),
    ("app_switching_rate", "app switching", "faster", "slower", " a minute", 1, 1),
    ("mobility_entropy", "spread over places", "wider", "narrower", "", 2, 1),
    ("location_revisit_ratio", "time at the three main places", "larger", "smaller", " %", 0, 100),
    ("social_rhythm_metric", "timing of the day's anchors", "more regular", "less regular", "", 2, 1),
    ("comm_reciprocity", "outgoing share of messages", "larger", "smaller", " %", 0, 100),
]

#: Searches by risk level; any other level has the last.
RISK_SEARCHES = {
    "severe": ["emotional coping strategies", "social support wellness"],
    "moderate": ["stress reduction techniques", "sleep improvement mental health"],
    "": ["habit formation daily routine", "mindfulness practice"],
}

#: State, role, outcome, and whether the next day is compared too.
CONSTRUCTS = [
    ("phone-mediated-sleep-delay", "PRIMARY", "sleep_hours", True),
    ("phone-mediated-sleep-delay", "SECONDARY", "sleep_quality", True),
    ("behavioral-withdrawal", "PRIMARY", "stress_severity", False),
    ("behavioral-withdrawal", "SECONDARY", "pam_valence", False),
    ("circadian-instability", "PRIMARY", "sleep_quality", True),
    ("circadian-instability", "SECONDARY", "sleep_hours", True),
    ("fragmented-attention-with-sleep-loss", "PRIMARY", "sleep_hours", True),
    ("fragmented-attention-with-sleep-loss", "SECONDARY", "stress_severity", False),
]

#: Key, its values (none: any), label of a map feature; the first that holds counts.
MAP_LABELS = [
    ("amenity", ["university", "college", "school"], "education/campus"),
    ("amenity", ["parking", "parking_space"], "parking"),
    ("amenity", ["restaurant", "cafe", "fast_food"], "food venue"),
    ("amenity", ["library"], "library"),
    ("amenity", ["gym", "fitness_centre"], "fitness facility"),
    ("leisure", ["swimming_pool"], "swimming pool"),
    ("leisure", ["park", "garden"], "green space"),
    ("leisure", ["pitch", "sports_centre", "track"], "sports/recreation area"),
    ("natural", ["water", "bay", "wetland"], "water feature"),
    ("natural", ["wood", "tree", "tree_row"], "trees/wooded area"),
    ("landuse", ["grass", "meadow", "recreation_ground"], "grass/open green area"),
    ("landuse", ["residential"], "residential area"),
    ("landuse", ["commercial", "retail"], "commercial area"),
    ("landuse", ["education"], "education/campus"),
    ("building", None, "buildings"),
    ("highway", ["footway", "path", "pedestrian"], "walkways/paths"),
    ("highway", None, "road network"),
]

#: Weights of magnitudes in the risk index, scores of coverage classes.
MAGNITUDES = ["within-typical", "mild", "moderate", "pronounced"]


def marker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(MARKERS)], "position int, marker string, domain string, least_std double")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(PATTERNS.index(r[0]), i, *r) for i, r in enumerate(RULES)], "pattern_position int, position int, pattern string, marker string, direction string, required boolean")
