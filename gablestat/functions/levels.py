"""Fixed values of the assessment roll: levels, synonyms, header drift and feature lists.

Everything here is data that results depend on, kept in its natural order.
"""

# Ordered levels of the coded condition columns, lowest first.
CONDITION_LEVELS = ["P - Poor", "F - Fair", "A - Average", "G - Good", "E - Excellent"]
BATHROOM_STYLE_LEVELS = ["N - No Remodeling", "S - Semi-Modern", "M - Modern", "L - Luxury"]
KITCHEN_TYPE_LEVELS = ["N - None", "O - One Person", "P - Pullman", "F - Full Eat In"]
HEAT_FUEL_LEVELS = ["N - None", "G - Gas", "O - Oil", "E - Electric", "W - Wood"]
HEAT_SYSTEM_LEVELS = ["N - None", "C - Common", "I - Indiv. Cntrl", "Y - Self Contained"]
ORIENTATION_LEVELS = [
    "A - Rear Above", "B - Rear Below", "C - Courtyard", "E - End", "F - Front/Street", "M - Middle", "T - Through",
]
VIEW_LEVELS = ["P - Poor", "F - Fair", "A - Average", "G - Good", "E - Excellent", "S - Special"]
CORNER_LEVELS = ["N - No", "Y - Yes"]

ORDINAL_LEVELS = {
    "overall_cond": CONDITION_LEVELS,
    "bthrm_style1": BATHROOM_STYLE_LEVELS,
    "kitchen_type": KITCHEN_TYPE_LEVELS,
    "heat_system": HEAT_SYSTEM_LEVELS,
    "orientation": ORIENTATION_LEVELS,
    "prop_view": VIEW_LEVELS,
    "corner_unit": CORNER_LEVELS,
}

# The same columns after the code prefix is gone, as the boosted model encodes them.
MODEL_ORDINAL_LEVELS = {
    "overall_cond": ["Poor", "Fair", "Average", "Good", "Excellent", "Special"],
    "bthrm_style1": ["No Remodeling", "Semi-Modern", "Modern", "Luxury"],
    "bthrm_style2": ["No Remodeling", "Semi-Modern", "Modern", "Luxury"],
    "bthrm_style3": ["No Remodeling", "Semi-Modern", "Modern", "Luxury"],
    "kitchen_type": ["None", "One Person", "Pullman", "Full Eat In"],
    "kitchen_style1": ["None", "One Person", "Pullman", "Full Eat In"],
    "kitchen_style2": ["None", "One Person", "Pullman", "Full Eat In"],
    "kitchen_style3": ["None", "One Person", "Pullman", "Full Eat In"],
    "heat_type": ["None", "Common", "Individual", "Self Contained"],
    "heat_system": ["None", "Common", "Individual", "Self Contained"],
    "ac_type": ["None", "Yes"],
    "corner_unit": ["No", "Yes"],
    "prop_view": ["Poor", "Fair", "Average", "Good", "Excellent", "Special"],
    "orientation": ["Rear Above", "Rear Below", "Courtyard", "End", "Front/Street", "Middle", "Through"],
    "structure_class": ["Steel", "Concrete", "Brick/Concrete", "Wood/Frame", "Metal"],
}

# Synonyms of the overall condition.
CONDITION_SYNONYMS = {
    "E - Excellent": ["EX - Excellent", "E - Excellent"],
    "G - Good": ["VG - Very Good", "G - Good"],
    "A - Average": ["AVG - Default - Average", "A - Average"],
    "P - Poor": ["VP - Very Poor", "P - Poor", "US - Unsound"],
}

# The levels of heat_fuel are no ranks, and it is another column than heat_system.
# Header names that changed between snapshots, old name to current name.
HEADER_ALIASES = {
    "zipcode": "zip_code",
    "kitchen": "kitchens",
    "fire_place": "fireplaces",
}
LATE_COLUMNS = ["sfyi_value", "corner_unit"]

# Column roles of the roll.
COMMA_NUMBERS = ["land_sf", "land_value", "bldg_value", "total_value", "gross_area", "living_area"]
CURRENCY_COLUMNS = ["gross_tax"]
PLAIN_NUMBERS = ["yr_built", "yr_remodel", "bed_rms", "full_bth", "hlf_bth", "num_parking"]

# Model inputs. Ratios derived from the target are left out on purpose.
TREE_FEATURES = [
    "bldg_value", "land_value", "gross_area", "living_area", "land_sf", "num_bldgs",
    "yr_built", "yr_remodel",
    "bed_rms", "full_bth", "hlf_bth", "kitchens", "fireplaces", "num_parking",
    "gross_tax", "age_of_property",
    "bldg_type", "city", "zip_code", "overall_cond",
    "int_cond", "ext_cond", "structure_class", "roof_structure",
    "heat_type", "ac_type", "own_occ", "prop_view", "orientation",
]
BOOSTED_FEATURES = [
    "bldg_value", "land_value", "gross_area", "living_area", "land_sf", "num_bldgs",
    "yr_built", "yr_remodel", "structure_class", "roof_structure", "roof_cover",
    "int_cond", "ext_cond", "overall_cond", "bldg_type",
    "bed_rms", "full_bth", "hlf_bth", "kitchens", "kitchen_type", "kitchen_style1",
    "fireplaces", "heat_type", "heat_system", "ac_type", "num_parking", "prop_view",
    "corner_unit", "zip_code", "city", "orientation",
    "gross_tax", "own_occ",
]
LEAKING_COLUMNS = ["price_per_sqft", "tax_to_value_ratio"]
REGRESSION_FEATURES = [
    "log_land_sf", "log_living_area", "bed_rms", "full_bth", "hlf_bth", "fireplaces", "num_parking", "age_of_property",
]
