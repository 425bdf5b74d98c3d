"""Fixed values of the livestock vocabulary. Every operator takes them as parameters."""

# --- fixed values: they must equal the source system's for right results -------------
BREED_BY_CODE = {
    "00": "meticcia", "0": "meticcia", "0.0": "meticcia",
    "01": "bruna", "1": "bruna", "1.0": "bruna",
    "02": "frisona", "2": "frisona", "2.0": "frisona",
    "04": "pezzata", "4": "pezzata", "4.0": "pezzata",
}
BREEDS_KEPT = ["frisona", "pezzata", "meticcia", "bruna"]

CONTROL_NAMES = {
    "idAnimale": "id", "razza": "breed", "giorno": "day", "mese": "month", "anno": "year",
    "LatteAlle24Ore": "milk", "ProteineAlle24Ore": "protein", "GrassoAlle24Ore": "fat",
    "LinearScore": "scs", "DataControlloFunzionaleLatte": "cf_date",
}
CONTROL_SCHEMA = {
    "idAnimale": "bigint", "anno": "int", "mese": "int", "giorno": "int",
    "codiceRazzaAIA": "string", "LinearScore": "double", "LatteAlle24Ore": "double",
    "ProteineAlle24Ore": "double", "GrassoAlle24Ore": "double",
}
LACTOSE = "Lattosio"
CONDUCTIVITY = "Conducibilità elettrica"
FALLBACK_MEASURE = "valoreMisura"
BIRTH_COUNTERS = [
    "NumeroFemmineNateVive", "NumeroFemmineNateMorte",
    "NumeroMaschiNatiVivi", "NumeroMaschiNatiMorti",
]

MEASURES = ["scs", "milk", "protein", "fat", "lactose", "ec"]
PLAUSIBLE_RANGES = {
    "scs": (0.0, 9.0), "milk": (0.0, 700.0), "protein": (0.0, 6.0),
    "fat": (0.0, 8.0), "lactose": (4.0, 5.5), "ec": (500.0, 2000.0),
}
ENTITY_LEVELS = [
    ["id", "lactation_phase", "age_class", "season"],
    ["id", "lactation_phase", "age_class"],
    ["id", "lactation_phase"],
]
POPULATION_LEVELS = [
    ["breed", "lactation_phase", "age_class", "season"],
    ["breed", "lactation_phase", "age_class"],
    ["breed", "lactation_phase"],
]
AGE_EDGES = [1.5, 3.5, 5.5, 7.5]
AGE_LABELS = ["2_3", "4_5", "6_7"]
SEASON_MONTHS = {
    "winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11],
}
LABEL_WINDOW_DAYS = 30
HIGH_SCS = 5

LAG_STEPS = [1, 2]
MIN_YEAR = 2020
SEQUENCE_LENGTH = 3
SUPPORT_COLUMNS = [
    "cf_date", "disease", "healthy", "age", "age_class", "season", "lactation_phase",
    "months_since_calving", "month_sin", "month_cos",
]
LAG_VARIABLES = ["scs", "fat", "lactose", "milk", "protein", "ec"]
KEEP_VARIABLES = ["age", "months_since_calving", "month_sin", "month_cos"]
PANEL_META_COLUMNS = ["calving_date", "calving", "diagnosis", "t_date", "birth_date", "breed"]
MERGE_DROPPED_COLUMNS = ["Marca", "day_x", "day_y", "day", "same_day_records"]
SAMPLE_STRATA = ["age", "lactation_phase", "season"]
REPORT_STRATA = ["breed", "lactation_phase", "season", "age_class"]
# --- end of fixed values -------------------------------------------------------------

#: Levels that one-hot columns are made of.
ENCODED_LEVELS = {
    "breed": sorted(BREEDS_KEPT), "age_class": AGE_LABELS, "season": sorted(SEASON_MONTHS),
    "lactation_phase": ["peripartum", "early_lactation", "peak", "mid_lactation", "late_lactation"],
}
