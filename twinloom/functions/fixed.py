"""Word lists, thresholds and tables that results depend on."""

# Sensitivity words looked for inside column names, strongest level first, and the epsilon cap per level.
SENSITIVITY_WORDS = {
    "critical": ["ssn", "social_security", "diagnosis", "icd", "patient_id", "encounter_id", "mrn", "dob", "date_of_birth",
                 "insurance", "genetic", "hiv", "mental", "psychiatr", "substance"],
    "high": ["name", "age", "gender", "race", "ethnicity", "zip", "address", "medication", "drug", "lab", "glucose", "blood",
             "pressure", "cholesterol", "weight", "bmi", "height", "readmit"],
    "medium": ["hospital", "visit", "procedure", "admission", "discharge", "specialty", "payer", "insurance_type"],
}
EPSILON_CAPS = {"critical": 0.5, "high": 1.0, "medium": 3.0, "low": 10.0}

# Words that mark a time, entity, path or demographic column.
TIME_WORDS = ["time", "date", "visit", "day", "month", "year", "seq", "order", "encounter", "admission"]
TIME_WORDS_GENERATOR = ["time", "date", "visit", "encounter", "seq"]
ENTITY_WORDS = ["patient", "subject", "id", "nbr", "mrn"]
PATH_WORDS = ["path", "file", "image", "img"]
DEMOGRAPHIC_WORDS = ["sex", "gender", "race", "ethnicity", "age", "religion", "nationality", "marital", "zip", "income",
                     "education", "insurance"]

# Release floors, and the relaxed floors of a second try.
FLOORS = {"privacy": 0.70, "mia": 0.75, "singling": 0.80, "leak": 0.75, "utility": 0.60}
RELAXED_FLOORS = {"privacy": 0.60, "mia": 0.75, "singling": 0.65, "leak": 0.55, "utility": 0.60}

# Reward weights, and what stands in for a score that is not finite.
REWARD_WEIGHTS = {"privacy": 0.40, "utility": 0.30, "realism": 0.20, "diversity": 0.10}
REWARD_FALLBACKS = {"privacy": 0.5, "utility": 0.0, "realism": 0.5, "diversity": 0.5}

# Generator keys, the order in which they are tried per modality, and the replacement for one to avoid.
MODEL_KEYS = ["ctgan", "diffusion", "ensemble", "gnn", "llm", "tabddpm"]
CHAINS = {"tabular": ["ctgan", "tabddpm"], "text": ["llm"], "image": ["diffusion"], "graph": ["gnn", "ctgan"]}
LADDER = {"tabddpm": "ctgan", "ctgan": "tabddpm", "llm": "ctgan", "diffusion": "ctgan", "gnn": "tabddpm", "ensemble": "tabddpm"}
SMALL_TABLE_ROWS = 10_000

# Total privacy budget, epsilon search range, and the number of runs before history is trusted.
PRIVACY_BUDGET = 3.0
EPSILON_RANGE = (0.1, 10.0)
MIN_HISTORY = 3

# Demo metadata table.
DEMO_LABELS = ["Normal", "COVID", "Viral Pneumonia", "Lung Opacity"]
DEMO_GENDERS = ["Male", "Female"]
DEMO_FINDINGS = ["No Finding", "Ground-glass opacity", "Consolidation", "Pleural effusion", "Infiltration"]
