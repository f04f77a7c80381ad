"""Small vocabularies of the retrieval and evaluation operators.

Every table is a parameter default: pass your own to use the engine in another domain.
"""

from __future__ import annotations

# They must agree with the published assistant for equal results. Order matters, the first match wins.
DISEASE_HINTS = {
    "lupus_nephritis": ["lupus", "benh than lupus", "viem than lupus", "lupus ban do", "ara 1997", "class iv"],
    "benh_than_iga": ["iga", "benh than iga", "viem cau than iga", "berger"],
    "hoi_chung_than_hu": ["hoi chung than hu", "than hu", "nephrotic syndrome"],
    "viem_cau_than_cap": ["viem cau than cap", "cap sau nhiem lien cau", "sau nhiem lien cau", "psagn"],
    "acute_kidney_injury": ["suy than cap", "aki", "ton thuong than cap", "rifle", "fena", "kdigo 2012"],
    "diabetic_kidney_disease": ["dai thao duong", "than dai thao duong", "diabetic kidney disease"],
    "viem_cau_than_man": ["viem cau than man", "viem cau than mang", "mang tang sinh", "xo hoa cau than"],
    "benh_ly_cau_than": ["benh ly cau than", "benh cau than", "viem cau than", "cau than"],
    "benh_than_man": ["benh than man", "suy than man", "ckd", "chronic kidney disease", "kdoqi", "albumin nieu", "acr"],
}
SECTION_HINTS = {
    "definition": ["la gi", "khai niem", "dinh nghia", "co nghia la gi"],
    "classification": ["phan loai", "phan do", "giai doan", "stage", "class", "kdigo", "rifle", "failure", "do iv", "uiv", "sieu am", "a1", "a2", "a3", "g1", "g2", "g3", "g4", "g5"],
    "diagnosis_criteria": ["chan doan", "chan doan xac dinh", "tieu chuan chan doan", "theo tieu chuan"],
    "treatment": ["dieu tri", "thuoc", "phac do", "corticosteroid", "khang sinh"],
    "clinical_features": ["trieu chung", "dau hieu", "lam sang", "can lam sang", "bieu hien", "khoi phat"],
    "pathology": ["mo benh hoc", "sinh thiet", "mien dich huynh quang", "hien vi", "lang dong"],
    "progression": ["tien trien", "tien luong", "lau dai", "tai phat"],
    "follow_up": ["theo doi", "tai kham", "du phong", "phong ngua"],
    "complications": ["bien chung", "tac dung khong mong muon", "tac dung phu"],
}
BIOMARKER_HINTS = {
    "ACR": ["acr", "albumin creatinine ratio", "albumin/creatinin", "albumin/creatinine"],
    "PCR": ["pcr", "protein/creatinin", "protein/creatinine", "protein niu/creatinin"],
    "GFR": ["gfr", "egfr", "muc loc cau than", "mlct"],
    "creatinine": ["creatinin", "creatinine"],
    "protein_niệu_24h": ["protein nieu 24h", "protein nieu", "protein niu 24h"],
}
RETRIEVAL_STOPWORDS = [
    "benh", "than", "hoi", "chung", "viem", "cau", "co", "la", "gi", "nao", "nhung", "cac", "cua", "cho", "theo", "duoc", "khi", "nhu", "the", "trong", "va", "hoac", "mot", "doi", "voi", "nguoi",
]
UNIT_ALIASES = {
    "g/24 giờ": "g/24h", "g/24h": "g/24h", "g/l": "g/L", "g/L": "g/L", "g/dl": "g/dL", "g/dL": "g/dL", "mmol/l": "mmol/L", "mmol/L": "mmol/L", "mg/g": "mg/g",
    "mg/mmol": "mg/mmol", "mg/dl": "mg/dL", "mg/dL": "mg/dL", "μmol/l": "μmol/L", "µmol/l": "μmol/L", "umol/l": "μmol/L", "μmol/L": "μmol/L", "mmhg": "mmHg", "mmHg": "mmHg",
    "ml/phút/1.73m2": "ml/ph/1.73m2", "ml/phút/1,73m2": "ml/ph/1.73m2", "ml/ph/1.73m2": "ml/ph/1.73m2", "ml/ph/1,73m2": "ml/ph/1.73m2", "ml/phút": "ml/ph", "ml/ph": "ml/ph", "kg": "kg", "cm": "cm", "%": "%",
}
#: Sex and race parameters of the published renal formulas.
SEX_FACTORS = {"cockcroft_gault": 0.85, "mdrd_gfr": 0.742}
CKD_EPI = {"female": {"kappa": 0.7, "alpha": -0.241, "female_factor": 1.012}, "male": {"kappa": 0.9, "alpha": -0.302, "female_factor": 1.0}}
BLACK_FACTOR = 1.21
FORMULAS = {
    "ckd_epi_2021_creatinine": "142 * (min(creatinine_mg_dl / kappa, 1) ** alpha) * (max(creatinine_mg_dl / kappa, 1) ** -1.2) * (0.9938 ** age) * female_factor",
    "mdrd_gfr": "186 * (creatinine_mg_dl ** -1.154) * (age ** -0.203) * sex_factor * race_factor",
    "cockcroft_gault": "((140 - age) * weight_kg) / (72 * creatinine_mg_dl) * sex_factor",
    "body_surface_area": "((weight_kg * height_cm) / 3600) ** 0.5",
    "fena_formula": "(urine_na * plasma_creatinine) / (plasma_na * urine_creatinine) * 100",
}
#: Rules of the renal classes: (biomarker, op, value, min, max, unit, label, disease).
CLASS_RULES = [
    ("ACR", "<", 30.0, None, None, "mg/g", "A1", None), ("ACR", "between", 30.0, 30.0, 300.0, "mg/g", "A2", None), ("ACR", ">=", 300.0, None, None, "mg/g", "A3", None),
    ("GFR", ">=", 90.0, None, None, "ml/ph/1.73m2", "G1", None), ("GFR", "between", 60.0, 60.0, 90.0, "ml/ph/1.73m2", "G2", None), ("GFR", "between", 45.0, 45.0, 60.0, "ml/ph/1.73m2", "G3a", None),
    ("GFR", "between", 30.0, 30.0, 45.0, "ml/ph/1.73m2", "G3b", None), ("GFR", "between", 15.0, 15.0, 30.0, "ml/ph/1.73m2", "G4", None), ("GFR", "<", 15.0, None, None, "ml/ph/1.73m2", "G5", None),
    ("GFR", "between", 60.0, 60.0, 90.0, "ml/ph/1.73m2", "CKD stage II", "benh_than_man"), ("GFR", "between", 30.0, 30.0, 60.0, "ml/ph/1.73m2", "CKD stage III", "benh_than_man"),
    ("GFR", "<", 15.0, None, None, "ml/ph/1.73m2", "CKD stage V", "benh_than_man"), ("albumin_máu", "<", 30.0, None, None, "g/L", "low_albumin", "hoi_chung_than_hu"), ("potassium", ">=", 6.5, None, None, "mmol/L", "severe_hyperkalemia", None),
]
# End of fixed values.
