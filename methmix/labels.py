"""Fixed label tables. Each table has unique keys; `schema.assert_unique_keys`
guards tables that come from elsewhere."""

# ---- fixed values: sample group -> reference cell type ----------------------
SAMPLE_LABELS_SPLIT = {
    "Blueprint-B": "immune_b",
    "Blueprint-CD4": "immune_cd4",
    "Blueprint-CD8": "immune_cd8",
    "Blueprint-NK": "immune_nk",
    "Blueprint-Dend": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Macro": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Mono": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Eosi": "immune_eosi",
    "Blueprint-Neutro": "immune_neutro",
    "Blueprint-Eryth": "immune_eryth",
    "Blueprint-Mega": "immune_mega",
    "Eryth-prog": "eryth_prog",
}

SAMPLE_LABELS_T_COMBINED = {
    **SAMPLE_LABELS_SPLIT,
    "Blueprint-CD4": "immune_t",
    "Blueprint-CD8": "immune_t",
}

SAMPLE_LABELS_T_SUBSET = {
    "Blueprint-B": "immune_b",
    "t_naive": "immune_t_naive",
    "t_effector": "immune_t_effector",
    "t_reg": "immune_treg",
    "Blueprint-NK": "immune_nk",
    "Blueprint-Dend": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Macro": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Mono": "immune_dend_plus_macro_plus_mono",
    "Blueprint-Eosi": "immune_eosi",
    "Blueprint-Neutro": "immune_neutro",
    "Blueprint-Eryth": "immune_eryth",
    "Blueprint-Mega": "immune_mega",
    "Eryth-prog": "eryth_prog",
}

# ---- fixed values: panel target -> reference cell type ----------------------
REGION_LABELS_SPLIT = {
    "Immune_Broad_B": "immune_b",
    "Immune_Broad_CD4_plus_CD8": "immune_cd4",
    "Immune_Broad_CD8": "immune_cd8",
    "Immune_Broad_CD4": "immune_cd4",
    "Immune_Broad_NK": "immune_nk",
    "Immune_Broad_Dend_plus_Macro_plus_Mono": "immune_dend_plus_macro_plus_mono",
    "Immune_Broad_Eosi": "immune_eosi",
    "Immune_Broad_Neutro": "immune_neutro",
    "Immune_Refined_Eryth": "immune_eryth",
    "Immune_Refined_Mega": "immune_mega",
    "Eryth_prog": "eryth_prog",
}

REGION_LABELS_T_COMBINED = {
    "Immune_Broad_B": "immune_b",
    "Immune_Broad_CD4_plus_CD8": "immune_t",
    "Immune_Broad_NK": "immune_nk",
    "Immune_Broad_Dend_plus_Macro_plus_Mono": "immune_dend_plus_macro_plus_mono",
    "Immune_Broad_Eosi": "immune_eosi",
    "Immune_Broad_Neutro": "immune_neutro",
    "Immune_Refined_Eryth": "immune_eryth",
    "Immune_Refined_Mega": "immune_mega",
    "Eryth_prog": "eryth_prog",
}

REGION_LABELS_T_SUBSET = {
    "Immune_Broad_B": "immune_b",
    "Immune_Lymph_CD4_plus_CD8_Naive_wo_CM": "immune_t_naive",
    "Immune_Refined_CD4_Reg": "immune_treg",
    "Immune_Lymph_CD4_plus_CD8_Activated_wo_CM": "immune_t_effector",
    "Immune_Broad_NK": "immune_nk",
    "Immune_Broad_Dend_plus_Macro_plus_Mono": "immune_dend_plus_macro_plus_mono",
    "Immune_Broad_Eosi": "immune_eosi",
    "Immune_Broad_Neutro": "immune_neutro",
    "Immune_Refined_Eryth": "immune_eryth",
    "Immune_Refined_Mega": "immune_mega",
    "Eryth_prog": "eryth_prog",
}

# ---- fixed values: regrouping of T cells before labelling -------------------
T_COMBINED_GROUPS = {"Blueprint-CD4": "Blueprint-T", "Blueprint-CD8": "Blueprint-T"}

T_SUBSET_CELL_TYPES = {
    "regulatory T cell": "t_reg",
    "CD4-positive, alpha-beta T cell": "t_naive",
    "CD8-positive, alpha-beta T cell": "t_naive",
    "effector memory CD8-positive, alpha-beta T cell": "t_effector",
    "effector memory CD8-positive, alpha-beta T cell, terminally differentiated": "t_effector",
}

# ---- fixed values: titration design ----------------------------------------
TITRATION_LEVELS = [0.2, 0.15, 0.10, 0.08, 0.06, 0.04, 0.02, 0.01,
                    0.008, 0.006, 0.004, 0.002, 0.001, 0.0]
REPLICATES = 20
SEED = 888

WHOLE_BLOOD_ABUNDANCE = {
    "Blueprint-B": 0.06,
    "Blueprint-Mono": 0.09,
    "Blueprint-Neutro": 0.57,
    "Blueprint-T": 0.23,
    "Blueprint-NK": 0.05,
}

# Shares inside the T group while another T subset is titrated.
T_GROUP_TOTAL = 0.23
T_REG_SHARES_UNDER_EFFECTOR = {"t_naive": 0.90, "t_reg": 0.10}
T_EFFECTOR_SHARES_UNDER_REG = {"t_effector": 0.20, "t_naive": 0.80}

# ---- fixed values: scoring and estimation parameters ------------------------
MIN_OBSERVED_CPG = 3
KMERS = (1, 3, 4)
RATES_LEQ = (0.25,)
RATES_GEQ = (0.75,)
SCORE_COLUMN = "frac_alpha_leq_25pct"
MIN_MOLECULES_ATLAS = 10
MIN_MOLECULES_ESTIMATE = 20
LOD_TARGET = 0.95
TOLERANCE = 0.3
