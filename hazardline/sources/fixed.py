"""Fixed values of the cohort inputs, as their data dictionary states them."""

# Numeric subject columns.
DOUBLE_COLUMNS = ["BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT"]
# Texts read as missing.
MISSING_TOKENS = ["", "NA", "N/A", "#N/A", "NaN", "-NaN", "nan", "null", "NULL", "None", "<NA>", "n/a"]
# Gene sets.
GENE_SETS = {
    "EPIGENETIC": ["TET2", "DNMT3A", "IDH1", "IDH2"],
    "RTK": ["FLT3", "KIT", "NRAS", "KRAS"],
    "TRANSCRIPTION": ["RUNX1", "CEBPA", "ETV6"],
    "TUMOR_SUPPRESSOR": ["TP53", "WT1", "NPM1"],
}
# Pairs whose joint presence is a feature.
CO_OCCURRENCE_PAIRS = [("FLT3", "NPM1"), ("TP53", "RUNX1")]
# Fixed value: length of chromosome 7.
CHR7_LENGTH = 159345973
