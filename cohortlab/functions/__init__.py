from cohortlab.functions.columns import (  # noqa: F401
    FACTOR_CAP, NUM2FACTOR_THRESHOLD, ROW_ID, SEMANTIC_TYPES, UNCERTAIN,
    dec, qcol, quoted, safe_div, unpivot_double, unpivot_text,
)
