"""Cross-validated Spark ML runs, feature selection and blending."""
