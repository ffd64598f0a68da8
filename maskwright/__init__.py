"""maskwright: personal-data detection and pseudonymisation over Spark DataFrames."""
