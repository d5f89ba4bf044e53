"""Jobs composed of operators: feature ETL, training, scoring, validation, serving."""
