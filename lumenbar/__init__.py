"""PySpark-native market analytics: bars, indicators, labels, models, signals, validation, audit."""
