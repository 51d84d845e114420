"""Column-level building blocks: missing values, text keys, dates, effect sizes."""
