"""Training-data pipeline operators: one module per operator, their queries in ``registry``."""
