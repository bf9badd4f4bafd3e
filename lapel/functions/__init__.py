"""Column builders: money, dates, metrics, classification, SQL function twins."""
