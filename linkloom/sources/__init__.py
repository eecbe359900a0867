from linkloom.sources.tables import latest, table

__all__ = ["latest", "table"]
