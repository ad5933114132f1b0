from .ingest import LANDED_COLUMNS, landed_attempts, start_landing

__all__ = ["LANDED_COLUMNS", "landed_attempts", "start_landing"]
