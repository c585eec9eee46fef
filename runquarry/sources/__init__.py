from runquarry.sources.store import (RunStore, append_table, error_report, hex_prefix_predicates, read_run_store,
                                     search_runs, sql_source)
from runquarry.sources.versions import ConflictingCommit, VersionedStore

__all__ = ["ConflictingCommit", "RunStore", "VersionedStore", "append_table", "error_report", "hex_prefix_predicates", "read_run_store",
           "search_runs", "sql_source"]
