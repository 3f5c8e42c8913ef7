"""vaultshift: move and check whole catalogs of tables with the Spark DataFrame API.

Catalog metadata (schemas, tables, keys, tags, grants, functions, views,
volumes) is held as DataFrames; every step is one transformation over all
objects at once.  Table bytes, files and log rows move through Spark tasks,
never through the driver.
"""

from vaultshift.session import build_session, shared_root

__all__ = ["build_session", "shared_root"]
