"""Names of the terrain queries and the SQL that checks them."""

from regolith.plans import mission, raster, report, terrain, traverse

QUERIES: dict = {**raster.QUERIES, **terrain.QUERIES, **traverse.QUERIES, **report.QUERIES, **mission.QUERIES}
ORACLE: dict[str, str] = {**raster.ORACLE, **terrain.ORACLE, **traverse.ORACLE, **report.ORACLE, **mission.ORACLE}
