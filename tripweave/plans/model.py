"""The ridership model of one folder of tables, built once a session and shared by its queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..functions.routes import literal_set
from ..operators import boundary, pairs, systemwide, walks
from ..sources import standard
from ..sources.settled import discard, settled

UNIVERSE = {"A", "B", "C", "D"}
PRIMARY = {"A", "B", "C"}
TRUNK_A, TRUNK_B = {"A", "B"}, {"C", "D"}
CLOSE_M = 1200.0
#: The complex in the middle of all latitudes; origins lie south, destinations north of it.
BOUNDARY_ID = sorted(range(25), key=lambda k: (k * 37 % 100, k))[12]
BOUNDARY_LAT = 40.5 + (BOUNDARY_ID * 37 % 100) * 0.004


class Model:
    """Tables of stations are small and settled; trips are aggregated once and the pairs cached."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def trips(self) -> DataFrame:
        return standard.trips(self.spark, self.folder)

    @cached_property
    def complexes(self) -> DataFrame:
        return standard.complexes(self.spark, self.folder).cache()

    @cached_property
    def platforms(self) -> DataFrame:
        return standard.platforms(self.spark, self.folder).cache()

    @cached_property
    def points(self) -> DataFrame:
        return walks.walk_points(self.complexes, self.platforms).cache()

    @cached_property
    def counted(self) -> tuple[DataFrame, pairs.DayCoverage]:
        """The pairs and the days, from one scan of the trips."""
        return pairs.counted_pairs(self.trips, pairs.WEEKDAYS)

    @cached_property
    def n_days(self) -> int:
        return self.counted[1].n_days

    @cached_property
    def pairs(self) -> DataFrame:
        pairs.check_ends(self.counted[0], self.complexes)
        return self.counted[0]

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.spark.createDataFrame([("Current",), ("Swap",)], "scenario string")

    @cached_property
    def overrides(self) -> DataFrame:
        """Swap: on lines L1 and L2 route C takes the place of A."""
        moved = self.platforms.filter(F.col("line").isin("L1", "L2")).select("complex_id", "line").distinct()
        return moved.select(F.lit("Swap").alias("scenario"), "complex_id", "line", literal_set({"C"}).alias("add"), literal_set({"A"}).alias("remove"))

    @cached_property
    def at_platforms(self) -> DataFrame:
        return settled(walks.platform_routes(self.platforms, self.overrides, self.scenarios, literal_set(UNIVERSE)), "platforms")

    @cached_property
    def stations(self) -> DataFrame:
        return settled(walks.complex_routes(self.complexes, self.at_platforms, self.overrides, self.scenarios, literal_set(UNIVERSE)).coalesce(1), "stations")

    @cached_property
    def near(self) -> DataFrame:
        return settled(walks.nearest(self.points, self.at_platforms, self.stations).coalesce(1), "near")  # a row for each station and route

    @cached_property
    def ends(self) -> DataFrame:
        return settled(walks.station_ends(self.stations, self.near, self.platforms).coalesce(1), "ends")

    @cached_property
    def in_scope(self) -> DataFrame:
        return systemwide.scope(self.stations)

    @cached_property
    def known(self) -> list[str]:
        return bitmaps.dictionary(self.ends)

    @cached_property
    def table(self) -> DataFrame:
        return settled(systemwide.station_table(self.ends, self.in_scope, self.known).coalesce(1), "table")

    @cached_property
    def touched(self) -> DataFrame:
        return settled(systemwide.touched(self.table, "Current", self.known).coalesce(1), "touched")

    @cached_property
    def base(self) -> DataFrame:
        """The pairs under today's routing."""
        ids = [r[0] for r in self.in_scope.collect()]  # stations
        kept = self.pairs.filter(pairs.either_end_in(ids))
        return settled(systemwide.evaluated(kept, self.table.filter(F.col("scenario") == "Current"), self.known, CLOSE_M), "base")

    @cached_property
    def rows(self) -> DataFrame:
        return systemwide.with_differences(self.base, self.table, self.touched, "Current", self.known, CLOSE_M).cache()

    @cached_property
    def moves(self) -> DataFrame:
        return systemwide.compared(self.rows, "Current").cache()

    @cached_property
    def changes(self) -> DataFrame:
        return systemwide.changed_pairs(self.moves, self.n_days).cache()

    @cached_property
    def origins(self) -> DataFrame:
        return boundary.origins(self.complexes, literal_set(UNIVERSE), BOUNDARY_LAT, "south").cache()

    @cached_property
    def scoped(self) -> DataFrame:
        return boundary.scoped(self.pairs, self.origins, self.complexes, boundary.in_dest_scope(BOUNDARY_ID, BOUNDARY_LAT, "north"))

    @cached_property
    def assignments(self) -> DataFrame:
        rows = boundary.swap_scenarios(TRUNK_A, TRUNK_B, PRIMARY)
        boundary.check_assignment(rows, PRIMARY, UNIVERSE)
        return self.spark.createDataFrame(rows, "scenario string, active boolean, to_a array<string>, to_b array<string>")

    @cached_property
    def effective(self) -> DataFrame:
        return boundary.effective_routes(self.origins, self.assignments, literal_set(PRIMARY), literal_set(TRUNK_A), literal_set(TRUNK_B)).cache()

    @cached_property
    def partners(self) -> DataFrame:
        return walks.line_partners(self.platforms, literal_set(PRIMARY)).cache()

    @cached_property
    def crossings(self) -> DataFrame:
        return boundary.classified(self.scoped, self.effective, self.complexes, self.platforms, self.points, self.partners, UNIVERSE, PRIMARY, CLOSE_M).cache()


    def forget(self) -> None:
        """Gives back what is cached."""
        for value in vars(self).values():
            if isinstance(value, DataFrame):
                value.unpersist()
                discard(value)


_latest: dict[tuple, Model] = {}


def model(spark: SparkSession, folder: str) -> Model:
    """The latest model, as long as session, folder and its files are the same; another one takes its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = spark.sparkContext.applicationId, folder, tuple((f.getPath().getName(), f.getModificationTime()) for f in files)
    if key not in _latest:
        for old, held in _latest.items():
            if old[0] == key[0]:
                held.forget()
        _latest.clear()
        _latest[key] = Model(spark, folder)
    return _latest[key]


def forget() -> None:
    """The next query builds its model anew."""
    for held in _latest.values():
        held.forget()
    _latest.clear()
