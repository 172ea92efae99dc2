"""One object for all analytics: ``Engine.open(spark, folder).hero_kpis(state="Punjab")`` gives a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill.plans import analytics, home, model
from oathmill.sources import registry


class Engine:
    """Every function of ``plans.analytics`` that reads the fact, and the home page, with the fact filled in; and with ``assets``, ``cases``
    and ``elections`` where a function asks for one of these and the engine has it."""

    def __init__(self, fact: DataFrame, **frames: DataFrame):
        self.frames = {"fact": fact} | frames

    @property
    def fact(self) -> DataFrame:
        return self.frames["fact"]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Engine:
        """Normalised tables as parquet, one folder or file each."""
        names = ("election_appearances", "elections", "politicians", "states", "parties", "constituencies", "assets", "criminal_cases")
        tables = {name: spark.read.schema(model.schema(name)).parquet(f"{folder}/{name}.parquet") for name in names}
        cases = tables["criminal_cases"].select("appearance_id", F.col("id").alias("case_no"), F.coalesce("ipc_sections", F.lit("")).alias("ipc"))
        return cls(model.from_tables(tables, registry.states(spark)), assets=tables["assets"], cases=cases, elections=model.elections(tables))

    @classmethod
    def of_driver_tables(cls, spark: SparkSession, folder: str) -> Engine:
        return cls(model.from_driver(spark, folder), assets=model.asset_rows(spark, folder))

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        found = home.home if name == "home" else getattr(analytics, name, None)
        asked = list(inspect.signature(found).parameters) if inspect.isfunction(found) else []
        if name.startswith("_") or asked[:1] != ["fact"]:
            raise AttributeError(name)

        def run(*args, **kwargs) -> DataFrame:
            filled = {p: self.frames[p] for p in asked if p in self.frames and p not in kwargs}
            return found(**filled, **dict(zip((p for p in asked if p not in filled), args, strict=False)), **kwargs)

        return run
