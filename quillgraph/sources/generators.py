"""A sample graph of cities, and synthetic graphs of any size in closed form of the row number."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillgraph.model import PropertyGraph, Table

# Fixed values of the sample graph: (name, population, country, coastal) and (from, to, distance).
CITIES = [("London", 9000000, "UK", False), ("Paris", 2100000, "France", False), ("Berlin", 3700000, "Germany", False), ("Amsterdam", 870000, "Netherlands", True), ("Brussels", 1200000, "Belgium", False)]
RAIL = [(0, 1, 457), (0, 4, 370), (1, 4, 265), (1, 2, 1054), (4, 3, 210), (3, 2, 660)]
# Fixed values of the synthetic graph.
COUNTRIES = ["UK", "France", "Germany", "Spain", "Italy", "Netherlands", "Belgium", "Sweden", "Poland", "Portugal"]
OCCUPATIONS = ["Engineer", "Doctor", "Teacher", "Designer", "Analyst", "Manager", "Researcher", "Artist"]


def sample(spark: SparkSession) -> PropertyGraph:
    nodes = [(i, "City", {"name": n, "population": p, "country": c, "coastal": s}) for i, (n, p, c, s) in enumerate(CITIES)]
    return PropertyGraph.local(spark, nodes, [(i, a, b, "RAIL", float(w), {}) for i, (a, b, w) in enumerate(RAIL)])


def synthetic(spark: SparkSession, cities: int = 10_000, people: int = 50_000) -> PropertyGraph:
    """Cities are nodes 0 to cities-1, people follow; each person lives in a city and knows two people."""
    i = F.col("i")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    number = lambda n: F.lpad(i.cast("string"), n, "0")
    city = spark.range(cities).withColumnRenamed("id", "i").select(
        i.alias("id"), F.concat(F.lit("City"), number(6)).alias("p_name"), ((i % 10000) * 1000 + 50000).alias("p_population"), pick(COUNTRIES).alias("p_country"), (i % 3 == 0).alias("p_coastal"), (i % 3000).cast("double").alias("p_elevation")
    )
    person = spark.range(people).withColumnRenamed("id", "i").select(
        (i + cities).alias("id"), F.concat(F.lit("Person"), number(7)).alias("p_name"), (i % 60 + 20).alias("p_age"), pick(OCCUPATIONS).alias("p_occupation"), (i % 5 != 0).alias("p_active")
    )
    lives = spark.range(people).withColumnRenamed("id", "i").select(i.alias("id"), (i + cities).alias("src"), (i % cities).alias("dst"), F.lit(1.0).alias("weight"), (i % 25 + 2000).alias("p_since"))
    knows = spark.range(people).withColumnRenamed("id", "i").select(i, F.explode(F.array(F.lit(1), F.lit(3))).alias("step")).select(
        (people + i * 2 + (F.col("step") == 3).cast("int")).cast("long").alias("id"), (i + cities).alias("src"), ((i + F.col("step")) % people + cities).alias("dst"), F.lit(1.0).alias("weight"), ((i % 10) / 10).alias("p_strength")
    )
    return PropertyGraph(
        spark,
        [Table(city, "City", {"name": "text", "population": "int", "country": "text", "coastal": "bool", "elevation": "float"}), Table(person, "Person", {"name": "text", "age": "int", "occupation": "text", "active": "bool"})],
        [Table(lives, "LIVES_IN", {"since": "int"}), Table(knows, "KNOWS", {"strength": "float"})],
    )
